"""Classification metrics, all from the table of label and prediction counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scale import PART, running, spread


def confusion_matrix(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows per (label, prediction): the only pass over the predictions."""
    return df.groupBy(*(by or []), "label", "prediction").agg(F.count("*").alias("n"))


def _ratio(part: Column, whole: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.when(whole == 0, 0.0).otherwise(part / whole)


def per_class_metrics(confusion: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts, precision, recall and F1 of every class that is a label or a prediction."""
    by = by or []
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    as_label = F.struct(F.col("label").alias("class"), hit.alias("tp"), F.lit(0).alias("predicted"), F.col("n").alias("support"))
    as_prediction = F.struct(
        F.col("prediction").alias("class"), F.lit(0).alias("tp"), F.col("n").alias("predicted"), F.lit(0).alias("support")
    )
    roles = confusion.select(*by, F.inline(F.array(as_label, as_prediction)))
    counts = roles.groupBy(*by, F.col("class").alias("label")).agg(
        *[F.sum(c).cast("long").alias(c) for c in ("tp", "predicted", "support")]
    )
    return counts.withColumns(
        {
            "precision": _ratio(F.col("tp"), F.col("predicted")),
            "recall": _ratio(F.col("tp"), F.col("support")),
            "f1": _ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")),
        }
    )


def classification_metrics(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy, and macro and support-weighted precision, recall and F1; one row per ``by``.

    Macro F1 is the mean of the classes' F1, not the F1 of the mean precision and recall.
    """
    by = by or []
    classes = per_class_metrics(confusion_matrix(df, by), by)
    support = F.sum("support")
    weighted = {m: F.sum(F.col(m) * F.col("support")) / support for m in ("precision", "recall", "f1")}
    return classes.groupBy(*by).agg(
        (F.sum("tp") / support).alias("accuracy"),
        *[F.avg(m).alias(f"{m}_macro") for m in ("precision", "recall", "f1")],
        *[value.alias(f"{m}_weighted") for m, value in weighted.items()],
    )


def epoch_loss(df: DataFrame, loss: str = "loss", batch: str = "batch_id", weighting: str = "batch") -> DataFrame:
    """Mean of the batch means (a short last batch counts in full), or the plain mean over examples."""
    if weighting not in ("batch", "example"):
        raise ValueError(f"unknown weighting {weighting!r}")
    batches = df.groupBy(batch).agg(F.sum(loss).alias("total"), F.count(loss).alias("n"))
    mean = F.avg(F.col("total") / F.col("n")) if weighting == "batch" else F.sum("total") / F.sum("n")
    return batches.agg(mean.alias("epoch_loss"))


def running_accuracy(df: DataFrame, run: list[str], batch: str = "batch_id") -> DataFrame:
    """Correct, seen and their ratio after each batch of a run."""
    batches = df.groupBy(*run, batch).agg(
        F.count_if(F.col("label") == F.col("prediction")).alias("correct"), F.count("*").alias("total")
    )
    sums = {
        "running_correct": (F.sum, F.col("correct"), True),
        "running_total": (F.sum, F.col("total"), True),
    }
    counted = running(spread(batches, run, [batch]), run, [batch], sums).drop(PART)
    return counted.withColumn("running_accuracy", F.col("running_correct") / F.col("running_total"))
