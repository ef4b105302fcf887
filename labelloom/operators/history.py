"""Training-run histories: one row per run and epoch, many runs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import perplexity
from .scale import PART, running, spread

# Epochs without improvement before stopping; epochs between checkpoints.
PATIENCE = 10
CHECKPOINT_EVERY = 10


def number_epochs(df: DataFrame, order: list[str | Column], run: str = "run_id") -> DataFrame:
    """Add ``epoch`` 1, 2, ... in the given order of each run."""
    numbered = running(spread(df, [run], order), [run], order, {"epoch": (F.sum, F.lit(1), True)})
    return numbered.withColumn("epoch", F.col("epoch").cast("int")).drop(PART)


def best_epoch(df: DataFrame, metric: str = "val_f1", run: str = "run_id") -> DataFrame:
    """Per run the first epoch with the highest metric; a run never above 0 has none."""
    valid = df.filter((F.col(metric) > 0) & ~F.isnan(metric))
    best = F.max(F.struct(F.col(metric), (-F.col("epoch")).alias("late")))
    return valid.groupBy(run).agg(best.alias("best")).select(
        run, (-F.col("best.late")).alias("best_epoch"), F.col(f"best.{metric}").alias(f"best_{metric}")
    )


def _streaks(df: DataFrame, metric: str, run: str) -> DataFrame:
    cut = spread(df, [run], ["epoch"])
    usable = F.when(~F.isnan(metric), F.col(metric))
    best = running(cut, [run], ["epoch"], {"best_before": (F.max, usable, False)})
    better = usable > F.greatest(F.lit(0.0), F.col("best_before"))
    marked = best.withColumn("improved", F.coalesce(better, F.lit(False)))
    at = F.when(F.col("improved"), F.col("epoch"))
    return (
        running(marked, [run], ["epoch"], {"improved_at": (F.max, at, True)})
        .withColumn("streak", F.col("epoch") - F.coalesce("improved_at", F.lit(0)))
        .drop("best_before", "improved_at")
    )


def improvement_streak(df: DataFrame, metric: str = "val_f1", run: str = "run_id") -> DataFrame:
    """Add ``improved`` (above all before, and above 0) and ``streak``, the epochs since then."""
    return _streaks(df, metric, run).drop(PART)


def early_stop(df: DataFrame, patience: int = PATIENCE, metric: str = "val_f1", run: str = "run_id") -> DataFrame:
    """The epochs each run would have trained: up to the first with a streak of ``patience``.

    Adds ``stopped``, true on that epoch. Patience 0 or less never stops.
    """
    streaks = _streaks(df, metric, run)
    if patience <= 0:
        return streaks.withColumn("stopped", F.lit(False)).drop(PART)
    flagged = streaks.withColumn("stopped", F.col("streak") >= patience)
    stops = {"stops_before": (F.sum, F.col("stopped").cast("int"), False)}
    counted = running(flagged, [run], ["epoch"], stops)
    return counted.filter(F.coalesce("stops_before", F.lit(0)) == 0).drop("stops_before", PART)


def checkpoint_epochs(df: DataFrame, every: int = CHECKPOINT_EVERY) -> DataFrame:
    return df.filter(F.col("epoch") % every == 0)


def generalization_gap(df: DataFrame, metric: str = "val_f1", run: str = "run_id") -> DataFrame:
    """Train minus validation accuracy, signed, at the last and at the best epoch of each run."""
    gap = F.col("train_acc") - F.col("val_acc")
    usable = F.when((F.col(metric) > 0) & ~F.isnan(metric), F.struct(metric, -F.col("epoch")))
    return df.withColumn("gap", gap).groupBy(run).agg(
        F.max("epoch").alias("last_epoch"),
        F.max_by("gap", "epoch").alias("gap_last"),
        F.max_by("epoch", usable).alias("best_epoch"),
        F.max_by("gap", usable).alias("gap_best"),
    )


def val_test_gap(df: DataFrame, results: DataFrame, run: str = "run_id") -> DataFrame:
    """Last recorded validation accuracy minus test accuracy, for every run of either side; what one
    side lacks is null. ``results`` has one row per run."""
    recorded = F.when(F.col("val_acc").isNotNull(), F.col("epoch"))
    last = df.groupBy(run).agg(F.max_by("val_acc", recorded).alias("val_acc"))
    return last.join(results.select(run, "test_acc"), run, "full").withColumn("gap", F.col("val_acc") - F.col("test_acc"))


def history_curves(df: DataFrame, metrics: list[str], run: str = "run_id") -> DataFrame:
    """Tidy series ``(run, epoch, metric, value)``."""
    return df.unpivot([run, "epoch"], metrics, "metric", "value")


def with_perplexity(df: DataFrame) -> DataFrame:
    """Add the perplexity of the train and validation loss, whichever are there."""
    found = [s for s in ("train", "val") if f"{s}_loss" in df.columns]
    return df.withColumns({f"{s}_perplexity": perplexity(F.col(f"{s}_loss")) for s in found})


def run_summary(df: DataFrame, run: str = "run_id") -> DataFrame:
    """Epoch time in total and on average, and the best validation loss and perplexity.

    Without values: 0 for the times and infinity for the bests.
    """
    infinity = F.lit(float("inf"))
    return df.groupBy(run).agg(
        F.coalesce(F.sum("epoch_time"), F.lit(0.0)).alias("total_time"),
        F.coalesce(F.avg("epoch_time"), F.lit(0.0)).alias("avg_epoch_time"),
        F.coalesce(F.min("val_loss"), infinity).alias("best_val_loss"),
        F.coalesce(F.min(perplexity(F.col("val_loss"))), infinity).alias("best_val_perplexity"),
    )
