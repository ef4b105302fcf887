"""Histories and results of training runs as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The series of a history, and those of the older layout with their names here.
HISTORY_METRICS = ["train_loss", "train_acc", "val_loss", "val_acc", "val_f1", "learning_rate"]
TRACKER_METRICS = {
    "train_losses": "train_loss",
    "val_losses": "val_loss",
    "train_perplexities": "train_perplexity",
    "val_perplexities": "val_perplexity",
    "learning_rates": "learning_rate",
    "epoch_times": "epoch_time",
}
TEST_METRICS = [
    "accuracy",
    "precision_macro",
    "recall_macro",
    "f1_macro",
    "precision_weighted",
    "recall_weighted",
    "f1_weighted",
    "loss",
]

# Epochs of one record; a longer run takes several.
PIECE_EPOCHS = 10_000

_METRIC_FIELDS = ", ".join(f"{m}: double" for m in TEST_METRICS)
RESULTS_SCHEMA = f"""
    run_id string, dataset string, num_classes int, training_time_minutes double, best_val_f1 double,
    test_metrics struct<{_METRIC_FIELDS}>, config map<string, string>,
    model_size string, num_parameters bigint, model_name string, use_lora boolean, freeze_base boolean,
    total_parameters bigint, trainable_parameters bigint
"""


def _run_id() -> Column:
    """The record's own, else the name of the folder its file lies in."""
    parts = F.split(F.col("_metadata.file_path"), "/")
    return F.coalesce(F.col("run_id"), F.element_at(parts, -2)).alias("run_id")


def _read_arrays(spark: SparkSession, path: str, names: dict[str, str], lines: bool) -> DataFrame:
    schema = "run_id string, first_epoch int, " + ", ".join(f"{n} array<double>" for n in names)
    records = spark.read.option("multiLine", str(not lines).lower()).schema(schema).json(path)
    # A missing series is an empty one and gives nulls.
    series = [F.coalesce(F.col(n), F.array().cast("array<double>")).alias(m) for n, m in names.items()]
    rows = records.select(_run_id(), "first_epoch", F.posexplode_outer(F.arrays_zip(*series)).alias("pos", "at"))
    return rows.select(
        "run_id", (F.col("pos") + F.coalesce("first_epoch", F.lit(1))).alias("epoch"), *[F.col("at").getField(m).alias(m) for m in names.values()]
    )


def read_history(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per run and epoch from records of parallel arrays; a run without any values gives one
    row without an epoch.

    ``path`` may be a pattern over many runs. Files hold one record each, or one per line with
    ``lines``, which Spark can split.
    """
    return _read_arrays(spark, path, {m: m for m in HISTORY_METRICS}, lines)


def read_tracker(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """As ``read_history`` for the layout with losses, perplexities, rates and epoch times."""
    return _read_arrays(spark, path, TRACKER_METRICS, lines)


def write_history(df: DataFrame, path: str, run: str = "run_id", piece_epochs: int = PIECE_EPOCHS) -> None:
    """One line per run with the metrics found in ``df`` as parallel arrays; epochs are 1, 2, ...

    A run of more than ``piece_epochs`` epochs takes several lines, of which all but the first say
    with which ``first_epoch`` they begin.
    """
    metrics = [m for m in HISTORY_METRICS if m in df.columns]
    epochs = F.array_sort(F.collect_list(F.struct("epoch", *metrics)))
    piece = F.floor((F.col("epoch") - 1) / piece_epochs)
    arrays = df.groupBy(F.col(run).alias("run_id"), piece.alias("piece")).agg(epochs.alias("at"))
    begins = F.when(F.col("piece") > 0, F.col("piece") * piece_epochs + 1).alias("first_epoch")
    arrays.select("run_id", begins, *[F.col("at").getField(m).alias(m) for m in metrics]).write.json(path)


def write_results(df: DataFrame, path: str) -> None:
    """One line per run, nested as given."""
    df.write.json(path)


def read_results(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Nested run records; settings stay a map because their keys differ by recipe."""
    records = spark.read.option("multiLine", str(not lines).lower()).schema(RESULTS_SCHEMA).json(path)
    return records.select(_run_id(), *[c for c in records.columns if c != "run_id"])


def flatten_results(df: DataFrame) -> DataFrame:
    """The test metrics as columns of their own."""
    return df.select(*[c for c in df.columns if c != "test_metrics"], "test_metrics.*")
