"""Labelled-text datasets: named splits in, JSON Lines and metadata out and in again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METADATA_SCHEMA = """
    dataset_name string, num_classes int, class_names array<string>, text_column string, label_column string,
    splits struct<train: bigint, val: bigint, test: bigint>,
    text_stats struct<avg_words: double, min_words: int, max_words: int, recommended_max_seq_length: int>
"""


def load_splits(
    spark: SparkSession, paths: dict[str, str], format: str = "parquet", optional: list[str] | None = None
) -> DataFrame:
    """The files of each named split in one table with a ``split`` column; train must be there.

    A column that one split has and another lacks is an error, unless it is named in ``optional``
    and so filled with nulls.
    """
    if "train" not in paths:
        raise ValueError(f"a train split is needed, got {sorted(paths)}")
    splits = [spark.read.format(format).load(path).withColumn("split", F.lit(name)) for name, path in paths.items()]
    needed = {c for df in splits for c in df.columns} - set(optional or [])
    for name, df in zip(paths, splits):
        if lacking := sorted(needed - set(df.columns)):
            raise ValueError(f"split {name} lacks {lacking}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), splits)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One folder of JSON Lines per split, holding ``text`` and integer ``label`` only."""
    lines = df.select("text", F.col("label").cast("int").alias("label"), "split")
    lines.write.partitionBy("split").option("ignoreNullFields", "false").json(path)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """``(text, label)``, and ``split`` where the folders name it.

    Other keys are ignored; a malformed line or an absent key is an error.
    """
    lines = spark.read.option("mode", "FAILFAST").schema("text string, label int").json(path)

    def required(name: str):
        missing = F.raise_error(F.lit(f"a line has no {name}"))
        return F.when(F.col(name).isNull(), missing).otherwise(F.col(name)).alias(name)

    return lines.select(required("text"), required("label"), *[c for c in lines.columns if c == "split"])


def dataset_metadata(
    name: str, catalog: DataFrame, sizes: DataFrame, stats: DataFrame, text_column: str, label_column: str
) -> DataFrame:
    """One row: names, class names, split sizes and text statistics."""
    spark = sizes.sparkSession
    classes = catalog.agg(F.array_sort(F.collect_list(F.struct("label", "class_name"))).getField("class_name")).scalar()
    size = {s: F.coalesce(F.sum(F.when(F.col("split") == s, F.col("n"))), F.lit(0)) for s in ("train", "validation", "test")}
    splits = sizes.agg(
        F.struct(size["train"].alias("train"), size["validation"].alias("val"), size["test"].alias("test"))
    ).scalar()
    lengths = stats.select(F.struct("avg_words", "min_words", "max_words", "recommended_max_seq_length")).scalar()
    return spark.range(1).select(
        F.lit(name).alias("dataset_name"),
        F.size(classes).alias("num_classes"),
        classes.alias("class_names"),
        F.lit(text_column).alias("text_column"),
        F.lit(label_column).alias("label_column"),
        splits.alias("splits"),
        lengths.alias("text_stats"),
    )


def write_metadata(metadata: DataFrame, path: str) -> None:
    metadata.coalesce(1).write.option("ignoreNullFields", "false").json(path)


def load_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Metadata written here or by hand over several lines."""
    return spark.read.option("multiLine", "true").schema(METADATA_SCHEMA).json(path)
