"""Sizes, class shares, text lengths and examples of a dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import preview, word_count
from .schema import decode_label

# Fixed value: the longest recommended length.
LONGEST_RECOMMENDED = 512


def split_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("n"))


def class_distribution(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows per split and class, and their percentage of the split; labels ascending."""
    counts = df.groupBy("split", "label").agg(F.count("*").alias("n"))
    percent = F.col("n") / F.sum("n").over(Window.partitionBy("split")) * 100
    shares = counts.withColumn("pct", percent)
    return (
        decode_label(shares, catalog).select("split", "label", "class_name", "n", "pct").orderBy("split", "label")
    )


def head(df: DataFrame, n: int, id_column: str = "id") -> DataFrame:
    """The first ``n`` rows by id."""
    return df.orderBy(id_column).limit(n)


def text_stats(train: DataFrame, sample: int | None = None, id_column: str = "id") -> DataFrame:
    """Mean, least and most words of all texts, or on request of the first ``sample``, and the
    sequence length recommended from them. An empty table gives nulls.
    """
    rows = train if sample is None else head(train, sample, id_column)
    lengths = rows.select(word_count(F.col("text")).alias("words"))
    return lengths.agg(
        F.avg("words").alias("avg_words"), F.min("words").alias("min_words"), F.max("words").alias("max_words")
    ).withColumn(
        "recommended_max_seq_length",
        F.when(
            F.col("avg_words").isNotNull(), F.least(F.lit(LONGEST_RECOMMENDED), (F.col("avg_words") * 2).cast("int"))
        ),
    )


def sample_examples(train: DataFrame, catalog: DataFrame, n: int = 3, id_column: str = "id") -> DataFrame:
    """The first rows with class name and shortened text."""
    rows = decode_label(head(train.select(id_column, "label", "text"), n, id_column), catalog)
    return rows.select(id_column, "label", "class_name", preview(F.col("text")).alias("preview"))
