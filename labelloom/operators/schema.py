"""Text and label columns, class ids and class names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scale import TASK_ROWS, number, sized_join, store

# Accepted column names, first match wins, letter case counts.
TEXT_COLUMNS = ["text", "sentence", "review", "content", "document"]
LABEL_COLUMNS = ["label", "labels", "class", "sentiment", "category"]


def find_columns(columns: list[str]) -> tuple[str, str]:
    """Names of the text and the label column, or ``ValueError`` when one is missing."""
    found = []
    for role, candidates in (("text", TEXT_COLUMNS), ("label", LABEL_COLUMNS)):
        name = next((c for c in candidates if c in columns), None)
        if name is None:
            raise ValueError(f"no {role} column: expected one of {candidates}, got {columns}")
        found.append(name)
    return found[0], found[1]


def normalize(df: DataFrame, id_column: str, keep: list[str] | None = None) -> DataFrame:
    """``(id, text, label)`` with an integer label, plus the columns in ``keep``."""
    text, label = find_columns(df.columns)
    # Rename by position: Spark would resolve `text` and `Text` to the same name.
    by_position = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])

    def source(name: str):
        return by_position[f"_c{df.columns.index(name)}"]

    return by_position.select(
        source(id_column).alias("id"),
        source(text).alias("text"),
        source(label).cast("int").alias("label"),
        *[source(k).alias(k) for k in keep or []],
    )


def class_catalog(
    df: DataFrame, label: str = "label", names: list[str] | None = None, task_rows: int = TASK_ROWS
) -> DataFrame:
    """``(label, class_name)`` of the classes that occur.

    String labels: the sorted values become the names of classes 0, 1, ... Integer labels: there
    are as many names ``class_0``, ``class_1``, ... as distinct values, whatever the values are.
    ``names``, declared with the dataset, are the names of classes 0, 1, ... in that order instead.
    """
    if names is not None:
        declared = [(i, str(name)) for i, name in enumerate(names)]
        return df.sparkSession.createDataFrame(declared, "label int, class_name string")
    kind = df.schema[label].dataType
    classes = df.select(F.col(label).alias("class_name")).filter(F.col("class_name").isNotNull()).distinct()
    numbered = number(store(classes, "classes"), ["class_name"], "_nth", task_rows).select(
        (F.col("_nth") - 1).cast("int").alias("label"), F.col("class_name").cast("string").alias("class_name")
    )
    if isinstance(kind, T.StringType):
        return numbered
    return numbered.withColumn("class_name", F.concat(F.lit("class_"), F.col("label")))


def encode_label(df: DataFrame, catalog: DataFrame, column: str) -> DataFrame:
    """Add the integer ``label`` of a string class column."""
    named = catalog.withColumnRenamed("class_name", column)
    return sized_join(df, named, [column], "left")


def decode_label(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """Add ``class_name``; an id without a name becomes ``class_<id>``."""
    named = catalog.select("label", F.col("class_name").alias("_name"))
    fallback = F.concat(F.lit("class_"), F.col("label").cast("string"))
    return (
        sized_join(df, named, ["label"], "left")
        .withColumn("class_name", F.coalesce("_name", fallback))
        .select(*df.columns, "class_name")
    )
