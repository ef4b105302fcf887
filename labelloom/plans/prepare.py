"""Prepare a dataset from start to end: splits, profile, JSON Lines and metadata."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.profile import class_distribution, sample_examples, split_sizes, text_stats
from ..operators.schema import class_catalog, decode_label, find_columns, normalize
from ..operators.splits import CARVE_RATIO, resolve_splits
from ..sources.datasets import dataset_metadata, load_metadata, load_splits, read_jsonl, write_jsonl, write_metadata


@dataclass
class Prepared:
    """Tables that describe the dataset; the rows themselves are in the output folder."""

    rows: DataFrame
    distribution: DataFrame
    examples: DataFrame
    metadata: DataFrame


def prepare_dataset(
    spark: SparkSession,
    name: str,
    paths: dict[str, str],
    output: str,
    id_column: str,
    val_ratio: float = CARVE_RATIO,
    format: str = "parquet",
    class_names: list[str] | None = None,
) -> Prepared:
    """Write ``output/data/split=...`` and ``output/metadata`` from the files of the named splits.

    ``class_names``, if the dataset declares them, are the names of classes 0, 1, ...
    """
    loaded = load_splits(spark, paths, format)
    text, label = find_columns(loaded.columns)
    rows = resolve_splits(normalize(loaded, id_column, ["split"]), set(paths), val_ratio)
    train = rows.filter("split = 'train'")
    catalog = class_catalog(train, names=class_names)
    metadata = dataset_metadata(name, catalog, split_sizes(rows), text_stats(train), text, label)
    write_jsonl(rows, f"{output}/data")
    write_metadata(metadata, f"{output}/metadata")
    return Prepared(rows, class_distribution(rows, catalog), sample_examples(train, catalog), metadata)


def open_prepared(spark: SparkSession, output: str) -> tuple[DataFrame, DataFrame]:
    """Metadata, and ``(text, label, split, class_name)``, of a folder that ``prepare_dataset`` wrote.

    A malformed line, or one without text or label, is an error.
    """
    metadata = load_metadata(spark, f"{output}/metadata")
    names = metadata.select(F.posexplode("class_names").alias("label", "class_name"))
    return metadata, decode_label(read_jsonl(spark, f"{output}/data"), names)
