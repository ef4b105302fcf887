"""Words, shingles and SimHash votes as Spark expressions, shared by the operators of this package."""

from __future__ import annotations

import string
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.operators.scale import scratch_path

SPACE = r"[\x20\x09-\x0D]+"
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOW = 0x0000000100000001
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 500  # whole texts sent to a Python worker at a time, unless the session says otherwise


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    # Python workers started in another folder find this package too
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    if spark.conf.get(BATCH) == "10000":  # Spark's default, too many for long texts
        spark.conf.set(BATCH, str(BATCH_ROWS))
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read from there: survives lost executors and cuts lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def words(text: Column, separators: str = SPACE) -> Column:
    """The words between runs of separators; null counts as the empty text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def shingles(array: Column, k: int) -> Column:
    """Runs of k words as structs ``0 .. k-1``; fewer than k words make one run, padded with nulls."""
    n = F.greatest(F.size(array) - (k - 1), F.lit(1))
    return F.arrays_zip(*[F.slice(array, i + 1, n).alias(str(i)) for i in range(k)])


def parts(column: str, k: int) -> list[Column]:
    return [F.col(f"{column}.`{i}`") for i in range(k)]


def votes(term_hash: Column, weight: Column | None = None) -> list[Column]:
    """Sums of a 64-bit hash's bits, two bits to a sum, and the total weight as ``v_all``.

    Sum k holds bit k in its lower and bit k + 32 in its upper half, so that a group may weigh up
    to 2^31. Rows whose hash is null don't vote.
    """
    weight = F.lit(1).cast("long") if weight is None else weight.cast("long")
    return [
        *[F.sum(F.shiftrightunsigned(term_hash, k).bitwiseAND(F.lit(LOW)) * weight).alias(f"v{k}") for k in range(32)],
        F.sum(F.when(term_hash.isNotNull(), weight)).alias("v_all"),
    ]


def fingerprint() -> Column:
    """The SimHash of rows with ``votes``: a bit is 1 if it is set in over half the weight; none: zero."""
    bits = F.lit(0).cast("long")
    for k in range(32):
        for bit, count in (
            (k, F.col(f"v{k}").bitwiseAND(F.lit(0xFFFFFFFF))),
            (k + 32, F.shiftrightunsigned(F.col(f"v{k}"), 32)),
        ):
            value = (1 << bit) - (1 << 64 if bit == 63 else 0)
            bits = bits.bitwiseOR(F.when(count * 2 > F.col("v_all"), F.lit(value)).otherwise(F.lit(0)).cast("long"))
    return F.coalesce(bits, F.lit(0).cast("long"))


def hex16(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def distance(left: Column, right: Column) -> Column:
    return F.bit_count(left.bitwiseXOR(right))
