"""Train, validation and test splits that do not depend on row order or partitioning.

A row's split follows from a hash of its id, so assigning it never moves the row: in ``hash`` mode
the hash is compared with the ratio, in ``exact`` mode with the one hash and id found to cut off
the wanted number of rows.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import HASH_RANGE, hash_key
from .scale import store

SPLITS = ["train", "validation", "test"]

TEST_SALT = "test:42"
VAL_SALT = "val:42"
THREE_WAY_SALT = "split:42"

# Default carve-out share and the declared direct three-way shares.
CARVE_RATIO = 0.1
THREE_WAY_RATIOS = (0.85, 0.10, 0.05)


def _below_ratio(hashed: Column, ratio: float) -> Column:
    return hashed < int(Decimal(str(ratio)) * HASH_RANGE)


def _reached(counts: list, wanted: int) -> tuple:
    """The value in whose rows the wanted number is reached, and how many of them are needed."""
    for value, n in sorted(counts):
        if wanted <= n:
            break
        wanted -= n
    return value, wanted


def _cutoff(df: DataFrame, id_column: str, salt: str, ratio: float) -> tuple | None:
    """Hash and id of the last of the ``ceil(ratio * n)`` lowest rows, by (hash, id).

    Rows are counted by the top 16 bits of the hash, then those of one bucket by the low 16 bits;
    both counts have 65,536 numbers at most. Only rows whose whole hash is the wanted row's are
    sorted. All passes read nothing but the id and the split. Null ids are an error.
    """
    hashed = df.select(F.col(id_column).alias("id"), hash_key(F.col(id_column), salt).alias("h"))
    bucket = F.shiftright("h", 16)
    counts = hashed.groupBy(bucket.alias("bucket")).count().collect()
    if any(value is None for value, _ in counts):
        raise ValueError(f"{id_column} has null values")
    left = math.ceil(Decimal(str(ratio)) * sum(n for _, n in counts))
    if left == 0:
        return None
    edge, left = _reached(counts, left)
    h, left = _reached(hashed.filter(bucket == edge).groupBy("h").count().collect(), left)
    return hashed.filter(F.col("h") == h).orderBy("id").offset(left - 1).limit(1).first()


def carve(
    df: DataFrame,
    name: str,
    salt: str,
    ratio: float = CARVE_RATIO,
    id_column: str = "id",
    mode: str = "exact",
    group_key: str | None = None,
) -> DataFrame:
    """Move a share of the rows whose ``split`` is ``train`` to the split ``name``.

    ``exact`` moves ``ceil(ratio * n)`` rows; ``hash`` moves each row with the given probability,
    needs no look at the data, and never changes its mind as rows are added. With ``group_key``
    (``hash`` only) rows with equal values, such as copies of a text, stay together.
    """
    if mode not in ("exact", "hash"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "exact" and group_key:
        raise ValueError("group_key needs mode='hash': whole groups cannot meet an exact size")
    in_train = F.col("split") == "train"
    hashed = hash_key(F.col(group_key or id_column), salt)
    if mode == "hash":
        chosen = _below_ratio(hashed, ratio)
    else:
        cut = _cutoff(df.filter(in_train), id_column, salt, ratio)
        if cut is None:
            return df
        chosen = (hashed < cut.h) | ((hashed == cut.h) & (F.col(id_column) <= F.lit(cut.id)))
    return df.withColumn("split", F.when(in_train & chosen, name).otherwise(F.col("split")))


def carve_test(df: DataFrame, ratio: float = CARVE_RATIO, **options) -> DataFrame:
    return carve(df, "test", TEST_SALT, ratio, **options)


def carve_validation(df: DataFrame, ratio: float = CARVE_RATIO, **options) -> DataFrame:
    """Comes after ``carve_test`` and takes from what that left; hence a salt of its own."""
    return carve(df, "validation", VAL_SALT, ratio, **options)


def split_train_val_test(df: DataFrame, val_ratio: float = CARVE_RATIO, **options) -> DataFrame:
    """Both carve-outs on a table without splits: 81, 9 and 10 percent by default."""
    return carve_validation(carve_test(df.withColumn("split", F.lit("train")), **options), val_ratio, **options)


def split_three_way(
    df: DataFrame,
    ratios: tuple[float, float, float] = THREE_WAY_RATIOS,
    id_column: str = "id",
    group_key: str | None = None,
) -> DataFrame:
    """Train, validation and test shares from one hash with two thresholds."""
    if sum(Decimal(str(r)) for r in ratios) != 1:
        raise ValueError(f"ratios must add up to 1, got {ratios}")
    hashed = hash_key(F.col(group_key or id_column), THREE_WAY_SALT)
    train, val, _ = (Decimal(str(r)) for r in ratios)
    return df.withColumn(
        "split",
        F.when(_below_ratio(hashed, train), "train")
        .when(_below_ratio(hashed, train + val), "validation")
        .otherwise("test"),
    )


def resolve_splits(
    df: DataFrame, names: set[str], val_ratio: float = CARVE_RATIO, id_column: str = "id", mode: str = "exact"
) -> DataFrame:
    """Bring the named splits to train, validation and test.

    An existing test is used, else carved; ``validation`` is used, else ``val``, else carved. Rows
    of other splits (and of ``val`` next to ``validation``) are left out.
    """
    if "train" not in names:
        raise ValueError(f"a train split is needed, got {sorted(names)}")
    val = next((v for v in ("validation", "val") if v in names), None)
    used = ["train", *(["test"] if "test" in names else []), *([val] if val else [])]
    resolved = df.filter(F.col("split").isin(used))
    if val == "val":
        resolved = resolved.replace({"val": "validation"}, subset=["split"])
    if "test" not in names:
        resolved = carve_test(resolved, id_column=id_column, mode=mode)
    if val is None:
        resolved = carve_validation(resolved, val_ratio, id_column=id_column, mode=mode)
    return resolved


def split_overlap(df: DataFrame, text: str = "text") -> DataFrame:
    """Per held-out split: its rows, and how many have a text that also occurs in train.

    One aggregation by text hash and no join: a text with very many copies is counted where its
    rows lie and then is a single row.
    """
    per_text = df.groupBy(F.sha2(F.col(text), 256).alias("text_hash")).agg(
        *[F.count_if(F.col("split") == s).alias(s) for s in SPLITS]
    )
    sides = [F.struct(F.lit(s).alias("split"), F.col(s).alias("n")) for s in SPLITS[1:]]
    held_out = per_text.select((F.col("train") > 0).alias("seen"), F.inline(F.array(*sides))).filter("n > 0")
    rows, seen = F.sum("n"), F.coalesce(F.sum(F.when(F.col("seen"), F.col("n"))), F.lit(0))
    return held_out.groupBy("split").agg(
        rows.alias("n"), seen.cast("long").alias("n_in_train"), (seen / rows).alias("share_in_train")
    )


def split_drift(df: DataFrame) -> DataFrame:
    """Per held-out split and class: its share, the class's share of train, and the difference.

    Classes that either side lacks have share 0 there.
    """
    counts = store(
        df.groupBy("label").agg(*[F.count(F.when(F.col("split") == s, 1)).alias(s) for s in SPLITS]), "class-counts"
    )
    sizes = counts.agg(*[F.sum(s).alias(s) for s in SPLITS]).first()
    shares = counts.select("label", *[(F.col(s) / F.lit(sizes[s] or None).cast("long")).alias(s) for s in SPLITS])
    return shares.unpivot(["label", "train"], SPLITS[1:], "split", "share").select(
        "split", "label", "share", F.col("train").alias("train_share"), (F.col("share") - F.col("train")).alias("drift")
    )
