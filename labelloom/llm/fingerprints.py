"""Document fingerprints: weighted SimHash, and search within a Hamming radius by permuted block tables.

Everything here is DataFrame expressions. The terms of a text are its pairs of neighbouring words
(one word alone, if there is only one); a term weighs 1 to 4 by its length, each time it occurs.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.llm import common as C
from labelloom.operators.scale import shuffle_tasks

BLOCKS = 6
RADIUS = 3
QUERY_EVERY = 50


def text_votes(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per ``keys`` with the SimHash of ``text`` as ``fingerprint``; keys must tell the rows apart."""
    split = rows.select(*keys, C.words(F.col(text)).alias("w"))
    terms = split.select(*keys, F.explode_outer(C.shingles(F.col("w"), 2)).alias("s"))
    first, second = C.parts("s", 2)
    size = F.octet_length(first) + F.coalesce(F.octet_length(second), F.lit(0))
    terms = terms.select(
        *keys,
        F.when(first.isNotNull(), F.xxhash64(first, second)).alias("h"),
        F.least(1 + F.shiftright(size, 3), F.lit(4)).alias("weight"),
    )
    return terms.groupBy(*keys).agg(*C.votes(F.col("h"), F.col("weight"))).select(*keys, C.fingerprint().alias("fingerprint"))


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Rows in ascending doc_id with the text of the next one; the last one's next is the first.

    Rows are cut by id into buckets (one shuffle). The first row of a bucket also goes to the end
    of the bucket before, marked ``lent``, and the very first to the end of the last one. Null ids
    come first; equal ids are ordered by text. Cut points are ids at even ranks, at most as many as
    there are shuffle partitions.
    """
    buckets = buckets or shuffle_tasks(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    shares = [i / buckets for i in range(1, buckets)] or [0.5]
    found = docs.agg(
        F.percentile_approx("doc_id", shares, 10_000), F.min("doc_id"), F.count(F.when(F.col("doc_id").isNull(), 1))
    ).first()
    least, nulls = found[1], found[2]
    cuts = sorted(set(found[0] or [])) if buckets > 1 else []
    if not nulls:
        cuts = [c for c in cuts if c != least]
    borders = F.array(*[F.lit(c).cast("long") for c in cuts])
    bucket = F.coalesce(F.size(F.filter(borders, lambda c: c <= F.col("doc_id"))), F.lit(0)) if cuts else F.lit(0)
    very_first = F.col("doc_id").isNull() if nulls else F.col("doc_id").eqNullSafe(F.lit(least))
    opens = F.col("doc_id").isin(cuts) if cuts else F.lit(False)
    own = F.struct(F.col("bucket").alias("to"), F.lit(False).alias("lent"))
    other = (
        F.when(very_first, F.lit(len(cuts))).when(F.coalesce(opens, F.lit(False)), F.col("bucket") - 1)
    )
    placed = (
        docs.select("doc_id", text.alias("text"), bucket.alias("bucket"))
        .withColumn("at", F.explode(F.array_compact(F.array(own, F.when(other.isNotNull(), F.struct(other.alias("to"), F.lit(True).alias("lent")))))))
        .select(F.col("at.to").alias("bucket"), F.col("at.lent").alias("lent"), "doc_id", "text")
    )
    order = Window.partitionBy("bucket").orderBy("lent", "doc_id", F.xxhash64("text"), "text")
    return placed.withColumns({"nth": F.row_number().over(order), "next_text": F.lead("text").over(order)})


def edited_fingerprints(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, with likeness to the edited and the next text.

    ``fingerprint`` and ``edited_fingerprint`` are 64-bit numbers. Null texts count as empty; an
    empty text has fingerprint zero; repeated rows each get a row.
    """
    rows = with_next(docs, buckets)
    n = F.char_length("text")
    part = F.floor(n / 4).cast("int")
    rows = rows.select(
        "bucket",
        "nth",
        "lent",
        "doc_id",
        n.cast("long").alias("n_chars"),
        "text",
        F.when(
            ~F.col("lent"),
            F.concat(
                F.substring(F.col("text"), F.lit(1), n - part), F.substring(F.col("next_text"), F.lit(1), part)
            ),
        ).alias("edited"),
    )
    keys = ["bucket", "nth", "lent", "doc_id", "n_chars"]
    both = rows.select(
        *keys,
        F.when(~F.col("lent"), F.sha2("edited", 256)).alias("edited_sha256"),
        F.explode(
            F.array(
                F.struct(F.lit(False).alias("changed"), F.col("text").alias("body")),
                F.struct(F.lit(True).alias("changed"), F.col("edited").alias("body")),
            )
        ).alias("v"),
    ).select(*keys, "edited_sha256", F.col("v.changed").alias("changed"), F.col("v.body").alias("body"))
    prints = text_votes(both, [*keys, "edited_sha256", "changed"], "body")
    one = prints.groupBy(*keys, "edited_sha256").agg(
        F.max(F.when(~F.col("changed"), F.col("fingerprint"))).alias("fingerprint"),
        F.max(F.when(F.col("changed"), F.col("fingerprint"))).alias("edited_fingerprint"),
    )
    order = Window.partitionBy("bucket").orderBy("nth")
    alike = lambda other: 1 - C.distance(F.col("fingerprint"), F.col(other)) / F.lit(64.0)
    return (
        one.withColumn("next_fingerprint", F.lead("fingerprint").over(order))
        .filter(~F.col("lent"))
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            "fingerprint",
            "edited_fingerprint",
            alike("edited_fingerprint").alias("near_edited"),
            alike("next_fingerprint").alias("near_next"),
        )
    )


def _masks(blocks: int, radius: int) -> list[int]:
    """One mask per choice of ``blocks - radius`` blocks; two values within the radius agree under one."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    ones = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(edges)]
    masks = [sum(chosen) for chosen in itertools.combinations(ones, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def within_radius(queries: DataFrame, values: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """All pairs ``(query, value)`` of distinct 64-bit ``fingerprint`` values within the radius.

    Each mask is a table keyed by the value's masked bits. A pair that agrees in several tables is
    taken from the first of them, so the join gives every pair once.
    """
    if not 0 <= radius < blocks:
        raise ValueError("the radius must be smaller than the number of blocks")
    masks = _masks(blocks, radius)

    def tables(df: DataFrame, name: str) -> DataFrame:
        bits = F.col("fingerprint")
        cells = [F.struct(F.lit(t).alias("t"), bits.bitwiseAND(F.lit(m)).alias("cell")) for t, m in enumerate(masks)]
        return df.select(bits.alias(name), F.explode(F.array(*cells)).alias("c")).select(name, "c.t", "c.cell")

    left, right = tables(queries, "query"), tables(values, "value")
    differ = F.col("query").bitwiseXOR(F.col("value"))
    first: Column = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m)) == 0, F.lit(t)) for t, m in enumerate(masks)])
    left, right = left.alias("l"), right.alias("r")
    match = (
        (F.col("l.t") == F.col("r.t"))
        & (F.col("l.cell") == F.col("r.cell"))
        & (F.bit_count(differ) <= radius)
        & (first == F.col("l.t"))
    )
    return left.hint("merge").join(right, match).select("query", "value")  # sizes before explode mislead the planner


def query(spark, folder: str) -> DataFrame:
    """The contract's columns, and for ids divisible by 50 ``near_rows``: other rows within 3 bits."""
    prints = C.stored(edited_fingerprints(C.table(spark, folder, "documents")), "fingerprints")
    values = prints.groupBy("fingerprint").agg(F.count("*").alias("copies"))
    asked = F.col("doc_id") % QUERY_EVERY == 0
    found = within_radius(prints.filter(asked).select("fingerprint").distinct(), values)
    near = (
        found.join(values.withColumnRenamed("fingerprint", "value"), "value")
        .groupBy(F.col("query").alias("fingerprint"))
        .agg((F.sum("copies") - 1).alias("near_rows"))
    )
    return prints.join(near, "fingerprint", "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        C.hex16(F.col("fingerprint")).alias("fingerprint"),
        C.hex16(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        F.when(asked, F.col("near_rows")).alias("near_rows"),
    )
