"""Benchmark decontamination with SimHashed item-sized windows.

Texts are lower-cased and cut into words at ASCII characters other than letters and digits; the
shingles are runs of five words, or of all words of an item that has fewer. For every length of item
(counted in shingles) a document has windows of that length. Steps, all of them DataFrame expressions:

1. Windows that can reach the similarity. A shingle that no item of the length has adds nothing to
   a match, so a best window starts at one that some item has, and it must hold enough of those;
   both follow from the similarity bound, so nothing that qualifies is left out.
2. Fingerprints. Each such window gets a SimHash of the shingles that the benchmark knows, as has
   each item. The second, third, ... occurrence of a shingle votes with a hash of its own, so that a
   repeated one doesn't outvote the others. ``RADIUS + 1`` blocks of bits index the fingerprints:
   two within the radius agree in one block at least, so all of them are met. At a similarity of
   exactly 0.8 a pair differs in 10 of 64 bits on average, with a deviation of 3.
3. The rest. A pair beyond the radius is met by a shingle: a window that reaches the similarity has
   four fifths of an item's shingles, hence one of any ``n - ceil(0.8 n) + 1`` of them. Those that
   the fewest windows have are taken.
4. Proof. Candidates are kept if the multisets of shingles have a weighted Jaccard similarity of
   0.8 or more.
"""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm import common as C
from labelloom.operators.scale import free_name, sized_join

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 20


def numbered(hashes: str) -> Column:
    """The n-th occurrence of a hash in a sorted array as an element of its own; the first ones stay."""

    def element(x: Column, i: Column) -> Column:
        nth = i + 1 - F.array_position(hashes, x)
        return F.when(nth == 0, x).otherwise(F.xxhash64(x, nth))

    plain = F.size(F.array_distinct(hashes)) == F.size(hashes)
    return F.when(plain, F.col(hashes)).otherwise(F.transform(hashes, element))


def item_shingles(benchmark: DataFrame, k: int = SHINGLE) -> DataFrame:
    """``item_id, width, size, hashes`` of items that have words; ``width`` is their shingles' number of words."""
    split = benchmark.select("item_id", C.words(F.lower("text"), C.NOT_ALNUM).alias("w")).filter(F.size("w") > 0)
    runs = split.select("item_id", F.least(F.size("w"), F.lit(k)).alias("width"), C.shingles(F.col("w"), k).alias("s"))
    hashes = F.transform("s", lambda x: F.xxhash64(*[x[str(i)] for i in range(k)]))
    return runs.select("item_id", "width", F.sort_array(hashes).alias("hashes")).withColumn("size", F.size("hashes"))


def _simhash(df: DataFrame, hashes: str) -> DataFrame:
    lanes = F.transform(
        F.sequence(F.lit(0), F.lit(31)),
        lambda k: F.aggregate(
            hashes,
            F.lit(0).cast("long"),
            lambda total, h: total + F.call_function("shiftrightunsigned", h, k).bitwiseAND(F.lit(C.LOW)),
        ),
    )
    voted = df.withColumn("lanes", lanes).withColumn("v_all", F.size(hashes))
    named = voted.withColumns({f"v{k}": F.col("lanes")[k] for k in range(32)})
    return named.withColumn("bits", C.fingerprint()).drop("lanes", "v_all", *[f"v{k}" for k in range(32)])


def windows(docs: DataFrame, items: DataFrame, k: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Windows ``row, doc_id, width, size, start, length, hashes`` that hold enough shingles of items of that size.

    ``hashes`` are those shingles of the window that an item of the size has, in order of hashes.
    """
    known = items.select("width", "size", F.explode("hashes").alias("h")).distinct()
    split = docs.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        C.words(F.lower("text"), C.NOT_ALNUM).alias("w"),
    )

    def hits(width: int) -> DataFrame:
        runs = split.select(
            "row",
            "doc_id",
            (F.size("w") - (width - 1)).alias("n"),
            F.posexplode_outer(C.shingles(F.col("w"), width)).alias("pos", "s"),
        ).filter("pos is not null AND n > 0")
        runs = runs.select("row", "doc_id", "n", "pos", F.xxhash64(*C.parts("s", width)).alias("h"))
        return sized_join(runs, known.filter(F.col("width") == width), ["h"], spread_by=["row", "pos"])

    # at most k widths; those under k only where the benchmark has items of so few words
    widths = sorted(r["width"] for r in items.select("width").distinct().collect()) or [k]
    met = functools.reduce(DataFrame.unionByName, map(hits, widths))
    held = met.groupBy("row", "doc_id", "width", "n", "size").agg(
        F.sort_array(F.collect_list(F.struct("pos", "h"))).alias("a")
    )

    def window(x, j):
        length = F.least(F.col("size"), F.col("n") - x["pos"])
        # inter / (size + length - inter) >= similarity
        need = F.ceil((F.col("size") + length) * (similarity / (1 + similarity)) - 1e-9).cast("int")
        inside = F.filter(F.slice("a", j + 1, F.col("size")), lambda y: y["pos"] < x["pos"] + F.col("size"))
        enough = F.get("a", j + need - 1)["pos"] < x["pos"] + F.col("size")
        return F.when(
            enough,
            F.struct(
                x["pos"].alias("start"),
                length.alias("length"),
                F.sort_array(F.transform(inside, lambda y: y["h"])).alias("hashes"),
            ),
        )

    kept = ["row", "doc_id", "width", "size"]
    return held.select(*kept, F.explode(F.array_compact(F.transform("a", window))).alias("v")).select(*kept, "v.*")


def _blocks(radius: int) -> list[int]:
    edges = [round(i * 64 / (radius + 1)) for i in range(radius + 2)]
    masks = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(edges)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def candidates(left: DataFrame, right: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs ``size, bits, item_bits`` of distinct fingerprints of equal size within the radius, once each."""
    masks = _blocks(radius)

    def cells(df: DataFrame, name: str) -> DataFrame:
        made = [F.struct(F.lit(b).alias("b"), F.col("bits").bitwiseAND(F.lit(m)).alias("cell")) for b, m in enumerate(masks)]
        each = df.select("size", "bits").distinct()
        return each.select("size", F.col("bits").alias(name), F.explode(F.array(*made)).alias("c")).select(
            "size", name, "c.b", "c.cell"
        )

    l, r = cells(left, "bits").alias("l"), cells(right, "item_bits").alias("r")  # noqa: E741
    differ = F.col("bits").bitwiseXOR(F.col("item_bits"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m)) == 0, F.lit(b)) for b, m in enumerate(masks)])
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("size", "b", "cell")]
    return l.join(r, same[0] & same[1] & same[2] & (F.bit_count(differ) <= radius) & (first == F.col("l.b"))).select(
        "l.size", "bits", "item_bits"
    )


def farther(found: DataFrame, items: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs ``size, bits, item_bits`` beyond the radius that may reach the similarity, once each.

    Of each item's elements only as many as a similar window can't all lack are looked up, those
    that the fewest different windows have.
    """
    held = found.select("size", "bits", "elements").distinct().select("size", "bits", F.explode("elements").alias("e"))
    held = C.stored(held.distinct(), "window-elements")
    often = held.groupBy("size", "e").agg(F.count("*").alias("n"))
    each = items.select("size", F.col("bits").alias("item_bits"), "elements").distinct()
    each = each.withColumn("item", F.xxhash64("elements")).select("size", "item_bits", "item", F.explode("elements").alias("e"))
    ranked = each.join(often, ["size", "e"], "left").groupBy("size", "item_bits", "item").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "e"))).alias("x")
    )
    lookup = F.col("size") - F.ceil(F.col("size") * similarity - 1e-9).cast("int") + 1
    asked = ranked.select("size", "item_bits", F.explode(F.slice("x", F.lit(1), lookup)).alias("x"))
    asked = C.stored(asked.filter("x.n > 0").select("size", "item_bits", F.col("x.e").alias("e")).distinct(), "rare-elements")
    met = sized_join(held, asked, ["size", "e"], spread_by=["bits"])
    return met.filter(C.distance(F.col("bits"), F.col("item_bits")) > radius).select("size", "bits", "item_bits").distinct()


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    k: int = SHINGLE,
    similarity: float = SIMILARITY,
    radius: int = RADIUS,
) -> DataFrame:
    """``doc_id, item_id, similarity, first_word, n_words, hamming`` for each item found in a document.

    The best window counts, of equal ones the first. Null texts and texts without words match
    nothing, nor do items without words; an item of fewer than k words is one shingle of all its
    words and is found wherever they stand one after another. Rows with a repeated doc_id are
    looked at one by one and reported once per item.
    """

    def printed(df: DataFrame, name: str) -> DataFrame:
        return C.stored(_simhash(df.withColumn("elements", numbered("hashes")).drop("hashes"), "elements"), name)

    items = printed(item_shingles(benchmark, k), "items")
    found = printed(windows(docs, items.withColumnRenamed("elements", "hashes"), k, similarity), "windows")
    near = candidates(found, items, radius).unionByName(farther(found, items, radius, similarity))
    right = items.select(
        "item_id", "width", "size", F.col("bits").alias("item_bits"), F.col("elements").alias("item_elements")
    )
    pairs = found.join(near, ["size", "bits"]).join(right, ["width", "size", "item_bits"])
    inter = F.size(F.array_intersect("elements", "item_elements"))
    scored = pairs.select(
        "doc_id",
        "item_id",
        "start",
        "length",
        "width",
        (inter / (F.col("size") + F.col("length") - inter)).alias("similarity"),
        C.distance(F.col("bits"), F.col("item_bits")).alias("hamming"),
    ).filter(F.col("similarity") >= similarity)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("start"), "length", "width", "hamming")).alias("best")
    return (
        scored.groupBy("doc_id", "item_id")
        .agg(best)
        .select(
            "doc_id",
            "item_id",
            F.round("best.similarity", 6).alias("similarity"),
            (-F.col("best.start")).alias("first_word"),
            (F.col("best.length") + F.col("best.width") - 1).alias("n_words"),
            F.col("best.hamming").alias("hamming"),
        )
    )


def query(spark, folder: str) -> DataFrame:
    return contaminated(C.table(spark, folder, "documents"), C.table(spark, folder, "benchmark"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents in which no benchmark item was found; null ids stay. Rows that repeat an id are told apart by text."""
    own = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("body")).alias("doc_id")
    found = contaminated(docs.filter("doc_id IS NOT NULL").select(own, "text"), benchmark)
    at, body = free_name("_id", docs.columns), free_name("_body", docs.columns)
    gone = found.select(F.col("doc_id.id").alias(at), F.col("doc_id.body").alias(body)).distinct()
    return docs.join(gone, (docs["doc_id"] == F.col(at)) & (F.xxhash64(docs["text"]) == F.col(body)), "left_anti")
