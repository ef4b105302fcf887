"""SimHash near-duplicates by a binary trie self-join.

The distinct fingerprints form a binary trie. Pairs of nodes of one depth are carried down from
the root together; a pair is dropped as soon as its prefixes differ in more bits than allowed.
Fingerprints within 3 bits differ in at most 1 bit in one of their halves, so the trie is walked
twice, once with the upper and once with the lower half first, and the budget is 1 bit within the
half that comes first and 3 bits in all. That keeps the number of node pairs near the number of
fingerprints. Every step is a Spark join on the parent prefix, so no task holds a group.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm import common as C
from labelloom.llm.components import component_ids
from labelloom.operators.scale import free_name, salted_join

RADIUS = 3
HOT_ROWS = 20_000
SHINGLE = 3
DEPTHS = (8, 16, 24, 32, 48, 64)


def fingerprints(docs: DataFrame, k: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, columns ``keep`` and ``fingerprint`` of every row: XXH64 of each k-word shingle votes with weight one.

    Null texts and texts without words get zero; repeated rows stay repeated.
    """
    own = ["doc_id", *keep]
    split = docs.select(
        F.monotonically_increasing_id().alias("row"), *own, C.words(C.ascii_lower(F.col("text"))).alias("w")
    )
    terms = split.select("row", *own, F.explode_outer(C.shingles(F.col("w"), k)).alias("s")).select(
        "row",
        *own,
        F.when(F.col("s.`0`").isNotNull(), F.xxhash64(F.concat_ws(" ", *C.parts("s", k)))).alias("h"),
    )
    return terms.groupBy("row", *own).agg(*C.votes(F.col("h"))).select(*own, C.fingerprint().alias("fingerprint"))


def _prefix(bits: Column, depth: int) -> Column:
    return F.shiftrightunsigned(bits, 64 - depth)


def _walk(nodes: DataFrame, radius: int) -> DataFrame:
    """Pairs ``(trie, x, y)`` of values within the radius whose first halves are within ``radius // 2``.

    ``nodes`` has ``trie, bits``; both tries are walked in the same joins.
    """
    pairs, above = None, 0
    for depth in DEPTHS:
        allowed = radius // 2 if depth <= 32 else radius
        step = nodes.select("trie", _prefix(F.col("bits"), depth).alias("node")).distinct()
        if pairs is None:  # the root's pairs: each of the few nodes asks for those that it may meet
            flips = [sum(1 << i for i in c) for n in range(allowed + 1) for c in itertools.combinations(range(depth), n)]
            asked = F.explode(F.transform(F.array(*[F.lit(f) for f in flips]), lambda f: F.col("a").bitwiseXOR(f)))
            left = step.select("trie", F.col("node").alias("a")).select("trie", "a", asked.alias("b"))
            found = left.join(step.withColumnRenamed("node", "b"), ["trie", "b"]).filter("a <= b")
        else:
            up = F.shiftrightunsigned("node", depth - above)
            left = step.select("trie", up.alias("x"), F.col("node").alias("a"))
            right = step.select(F.col("trie").alias("of"), up.alias("up"), F.col("node").alias("b"))
            same = (F.col("trie") == F.col("of")) & (F.col("y") == F.col("up"))
            found = pairs.join(left, ["trie", "x"]).join(right, same & _close("a", "b", allowed))
        pairs = found.select("trie", F.col("a").alias("x"), F.col("b").alias("y"))
        above = depth
    return pairs


def _close(a: str, b: str, allowed: int) -> Column:
    # a node is met with itself and with larger ones, compared as unsigned numbers
    ordered = F.col(a).bitwiseXOR(F.lit(-(1 << 63))) <= F.col(b).bitwiseXOR(F.lit(-(1 << 63)))
    return (C.distance(F.col(a), F.col(b)) <= allowed) & ordered


def trie_links(values: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All pairs ``(x, y)`` of different distinct ``fingerprint`` values within the radius, once each."""
    if not 0 <= radius <= 63:
        raise ValueError("radius must be between 0 and 63")
    turned = lambda c: F.shiftleft(c, 32).bitwiseOR(F.shiftrightunsigned(c, 32))
    bits = F.col("fingerprint")
    tries = F.array(F.struct(F.lit(0).alias("trie"), bits.alias("bits")), F.struct(F.lit(1).alias("trie"), turned(bits).alias("bits")))
    found = _walk(values.select(F.inline(tries)), radius).filter("x != y")
    back = lambda name: F.when(F.col("trie") == 0, F.col(name)).otherwise(turned(F.col(name)))
    both = found.select(back("x").alias("x"), back("y").alias("y"))
    return both.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def near_duplicates(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, columns ``keep``, ``fingerprint, n_links, component_id`` for every row of ``docs``.

    ``n_links`` counts the other distinct fingerprints within the radius. The component id is the
    smallest doc_id that links reach. A null doc_id gets a row but never names a component, unless
    all ids of it are null. A fingerprint of very many rows (copies, texts without words) is cut
    over several tasks when its rows learn their component.
    """
    prints = C.stored(fingerprints(docs, k, keep), "simhash")
    classes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("count"))
    classes = C.stored(classes, "simhash-classes")
    links = C.stored(trie_links(classes, radius), "simhash-links")
    ends = links.select(F.col("x").alias("fingerprint")).unionAll(links.select("y"))
    degree = ends.groupBy("fingerprint").agg(F.count("*").alias("n_links"))
    linked = component_ids(links, classes.select(F.col("fingerprint").alias("node"), F.col("first_id").alias("label")))
    known = (
        classes.join(linked.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
        .join(degree, "fingerprint", "left")
        .select(
            "fingerprint",
            F.coalesce("component", "first_id").alias("component_id"),
            F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        )
    )
    counts = classes.select("fingerprint", "count")
    named = salted_join(prints, known, ["fingerprint"], "inner", ["doc_id"], counts, HOT_ROWS)
    return named.select("doc_id", *keep, "fingerprint", "n_links", "component_id")


def query(spark, folder: str) -> DataFrame:
    found = near_duplicates(C.table(spark, folder, "documents"))
    return found.withColumn("fingerprint", C.hex16(F.col("fingerprint")))


def keep_first(docs: DataFrame) -> DataFrame:
    """Documents without near duplicates of smaller id, linked as in ``near_duplicates``.

    Rows that repeat both id and text go or stay together; those that repeat the id with another text
    are judged by their own text. Null ids stay.
    """
    at, body, of = (free_name(n, docs.columns) for n in ("_id", "_body", "_of"))
    hashed = docs.withColumn(body, F.xxhash64("text"))
    found = near_duplicates(hashed.select("doc_id", body, "text"), keep=(body,))
    gone = found.filter("doc_id != component_id").select(F.col("doc_id").alias(at), F.col(body).alias(of)).distinct()
    same = (F.col("doc_id") == F.col(at)) & (F.col(body) == F.col(of))
    return hashed.join(gone, same, "left_anti").select(*docs.columns)
