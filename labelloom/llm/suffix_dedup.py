"""Repeated byte strings found through two-stage suffix sorting.

Every byte covered by a string of ``least`` bytes that starts anywhere else is removed. Matches
stay within documents.

* Each distinct text picks anchors: the smallest ``GRAM``-byte hash of every string of ``least``
  bytes (winnowing). Equal strings have equal anchors at equal places, so equal starts meet by the
  anchor's hash. The starts with one anchor form a piece, which is described by its places and a
  hash of its bytes.
* Equal pieces are counted. What stands in two places is repeated as a whole.
* Different pieces of one anchor go to one task, many anchors to a block. A block's suffixes are
  sorted in two stages: those smaller than their successor directly, all others induced by
  scanning the buckets of first bytes. Neighbours with a common prefix of ``least`` bytes are
  repeated.
* An anchor with more than ``GROUP`` different pieces is cut before: its starts into ``FAN``
  ranges, each keyed by the bytes that all strings of the range share. That goes on down to
  ranges of one start, where the key is the whole string and counting decides. So no task ever
  holds more than ``GROUP`` pieces of a key, and none is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm import common as C
from labelloom.operators.scale import bucketed, free_name, salted_join, shuffle_tasks

LEAST = 400
GRAM = 64
GROUP = 256
FAN = 8
BLOCK_BYTES = 1 << 20
TASK_ROWS = 200_000  # rows of one key from which it is cut over several tasks
MIX = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64

PIECE = "key long, content long, body binary, anchor int, low int, high int, n long"


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2^64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    have = 1
    while have < n:
        step = np.uint64(pow(base, have, 1 << 64))
        more = min(have, n - have)
        out[have : have + more] = out[:more] * step
        have += more
    return out[:n]


class Hashes:
    """Hashes of all strings of ``GRAM`` bytes of a text, by powers that are kept from text to text."""

    def __init__(self):
        self.up = self.down = np.empty(0, np.uint64)

    def of(self, raw: np.ndarray, gram: int) -> np.ndarray:
        n = len(raw)
        if n > len(self.up):
            size = max(2 * len(self.up), n, 1 << 14)
            self.up, self.down = powers(BASE, size), powers(pow(BASE, -1, 1 << 64), size)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(MIX[raw] * self.up[:n], out=total[1:])
        found = (total[gram:] - total[:-gram]) * self.down[: n - gram + 1]
        found ^= found >> np.uint64(29)
        found *= np.uint64(0xBF58476D1CE4E5B9)
        return found ^ (found >> np.uint64(32))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours: minima of blocks from both ends."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(raw: np.ndarray, hashes: Hashes, least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last start of each piece of a text of at least ``least`` bytes."""
    grams = hashes.of(raw, gram)
    # 32 bits of hash, then the place: equal strings agree on the smallest, ties included
    packed = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    chosen = (sliding_min(packed, least - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    last = np.concatenate([first[1:], [len(chosen)]]) - 1
    return chosen[first], first, last


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def described(text: bytes, anchor: int, low: int, high: int, key: bytes, salt: int, least: int) -> tuple[int, int]:
    """Key and content of a piece: hashes of the bytes that its starts share, and of all its bytes by place."""
    whole = xxhash.xxh64_intdigest(text[low : high + least], seed=anchor - low)
    return signed(xxhash.xxh64_intdigest(key, seed=salt)), signed(whole)


def pieces(texts: DataFrame, least: int, gram: int) -> DataFrame:
    """The pieces of distinct texts ``(body, text, n)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Hashes()
        for batch in batches:
            rows = []
            for body, text, n in zip(batch["body"], batch["text"], batch["n"]):
                text = text.encode()
                if len(text) < least:
                    continue
                found = anchors(np.frombuffer(text, np.uint8), hashes, least, gram)
                for anchor, low, high in zip(*(x.tolist() for x in found)):
                    key, content = described(text, anchor, low, high, text[anchor : anchor + gram], 0, least)
                    rows.append((key, content, body, anchor, low, high, n))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in PIECE.split(", ")])

    return texts.mapInPandas(run, PIECE)


def fetched(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``body, text, wanted`` for the texts that hold wanted pieces; a text asks for its own pieces only."""
    one = F.struct("key", "content", "anchor", "low", "high", "n")
    lists = wanted.groupBy("body").agg(F.collect_list(one).alias("wanted"))
    return texts.select("body", "text").join(lists, "body")


def finer(texts: DataFrame, wanted: DataFrame, width: int, least: int) -> DataFrame:
    """Cut each piece into ranges of ``width`` starts, counted back from the anchor."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for body, text, asked in zip(batch["body"], batch["text"], batch["wanted"]):
                text = text.encode()
                for x in asked:
                    anchor, low, high = x["anchor"], x["low"], x["high"]
                    for part in range((anchor - high) // width, (anchor - low) // width + 1):
                        a, b = anchor - (part + 1) * width + 1, anchor - part * width
                        here = max(low, a), min(high, b)
                        shared = text[b : a + least]
                        key, content = described(text, anchor, *here, shared, part + 1, least)
                        rows.append((key, content, body, anchor, *here, x["n"]))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in PIECE.split(", ")])

    return fetched(texts, wanted).mapInPandas(run, PIECE)


def two_stage_sort(data: bytes, starts: np.ndarray, ends: np.ndarray, needed: np.ndarray) -> np.ndarray:
    """Sorted suffixes of the strings ``data[starts:ends]``, each followed by one byte that counts as its end.

    A suffix ends with its string, and an end is smaller than any byte. ``needed`` is the last
    place of each string whose suffix is asked for; those further on may be left out.
    """
    n = len(data)
    values = np.frombuffer(data, np.uint8).astype(np.int16) + 1
    values[ends] = 0
    change = np.flatnonzero(np.concatenate([values[1:] != values[:-1], [True]]))
    turn = change[np.searchsorted(change, np.arange(n))]  # the last place of each run of equal bytes
    small = values[turn] < values[np.minimum(turn + 1, n - 1)]  # smaller than its successor
    small[ends] = False

    string = np.zeros(n, np.int64)
    string[starts] = 1
    string = np.cumsum(string) - 1
    direct = np.flatnonzero(small)
    # what is asked for hangs from the first directly sorted suffix at or after it, or from the end
    after = np.searchsorted(direct, needed)
    stop = np.where(after < len(direct), direct[np.minimum(after, len(direct) - 1)] if len(direct) else 0, n)
    stop = np.minimum(stop, ends)
    direct = direct[direct <= stop[string[direct]]]
    upto = ends[string[direct]]
    keys = [data[i:e] for i, e in zip(direct.tolist(), upto.tolist())]
    direct = direct[sorted(range(len(keys)), key=keys.__getitem__)]
    del keys

    low = np.zeros(n + 1, bool)
    low[starts] = True
    buckets: list[list[np.ndarray]] = [[] for _ in range(257)]
    bounds = np.searchsorted(values[direct], np.arange(258))
    order = []
    hanging = ends[stop == ends]
    for c in range(257):
        if c:
            front = np.concatenate(buckets[c]) if buckets[c] else np.empty(0, np.int64)
            large = [front]
            while len(front):  # places before, in runs of the same byte
                front = front[~low[front]] - 1
                front = front[values[front] == c]
                large.append(front)
            whole = np.concatenate([*large, direct[bounds[c] : bounds[c + 1]]])
            order.append(whole)
        else:
            whole = hanging
        before = whole[~low[whole]] - 1
        first = values[before]
        before, first = before[first > c], first[first > c]
        if len(before):
            by = np.argsort(first, kind="stable")
            before, first = before[by], first[by]
            cuts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
            for at, until in zip(cuts.tolist(), [*cuts[1:].tolist(), len(before)]):
                buckets[int(first[at])].append(before[at:until])
        buckets[c] = []
    return np.concatenate(order) if order else np.empty(0, np.int64)


def common_prefixes(data: bytes, order: np.ndarray, until: np.ndarray) -> np.ndarray:
    """The common prefix of each sorted suffix with the one before it; ``until`` is each suffix's end.

    Where neighbours of one suffix are also the neighbours of the next place, the prefix is one
    byte shorter, so bytes are compared only where such a row begins.
    """
    n = len(data)
    lcp = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return lcp
    before = np.full(n + 1, -2, np.int64)
    before[order[1:]] = order[:-1]
    place = np.flatnonzero(before >= 0)
    raw = data + bytes(8)
    byte = np.frombuffer(raw, np.uint8)
    follows = (place[1:] == place[:-1] + 1) & (before[place[1:]] == before[place[:-1]] + 1)
    head = np.concatenate([[True], ~follows | (byte[place[:-1]] != byte[before[place[:-1]]])])
    a, b = place[head], before[place[head]]
    most = np.minimum(until[a] - a, until[b] - b)
    eight = np.ascontiguousarray(np.ndarray((n,), "<u8", raw, strides=(1,)))
    length, alive, depth = most.copy(), np.arange(len(a)), 0
    while len(alive):
        differ = eight[a[alive] + depth] ^ eight[b[alive] + depth]
        stop = differ != 0
        same = differ[stop]
        lowest = same & (~same + np.uint64(1))
        bits = np.log2(lowest.astype(np.float64)).astype(np.int64)
        ended = alive[stop]
        length[ended] = np.minimum(depth + bits // 8, most[ended])
        depth += 8
        alive = alive[~stop]
        alive = alive[most[alive] > depth]
    row = np.cumsum(head) - 1
    value = length[row] - (place - a[row])
    found = np.zeros(n, np.int64)
    found[place] = value
    lcp[1:] = found[order[1:]]
    return lcp


def repeated_starts(strings: list[bytes], counts: list[int], least: int) -> list[list[tuple[int, int]]]:
    """Of each string, the runs ``[first, last]`` of starts whose next ``least`` bytes start elsewhere in the block.

    ``counts`` says how many starts of a string, from its first, are asked for.
    """
    data = b"\xff".join(strings) + b"\xff"  # UTF-8 has no such byte
    sizes = np.array([len(s) for s in strings], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes[:-1] + 1)])
    ends = starts + sizes
    order = two_stage_sort(data, starts, ends, starts + np.array(counts) - 1)
    owner = np.searchsorted(starts, np.arange(len(data)), "right") - 1
    until = ends[owner]
    enough = common_prefixes(data, order, until) >= least
    hit = np.zeros(len(data) + 1, bool)
    hit[order[enough]] = True
    hit[order[np.flatnonzero(enough) - 1]] = True
    edges = np.flatnonzero(hit[1:] != hit[:-1]) + 1
    if hit[0]:
        edges = np.concatenate([[0], edges])
    out: list[list[tuple[int, int]]] = [[] for _ in strings]
    for low, high in zip(edges[0::2].tolist(), edges[1::2].tolist()):
        i = int(owner[low])
        out[i].append((low - int(starts[i]), high - 1 - int(starts[i])))
    return out


def sorted_blocks(texts: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """``body, low, stop`` of repeated bytes among different pieces of one key."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for body, text, asked in zip(batch["body"], batch["text"], batch["wanted"]):
                text = text.encode()
                for x in asked:
                    piece = text[x["low"] : x["high"] + least]
                    rows.append((x["key"], body, x["low"], x["high"] - x["low"] + 1, x["n"], piece))
            for at in range(0, len(rows), 5_000):
                yield pd.DataFrame(rows[at : at + 5_000], columns=["key", "body", "low", "starts", "n", "piece"])

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size, last = [], 0, None

        def done() -> pd.DataFrame:
            found = repeated_starts([r[4] for r in rows], [r[2] for r in rows], least)
            spans = [
                (r[0], r[1] + low, r[1] + high + least)
                for r, runs in zip(rows, found)
                if r[3] == 1  # a piece that stands in several places is repeated as a whole already
                for low, high in runs
            ]
            return pd.DataFrame(spans, columns=["body", "low", "stop"])

        for batch in batches:
            for key, *row in batch.itertuples(index=False):
                if key != last and size >= BLOCK_BYTES:
                    yield done()
                    rows, size = [], 0
                last = key
                rows.append(row)
                size += len(row[4])
        if rows:
            yield done()

    short = fetched(texts, wanted).mapInPandas(cut, "key long, body binary, low int, starts int, n long, piece binary")
    placed = short.repartition("key").sortWithinPartitions("key")
    return placed.mapInPandas(blocks, "body binary, low int, stop int")


def repeated_spans(texts: DataFrame, least: int = LEAST, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """``body, low, stop``: repeated bytes ``[low, stop)`` of the distinct texts ``(body, text, n)`` with ``n = 1``.

    The spans of a body may overlap. Texts with ``n > 1`` are repeated whole and only take part as
    partners.
    """
    rows = C.stored(pieces(texts, least, gram), "pieces")
    width, found = least - gram + 1, None
    while True:
        one = F.struct("body", "anchor", "low", "high")
        pairs = C.stored(
            rows.groupBy("key", "content").agg(F.sum("n").alias("n"), F.count("*").alias("rows"), F.min(one).alias("one")),
            "equal-pieces",
        )
        several = pairs.filter("n > 1").select("key", "content", "n")
        mine = rows.filter("n = 1").drop("n")
        per = pairs.filter("n > 1").select("key", "content", F.col("rows").alias("count"))
        whole = salted_join(mine, several.drop("n"), ["key", "content"], "inner", ["body", "low"], per, TASK_ROWS)
        spans = whole.select("body", "low", (F.col("high") + least).alias("stop"))
        keys = C.stored(
            pairs.groupBy("key").agg(F.count("*").alias("pieces")).filter("pieces > 1"), "shared-anchors"
        )
        few, many = keys.filter(F.col("pieces") <= group), keys.filter(F.col("pieces") > group)
        flat = pairs.select("key", "content", "n", "one.*")
        sorting = C.stored(flat.join(few.select("key"), "key", "left_semi"), "to-sort")
        spans = spans.unionByName(sorted_blocks(texts, sorting, least))
        found = spans if found is None else found.unionByName(spans)
        if width == 1 or many.isEmpty():
            return found
        width = -(-width // FAN)
        crowded = flat.join(many.select("key"), "key", "left_semi")
        rows = C.stored(finer(texts, crowded, width, least), "finer-pieces")


def without(raw: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, str, bytes]:
    """Bytes removed, maximal removed runs, and hash and bytes of what stays."""
    kept, at, removed, runs = [], 0, 0, 0
    for low, stop in sorted(spans):
        if stop <= at:
            continue
        if low > at or not runs:
            kept.append(raw[at:low])
            runs += 1
        removed += stop - max(low, at)
        at = stop
    rest = b"".join([*kept, raw[at:]])
    return removed, runs, hashlib.sha256(rest).hexdigest(), rest


def remove_repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """All columns of ``docs`` and ``repeats``: ``n_bytes, n_removed, n_spans, kept_sha256, kept`` of ``text``.

    ``kept`` holds the bytes that stay. Null texts count as empty; rows that repeat a text are
    copies of each other, whatever their ids, and texts of at least ``least`` bytes that stand
    twice go whole. Ids are not looked at, and other columns may have any names but ``repeats``.
    """
    if not 8 <= gram < least:
        raise ValueError("gram must be at least 8 and below least")
    name = free_name("_body", docs.columns)
    text = F.coalesce(F.col("text"), F.lit(""))
    long = docs.select(F.unhex(F.md5(text)).alias("body"), text.alias("text")).filter(F.octet_length("text") >= least)
    tasks = shuffle_tasks(docs.sparkSession)
    texts = bucketed(
        long.repartition(tasks, "body").groupBy("body").agg(F.min("text").alias("text"), F.count("*").alias("n")),
        "body", tasks, "distinct-texts",
    )
    lists = repeated_spans(texts, least, gram, group).groupBy("body").agg(F.collect_list(F.struct("low", "stop")).alias("spans"))

    @F.pandas_udf("n_removed long, n_spans long, kept_sha256 string, kept binary")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = [without(text.encode(), [(x["low"], x["stop"]) for x in found]) for text, found in zip(texts, spans)]
        return pd.DataFrame(out, columns=["n_removed", "n_spans", "kept_sha256", "kept"])

    made = ["n_removed", "n_spans", "kept_sha256", "kept"]
    touched = texts.select("body", "text").join(lists, "body").select("body", cut("text", "spans").alias("found"))
    copies = texts.filter("n > 1").select(
        "body",
        F.octet_length("text").cast("long").alias("n_removed"),
        F.lit(1).cast("long").alias("n_spans"),
        F.sha2(F.lit(b""), 256).alias("kept_sha256"),
        F.lit(b"").alias("kept"),
    )
    results = touched.select("body", *[F.col(f"found.{m}").alias(m) for m in made]).unionByName(copies)
    results = results.select(F.col("body").alias(name), *[F.col(m).alias(f"{name}_{m}") for m in made])
    # what the text is asked for is taken before the join, so that no text is moved that isn't returned
    keyed = docs.withColumns(
        {
            name: F.unhex(F.md5(text)),
            f"{name}_bytes": F.octet_length(text).cast("long"),
            f"{name}_sha256": F.sha2(text.cast("binary"), 256),
        }
    )
    counts = docs.select(F.unhex(F.md5(text)).alias(name)).groupBy(name).count()
    joined = salted_join(keyed, results, [name], "left", counts=counts, task_rows=TASK_ROWS)
    without_match = {"n_removed": F.lit(0), "n_spans": F.lit(0), "kept_sha256": F.col(f"{name}_sha256"), "kept": text.cast("binary")}
    repeats = F.struct(
        F.col(f"{name}_bytes").alias("n_bytes"),
        *[F.coalesce(F.col(f"{name}_{m}"), other).alias(m) for m, other in without_match.items()],
    )
    return joined.withColumn("repeats", repeats).select(*docs.columns, "repeats")


def query(spark, folder: str) -> DataFrame:
    done = remove_repeats(C.table(spark, folder, "documents").select("doc_id", "text"))
    return done.select("doc_id", "repeats.n_bytes", "repeats.n_removed", "repeats.n_spans", "repeats.kept_sha256")
