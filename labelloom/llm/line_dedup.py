"""Line dedup by winnowing.

A document is a row of units: its lines, and within a line its sentences, so that a passage inside
a long line is found too. Units without words don't count. A window is the shortest row of units
with ``WINDOW_WORDS`` words that begins, or ends, at a unit; every repeated stretch of that many
words is made of such windows.

* The smallest unit hash of every window is a fingerprint. Equal windows have it at equal places,
  so no repeated window is missed, and only as many places are kept as there are fingerprints.
  The units of all windows with one fingerprint are its reach.
* Places are moved once, to meet by fingerprint; most stand alone and go no further. All but the
  first of equal reaches, by doc_id and place, are later repeats as a whole. Fingerprints with so
  many places that they would burden a task are counted first and joined with hot keys salted.
* Different reaches of one fingerprint meet in one task. From the common unit each match is
  extended both ways; where it has enough words, the later one of the two is deleted.
* A fingerprint with over ``GROUP`` different reaches, a very common short line, is told apart by
  whole windows instead: they are hashed, and all but the first of equal ones are deleted.

What is deleted always has an equal unit earlier on, so the first copy of every unit stays.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelloom.llm import common as C
from labelloom.operators.scale import bucketed, free_name, salted_join, shuffle_tasks

WINDOW_WORDS = 8
GROUP = 256
HOT_ROWS = 20_000
LOTS = 1 << 16
BREAK = re.compile(r"(\n|(?<=[.!?]) +)")


def cut(text: str) -> tuple[list[str], list[str]]:
    """Units and what follows each."""
    if "  " not in text and "\0" not in text:  # every break is one character, no expression is needed
        marked = text.replace("\n", "\0\n").replace(". ", ".\0 ").replace("! ", "!\0 ").replace("? ", "?\0 ")
        first, *others = marked.split("\0")
        return [first, *[x[1:] for x in others]], [*[x[0] for x in others], ""]
    pieces = BREAK.split(text)
    return pieces[0::2], [*pieces[1::2], ""]


def unit_codes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash and number of words of each unit with words."""
    if "  " not in text and text.replace("\n", "").isprintable():  # no white space but single spaces and line ends
        lines = text.replace(". ", ".\n").replace("! ", "!\n").replace("? ", "?\n").split("\n")
        units = [unit for unit in [line.strip(" ") for line in lines] if unit]
        codes = [xxhash.xxh64_intdigest(unit) for unit in units]
        return np.array(codes, np.uint64), np.array([unit.count(" ") + 1 for unit in units], np.int64)
    codes, sizes = [], []
    for unit in cut(text)[0]:
        words = unit.split()
        if words:
            codes.append(xxhash.xxh64_intdigest(" ".join(words)))
            sizes.append(len(words))
    return np.array(codes, np.uint64), np.array(sizes, np.int64)


def winnow(codes: np.ndarray, sizes: np.ndarray, counts: np.ndarray, least: int = WINDOW_WORDS) -> np.ndarray:
    """Rows ``place, start, stop`` of the fingerprints of several texts whose units stand one after another.

    ``counts`` has each text's number of units. A fingerprint is the smallest code of a window, the
    first of equal ones; from ``start`` to ``stop`` reach the windows that have it.
    """
    upto = np.cumsum(counts)
    first, last = np.repeat(upto - counts, counts), np.repeat(upto, counts)
    total = np.concatenate([[0], np.cumsum(sizes)])
    places = np.arange(len(sizes))
    ends = np.searchsorted(total, total[:-1] + least)  # windows that begin at a unit
    starts = np.searchsorted(total, total[1:] - least, "right") - 1  # windows that end at one
    some, more = ends <= last, starts >= first
    begin, end = np.concatenate([places[some], starts[more]]), np.concatenate([ends[some], places[more] + 1])
    if not len(begin):
        return np.empty((0, 3), np.int64)
    both = np.unique(begin << 32 | end)
    begin, end = both >> 32, both & 0xFFFFFFFF
    order = np.argsort(codes, kind="stable")
    rank = np.empty(len(codes) + 1, np.int64)
    rank[order], rank[-1] = places, len(codes)
    smallest = order[np.minimum.reduceat(rank, np.column_stack([begin, end]).ravel())[::2]]
    head = np.flatnonzero(np.concatenate([[True], smallest[1:] != smallest[:-1]]))
    tail = np.concatenate([head[1:], [len(smallest)]]) - 1
    return np.column_stack([smallest[head], begin[head], end[tail]])


Reach = tuple[list[int], list[int], int]  # codes, sizes, place of the fingerprint among them


def stretch(later: Reach, earlier: Reach) -> tuple[int, int, int]:
    """Units ``[start, stop)`` of the later reach that equal the earlier one's around the fingerprint, and their words."""
    (a, sizes, p), (b, _, q) = later, earlier
    start, stop = p, p + 1
    while start > 0 and start - 1 - p + q >= 0 and a[start - 1] == b[start - 1 - p + q]:
        start -= 1
    while stop < len(a) and stop - p + q < len(b) and a[stop] == b[stop - p + q]:
        stop += 1
    return start, stop, sum(sizes[start:stop])


def joined(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same places in stretches that neither overlap nor touch."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(found):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def without(text: str, gone: list[tuple[int, int]]) -> tuple[str, int]:
    """The text without the units of those places, and their number."""
    delete = {i for start, end in gone for i in range(start, end)}
    out, place, removed, last = [], 0, 0, False
    for unit, after in zip(*cut(text)):
        if unit and not unit.isspace():
            last = place in delete
            place += 1
            if last:
                removed += 1
                continue
        out.append(unit + after)
    kept = "".join(out)
    return (kept.rstrip() if last else kept), removed


def windows(sizes: np.ndarray, least: int = WINDOW_WORDS) -> list[tuple[int, int]]:
    """The shortest stretches ``[start, end)`` of at least so many words that begin, or that end, at a unit.

    Every unit of a longer stretch lies in one of these that the stretch holds whole. In order of
    starts, their ends are in order too.
    """
    total = np.concatenate([[0], np.cumsum(sizes)])
    places = np.arange(len(sizes))
    ends = np.searchsorted(total, total[:-1] + least)
    starts = np.searchsorted(total, total[1:] - least, "right") - 1
    some, more = ends <= len(sizes), starts >= 0
    both = {*zip(places[some].tolist(), ends[some].tolist()), *zip(starts[more].tolist(), (places[more] + 1).tolist())}
    return sorted(both)


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


PLACE = "code long, reach long, doc_id long, place int, start int, stop int"


def repeats(places: DataFrame, crowd: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """``doc_id, start, stop`` of reaches that stand earlier too, and ``code, n, doc_id, place, start, stop``
    of the first place of each reach, for fingerprints with ``n > 1`` different ones.

    Fingerprints are counted in ``LOTS`` lots by their hash. No lot that is grouped by a plain window
    holds more than ``crowd`` places beyond twice a lot's share, so neither does any fingerprint.
    The numbers of the crowded lots, fewer than half of all, come to the driver.
    """
    lots = places.withColumn("lot", F.pmod("code", F.lit(LOTS)))
    sizes = C.stored(lots.groupBy("lot").agg(F.count("*").alias("size")), "lots")
    limit = crowd + 2 * (sizes.agg(F.sum("size")).first()[0] or 0) / LOTS
    crowded = [row.lot for row in sizes.filter(F.col("size") > limit).select("lot").collect()]
    alike = Window.partitionBy("code", "reach").orderBy("doc_id", "place")
    met = (
        lots.filter(~F.col("lot").isin(crowded)).drop("lot").repartition("code")
        .withColumn("nth", F.row_number().over(alike))
        .withColumn("n", F.sum(F.when(F.col("nth") == 1, 1)).over(Window.partitionBy("code")))
        .filter("nth > 1 OR n > 1")
        .drop("reach")
    )
    met = C.stored(met, "met-places")
    later = met.filter("nth > 1").select("doc_id", "start", "stop")
    firsts = met.filter("nth = 1").select("code", "n", "doc_id", "place", "start", "stop")
    if not crowded:
        return later, firsts
    many = lots.filter(F.col("lot").isin(crowded)).drop("lot")
    one = F.struct("doc_id", "place", "start", "stop")
    equal = C.stored(many.groupBy("code", "reach").agg(F.count("*").alias("count"), F.min(one).alias("first")), "equal-reaches")
    several = equal.filter("count > 1")
    first = several.select("code", "reach", F.col("first.doc_id").alias("from_id"), F.col("first.place").alias("from_place"))
    counts = several.select("code", "reach", "count")
    again = salted_join(many, first, ["code", "reach"], "inner", ["doc_id", "place"], counts, HOT_ROWS)
    shared = C.stored(equal.groupBy("code").agg(F.count("*").alias("n")).filter("n > 1"), "shared-fingerprints")
    return (
        later.unionByName(again.filter("doc_id != from_id OR place != from_place").select("doc_id", "start", "stop")),
        firsts.unionByName(equal.select("code", "first.*").join(shared, "code")),
    )


def deleted_stretches(docs: DataFrame, least: int = WINDOW_WORDS, group: int = GROUP, crowd: int = HOT_ROWS) -> DataFrame:
    """``doc_id, body, gone`` where ``body`` is a hash of the text and ``gone`` lists stretches of units."""
    # A unit with that many words is a window by itself, so no larger size need be told apart.
    width = np.min_scalar_type(least).newbyteorder("<")

    def _of(codes: bytes, sizes: bytes) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(codes, "<u8"), np.frombuffer(sizes, width).astype(np.int64)

    def units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            both = [unit_codes(t) for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "body": batch["body"],
                    "codes": [c.astype("<u8").tobytes() for c, _ in both],
                    "sizes": [np.minimum(n, least).astype(width).tobytes() for _, n in both],
                }
            )

    def prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = b"".join(batch["codes"])
            codes, sizes = _of(raw, b"".join(batch["sizes"]))
            counts = np.array([len(c) // 8 for c in batch["codes"]], np.int64)
            found = winnow(codes, sizes, counts, least)
            owner = np.repeat(np.arange(len(counts)), counts)[found[:, 0]]
            within = found - (np.cumsum(counts) - counts)[owner][:, None]
            keys = [xxhash.xxh64_intdigest(raw[8 * a : 8 * b], seed=p - a) for p, a, b in found.tolist()]
            if keys:
                yield pd.DataFrame(
                    {
                        "code": codes[found[:, 0]].view(np.int64),
                        "reach": np.array(keys, np.uint64).view(np.int64),
                        "doc_id": batch["doc_id"].to_numpy()[owner],
                        **{c: within[:, i].astype(np.int32) for i, c in enumerate(("place", "start", "stop"))},
                    }
                )

    def reaches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, raw, sizes, asked in zip(batch["doc_id"], batch["codes"], batch["sizes"], batch["asked"]):
                for x in asked:
                    a, b = x["start"], x["stop"]
                    wide = width.itemsize
                    rows.append((x["code"], doc_id, x["place"], a, raw[8 * a : 8 * b], sizes[wide * a : wide * b]))
            yield pd.DataFrame(rows, columns=["code", "doc_id", "place", "start", "codes", "sizes"])

    def extended(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, before = None, defaultdict(list)
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                p = r.place - r.start
                codes, sizes = np.frombuffer(r.codes, "<u8").tolist(), np.frombuffer(r.sizes, width).tolist()
                mine, beside = (codes, sizes, p), [(i, codes[i + p]) for i in (-1, 1) if 0 <= i + p < len(codes)]
                if r.code != code:
                    code, before = r.code, defaultdict(list)
                elif sizes[p] >= least:  # enough with any place before
                    rows.append((r.doc_id, r.place, r.place + 1))
                # only where a unit beside the common one is equal too can a match be longer
                for other in (other for at in beside for other in before.get(at, ())):
                    start, stop, words = stretch(mine, other)
                    if words >= least:
                        rows.append((r.doc_id, r.start + start, r.start + stop))
                        if stop - start == len(codes):
                            break
                for at in beside:
                    before[at].append(mine)
            yield pd.DataFrame(rows, columns=["doc_id", "start", "stop"])

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                for a, b in windows(_of(r.codes, r.sizes)[1], least):
                    if a <= r.place - r.start < b:
                        rows.append((signed(xxhash.xxh64_intdigest(r.codes[8 * a : 8 * b])), r.doc_id, r.start + a, r.start + b))
            yield pd.DataFrame(rows, columns=["window", "doc_id", "start", "stop"])

    def join_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [joined([(x["start"], x["stop"]) for x in spans]) for spans in batch["spans"]]
            spans = [[{"start": start, "stop": stop} for start, stop in x] for x in found]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "body": batch["body"], "gone": spans})

    known = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("body"), "text"
    )
    made = known.mapInPandas(units, "doc_id long, body long, codes binary, sizes binary")
    tasks = shuffle_tasks(docs.sparkSession)
    one_each = made.repartition(tasks, "doc_id").groupBy("doc_id").agg(F.min(F.struct("body", "codes", "sizes")).alias("x"))
    cutted = bucketed(one_each.select("doc_id", "x.*"), "doc_id", tasks, "units")
    places = C.stored(cutted.select("doc_id", "codes", "sizes").mapInPandas(prints, PLACE), "winnowed")
    spans, firsts = repeats(places, crowd)

    def wanted(asked: DataFrame) -> DataFrame:
        lists = asked.groupBy("doc_id").agg(F.collect_list(F.struct("code", "place", "start", "stop")).alias("asked"))
        kinds = "code long, doc_id long, place int, start int, codes binary, sizes binary"
        return cutted.select("doc_id", "codes", "sizes").join(lists, "doc_id").mapInPandas(reaches, kinds)

    met = wanted(firsts.filter(F.col("n") <= group)).repartition("code").sortWithinPartitions("code", "doc_id", "place")
    spans = spans.unionByName(met.mapInPandas(extended, "doc_id long, start int, stop int"))
    crowded = firsts.filter(F.col("n") > group)
    if not crowded.isEmpty():
        whole = C.stored(wanted(crowded).mapInPandas(hashed, "window long, doc_id long, start int, stop int"), "whole-windows")
        best = whole.groupBy("window").agg(F.count("*").alias("count"), F.min(F.struct("doc_id", "start", "stop")).alias("first"))
        best = C.stored(best.filter("count > 1"), "first-windows")
        origin = best.select("window", F.col("first.doc_id").alias("from_id"), F.col("first.start").alias("from_start"))
        later = salted_join(whole, origin, ["window"], "inner", ["doc_id", "start"], best.select("window", "count"), HOT_ROWS)
        spans = spans.unionByName(later.filter("doc_id != from_id OR start != from_start").select("doc_id", "start", "stop"))
    lists = spans.groupBy("doc_id").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    gone = cutted.select("doc_id", "body").join(lists, "doc_id")
    return gone.mapInPandas(join_up, "doc_id long, body long, gone array<struct<start: int, stop: int>>")


def dedup_lines(docs: DataFrame, least: int = WINDOW_WORDS) -> DataFrame:
    """All columns of ``docs`` with later repeated stretches cut from ``text``, and ``_removed`` units.

    ``doc_id`` is a whole number; other columns may have any names but ``_removed``. Null texts and
    rows with a null doc_id are left as they are. Rows that repeat both id and text are one
    document and stay alike; of rows that repeat the id with other texts the one with the smallest
    text hash takes part and the others are left as they are.
    """
    stretches = deleted_stretches(docs, least)
    at, body, gone, own, rest_of = (free_name(n, docs.columns) for n in ("_id", "_body", "_gone", "_hash", "_rest"))
    stretches = stretches.select(F.col("doc_id").alias(at), F.col("body").alias(body), F.col("gone").alias(gone))

    @F.pandas_udf("text string, removed int")
    def rest(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(
            [
                (t, 0) if s is None or t is None else without(t, [(x["start"], x["stop"]) for x in s])
                for t, s in zip(text, spans)
            ],
            columns=["text", "removed"],
        )

    matched = docs.withColumn(own, F.xxhash64("text")).join(
        stretches, (F.col("doc_id") == F.col(at)) & (F.col(own) == F.col(body)), "left"
    )
    touched = F.col(gone).isNotNull()  # only these texts travel to Python
    cleaned = matched.withColumn(rest_of, rest(F.when(touched, F.col("text")), F.col(gone)))
    text = F.when(touched, F.col(f"{rest_of}.text")).otherwise(F.col("text"))
    return cleaned.withColumns({"text": text, "_removed": F.col(f"{rest_of}.removed")}).select(*docs.columns, "_removed")


def query(spark, folder: str) -> DataFrame:
    docs = C.table(spark, folder, "documents").select("doc_id", "text")
    return dedup_lines(docs).withColumnRenamed("_removed", "n_removed")


def keep_lines(docs: DataFrame) -> DataFrame:
    """Documents without later repeated stretches; a document of which nothing stays goes."""
    cleaned = dedup_lines(docs).filter("text IS NULL OR _removed = 0 OR text RLIKE '\\\\S'")
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*docs.columns)
