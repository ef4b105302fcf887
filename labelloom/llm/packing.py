"""Best-fit packing of token sequences.

Pieces of one length are alike to the packer: a piece asks for tokens (its length), one document
place and attention cost (its length squared). So the packer works on the number of pieces of each
length, at most one number per length, and places many at once: of all kinds of partly filled
sequences that can take the piece under every capacity it takes the one with the smallest weighted
residual norm afterwards. Its result is a list of ranges "pieces n to m of length l go to sequences
s to s + m - n at offset o", whose size depends on the number of lengths and not on the data. The
pieces are numbered per length and get their place by a join with the ranges.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelloom.llm import common as C
from labelloom.llm import token_ids

CAPACITY = 2048
END_ID = 0
WEIGHTS = (1.0, 1e-6, 1e-9)
PIECES = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
)
RANGES = "length long, rank_from long, rank_to long, sequence_from long, offset long"


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: only the first may be shorter than the capacity."""
    first = n % capacity
    return ([first] if first else []) + [capacity] * (n // capacity)


def pieces(docs: DataFrame, files: tuple, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece, with its number among its task's pieces of that length (``part``, ``nth``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode = token_ids.encoder(*files).encode
        end = np.array([end_id], token_ids.Encoder.dtype).tobytes()
        seen: dict[int, int] = {}
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = encode(text) + end
                start = 0
                for piece, length in enumerate(cut_lengths(len(ids) // 4, capacity)):
                    crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])
                    nth = seen.get(length, 0)
                    seen[length] = nth + 1
                    rows.append((doc_id, piece, start, length, crc, part, nth))
                    start += length
            frame = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, PIECES)


def plan(
    counts: dict[int, int],
    capacity: int = CAPACITY,
    max_documents: int | None = None,
    max_attention: int | None = None,
    weights: tuple[float, float, float] = WEIGHTS,
) -> list[tuple[int, int, int, int, int]]:
    """Ranges ``(length, rank_from, rank_to, sequence_from, offset)`` for so many pieces of each length.

    Longest first. A kind of open sequence is (tokens left, documents left, attention left) and a
    list of runs of sequence numbers. The best kind leaves the smallest weighted norm of what is
    left; as tokens weigh far more than the rest, kinds are searched by tokens left upwards.
    """
    max_documents = capacity if max_documents is None else max_documents
    max_attention = capacity * capacity if max_attention is None else max_attention
    open_kinds: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
    order: list[tuple[float, tuple[int, int, int]]] = []
    ranges, made = [], 0

    def norm(kind: tuple[int, int, int]) -> float:
        return sum(w * x * x for w, x in zip(weights, kind))

    def put(kind: tuple[int, int, int], first: int, n: int) -> None:
        if kind not in open_kinds:
            open_kinds[kind] = []
            bisect.insort(order, (norm(kind), kind))
        open_kinds[kind].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank, cost = counts[length], 0, length * length
        if length > capacity or cost > max_attention:
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        while left:
            # best residual after placing; the least weighted norm among all kinds that can take it
            best = None
            at = bisect.bisect_left(order, (weights[0] * length * length, (0, 0, 0)))
            for _, kind in order[at:]:
                if kind[0] >= length and kind[1] >= 1 and kind[2] >= cost:
                    best = kind
                    break
            if best is None:
                per = min(capacity // length, max_documents, max_attention // cost if cost else max_documents)
                n, best = -(-left // max(per, 1)), (capacity, max_documents, max_attention)
                put(best, made, n)
                made += n
            first, n = open_kinds[best].pop()
            take = min(n, left)
            if n > take:
                open_kinds[best].append((first + take, n - take))
            elif not open_kinds[best]:
                del open_kinds[best]
                order.pop(bisect.bisect_left(order, (norm(best), best)))
            ranges.append((length, rank, rank + take, first, capacity - best[0]))
            rest = (best[0] - length, best[1] - 1, best[2] - cost)
            if rest[0] and rest[1]:
                put(rest, first, take)
            left -= take
            rank += take
    return ranges


def place(found: DataFrame, capacity: int = CAPACITY, **limits) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored ``pieces``."""
    spark = found.sparkSession
    per_task = found.groupBy("length", "part").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).select("length", "part", "base")
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    ranges = spark.createDataFrame(plan(counts, capacity, **limits), RANGES)
    ranked = found.join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("nth"))
    r = F.broadcast(ranges).alias("r")
    inside = (F.col("p.length") == F.col("r.length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    return ranked.alias("p").join(r, inside).select(
        "doc_id",
        "piece",
        "start",
        "p.length",
        "ids_crc32",
        (F.col("sequence_from") + F.col("rank") - F.col("rank_from")).alias("sequence_id"),
        "offset",
    )


def pack(docs: DataFrame, files: tuple | None = None, capacity: int = CAPACITY, **limits) -> DataFrame:
    """Cut, number and place all rows of ``docs``; ``max_documents`` and ``max_attention`` may limit a sequence.

    Null texts are empty and have the end id alone. Rows with repeated or null ids are packed one by one.
    """
    found = C.stored(pieces(docs, files or token_ids.public_files(), capacity), "pieces")
    return place(found, capacity, **limits)


def query(spark, folder: str) -> DataFrame:
    return pack(C.table(spark, folder, "documents"))
