"""Texts in blocks, for work in which every token of every text meets a table.

The texts are dealt out in blocks of a bounded size. A block numbers its own tokens, so a token
meets the table once for each block that has it and not once for each place where it stands; what
was found goes back to the block as one array, and the texts themselves stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import words
from .scale import bucketed, free_name

BLOCK_BYTES = 256 * 1024 * 1024
CHUNK = 1 << 22  # numbers of a block that are worked on at a time

# What a block keeps of its texts: from the keys of all rows, the codes of all tokens, and where
# each row's codes begin and end, to batches that have further columns.
Shape = Callable[[pa.Table, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]]


@dataclass
class Blocks:
    """``texts (block, keys, ...)`` in buckets by block, ``dictionary (block, code, token)``, and the blocks' numbers."""

    texts: DataFrame
    dictionary: DataFrame
    numbers: list[int]


def apart(spark: SparkSession, n: int) -> list[int]:
    """``n`` numbers of which a hash partitioning in ``n`` parts puts one in each."""
    part = F.pmod(F.hash("id"), F.lit(n))
    found = spark.range(40 * n).groupBy(part.alias("part")).agg(F.min("id").alias("id")).collect()
    some = [r.id for r in found]
    return some + [40 * n + i for i in range(n - len(some))]


def binaries(numbers: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary value for each stretch ``offsets[i]`` to ``offsets[i + 1]`` of the numbers."""
    ends = (offsets * numbers.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(numbers))])


def numbers_of(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column one after another, and the offsets of its rows."""
    size = np.dtype(kind).itemsize
    parts, ends = [np.empty(0, kind)], [np.zeros(1, np.int64)]
    for chunk in column.chunks:
        offsets = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1].astype(np.int64)
        if len(chunk) and offsets[-1] > offsets[0]:
            parts.append(np.frombuffer(chunk.buffers()[2], kind, (offsets[-1] - offsets[0]) // size, offsets[0]))
        ends.append((offsets[1:] - offsets[:1]) // size + ends[-1][-1])
    return (parts[1] if len(parts) == 2 else np.concatenate(parts)), np.concatenate(ends)


def pieces(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Rows ``[a, b)`` after one another, each with at most so many numbers unless it is one row."""
    a, rows = 0, len(offsets) - 1
    while a < rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, rows)
        a = b


def in_order(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of ``codes`` that begin at ``starts``, one after another."""
    ends = np.cumsum(lengths)
    return codes[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


def groups(keys: pa.Table) -> np.ndarray:
    """A number for each row, the same for rows that are equal in all columns (nulls are)."""
    out = np.zeros(keys.num_rows, np.int64)
    for column in keys.columns:
        codes = pc.dictionary_encode(column, null_encoding="encode").combine_chunks().indices.to_numpy()
        out = np.unique(out * (int(codes.max(initial=0)) + 1) + codes, return_inverse=True)[1]
    return out


def sequences(keys: pa.Table, codes: np.ndarray, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each row with the ``codes`` of its tokens in their order."""
    for a, b in pieces(offsets):
        part = keys.slice(a, b - a).combine_chunks()
        bounds = offsets[a : b + 1]
        data = binaries(codes[bounds[0] : bounds[-1]].astype(np.int32), bounds - bounds[0])
        yield from part.append_column("codes", data).to_batches()


def text_blocks(
    df: DataFrame,
    keys: list[str],
    by: list[str],
    tokens: Column | None = None,
    shape: Shape = sequences,
    kept: dict[str, T.DataType] | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> Blocks:
    """Blocks of about ``block_bytes`` of text; rows with equal ``by`` columns share one.

    ``tokens`` is the array of a row's tokens (by default the words of ``text``); null tokens are
    left out. ``kept`` names the columns that ``shape`` makes; those of ``sequences`` are ``codes``.
    """
    spark = df.sparkSession
    # Python workers started in another folder find this package too
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    tasks = spark.sparkContext.defaultParallelism
    total = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-max(total // block_bytes + 1, 1) // tasks) * tasks
    known = apart(spark, blocks)
    kept = kept or {"codes": T.BinaryType()}
    fields = [T.StructField(k, kept.get(k, df.schema[k].dataType)) for k in keys]
    made = [T.StructField(k, t) for k, t in kept.items() if k not in keys]
    own = [T.StructField("block", T.LongType()), T.StructField("code", T.IntegerType()), T.StructField("token", T.StringType())]
    schema = T.StructType([*fields, *made, *own])
    column = free_name("_tokens", keys)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId()
        block = known[place] if place < len(known) else 100 * len(known) + place
        rows, coded, lengths = [], [], []
        for batch in batches:
            lists = batch.column(column)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
            offsets -= offsets[0]
            if flat.null_count:
                offsets = np.concatenate([[0], np.cumsum(flat.is_valid().to_numpy(zero_copy_only=False))])[offsets]
                flat = flat.drop_null()
            coded.append(pc.dictionary_encode(flat))
            lengths.append(np.diff(offsets))
            rows.append(batch.select(keys))
        if not rows:
            return
        whole = pa.chunked_array(coded).unify_dictionaries()
        tokens = whole.chunk(0).dictionary
        codes = np.concatenate([c.indices.to_numpy() for c in whole.chunks])
        coded.clear()
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
        for batch in shape(pa.Table.from_batches(rows), codes, offsets):
            n = batch.num_rows
            other = [pa.array(np.full(n, block)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *other], schema.names)
            kinds = [c.type for c in batch.columns]
        for at in range(0, len(tokens), CHUNK // 64):
            part = tokens.slice(at, CHUNK // 64)
            n = len(part)
            empty = [pa.nulls(n, t) for t in kinds]
            code = pa.array(np.arange(at, at + n, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*empty, pa.array(np.full(n, block)), code, part.cast(pa.string())], schema.names)

    split = df.select(*keys, (words(F.col("text")) if tokens is None else tokens).alias(column))
    dealt = split.repartition(blocks, *by).mapInArrow(number, schema)
    table = bucketed(dealt, "block", blocks, "text-blocks")
    texts = table.filter(F.col("code").isNull()).select("block", *keys, *[f.name for f in made])
    return Blocks(texts, table.filter(F.col("code").isNotNull()).select("block", "code", "token"), known)


def met(blocks: Blocks, found: DataFrame, work: Callable, schema: str | T.StructType) -> DataFrame:
    """What ``work`` makes of each block's texts and its rows of ``found``, both as Arrow tables."""
    # under another name, since both sides may come from one table
    found = found.withColumn("block", F.col("block") + 0).withColumnRenamed("block", "_of")
    return blocks.texts.groupBy("block").cogroup(found.groupBy("_of")).applyInArrow(work, schema)
