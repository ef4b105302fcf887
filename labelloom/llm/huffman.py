"""Token ids as canonical length-limited Huffman codes.

The code is made from the counts of all ids (package-merge, at most ``LIMIT`` bits a code) and
written as code lengths only; codes of one length are numbered in order of ids. A block holds whole
documents in ascending doc_id order. Each document begins on a byte, and a checkpoint, the bit at
which decoding can begin, is kept for every ``STRIDE`` ids of it, so blocks and stretches of blocks
are decoded independently, all stretches of a block side by side through one table.

Layout of a written folder: ``lengths`` (id, bits) and ``blocks`` (bucket, block, doc_ids, counts,
checkpoints, payload; little-endian 64-bit numbers in the first three), both Parquet.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelloom.llm import common as C
from labelloom.llm import token_ids
from labelloom.operators.scale import scratch_path, shuffle_tasks

LIMIT = 18
STRIDE = 1024
BLOCK_BYTES = 1 << 20
END_ID = 0


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for ids that don't occur."""
    ids = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(ids) <= 1:
        lengths[ids] = 1
        return lengths
    if len(ids) > 1 << limit:
        raise ValueError(f"{len(ids)} ids don't fit codes of {limit} bits")
    ids = ids[np.argsort(counts[ids], kind="stable")]
    weight = counts[ids].astype(np.float64)
    packages, single = np.empty(0), []
    for _ in range(limit):
        merged = np.concatenate([weight, packages])
        order = np.argsort(merged, kind="stable")
        single.append(order < len(weight))
        merged = merged[order]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    need, depth = 2 * len(ids) - 2, np.zeros(len(ids), np.uint8)
    for row in reversed(single):
        symbols = int(row[:need].sum())
        depth[:symbols] += 1
        need = 2 * (need - symbols)
    lengths[ids] = depth
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes of given lengths: shorter ones first, equal lengths in order of ids."""
    codes = np.zeros(len(lengths), np.uint64)
    code, before = 0, 0
    for bits in range(1, int(lengths.max(initial=0)) + 1):
        code <<= bits - before
        before = bits
        ids = np.flatnonzero(lengths == bits)
        codes[ids] = code + np.arange(len(ids), dtype=np.uint64)
        code += len(ids)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For every run of ``width`` bits the id that it begins with and that id's code length."""
    width = max(1, int(lengths.max(initial=0)))
    ids = np.flatnonzero(lengths)
    ids = ids[np.lexsort((ids, lengths[ids]))]
    repeat = 1 << (width - lengths[ids].astype(np.int64))
    symbol, size = np.repeat(ids.astype(np.uint32), repeat), np.repeat(lengths[ids], repeat)
    rest = (1 << width) - len(symbol)  # only a single code leaves bits without an id
    return np.pad(symbol, (0, rest)), np.pad(size, (0, rest), constant_values=1), width


def encode(documents: list[np.ndarray], lengths: np.ndarray, codes: np.ndarray) -> list[tuple[bytes, bytes]]:
    """Payload and checkpoints (bits from the payload's start) of each document."""
    counts = np.array([len(d) for d in documents], np.int64)
    ids = np.concatenate(documents) if len(documents) else np.empty(0, np.uint32)
    if not len(ids):
        return [(b"", b"")] * len(documents)
    bits = lengths[ids].astype(np.int64)
    ends = np.cumsum(bits)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    upto = np.concatenate([[0], ends])
    used = upto[first + counts] - upto[first]
    size = (used + 7) // 8
    byte = np.concatenate([[0], np.cumsum(size)])
    shift = np.repeat(byte[:-1] * 8 - upto[first], counts)
    at = ends - bits + shift
    word = at >> 5
    value = codes[ids] << (64 - (at & 31) - bits).astype(np.uint64)
    new = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out = np.zeros(int(byte[-1]) // 4 + 3, np.uint64)
    out[word[new]] += np.add.reduceat(value >> np.uint64(32), new)
    out[word[new] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), new)
    payload = out.astype(">u4").tobytes()
    result = []
    for d in range(len(documents)):
        marks = at[first[d] : first[d] + counts[d] : STRIDE] - byte[d] * 8
        result.append((payload[byte[d] : byte[d + 1]], marks.astype("<i8").tobytes()))
    return result


def decode(payload: bytes, checkpoints: np.ndarray, counts: np.ndarray, table: tuple) -> np.ndarray:
    """Ids of stretches that begin at the checkpoints and have so many ids, one after another."""
    symbol, size, width = table
    raw = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    order = np.argsort(-counts, kind="stable")
    left, at = counts[order], checkpoints[order].copy()
    out = np.zeros((len(order), int(counts.max(initial=0))), np.uint32)
    alive = np.searchsorted(-left, -np.arange(out.shape[1]), side="left")  # stretches longer than each step
    for step, n in enumerate(alive):
        here = at[:n]
        key = (window[here >> 3] << (here & 7).astype(np.uint32)) >> np.uint32(32 - width)
        out[:n, step] = symbol[key]
        here += size[key]
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    out = out[back]
    return out[np.arange(out.shape[1])[None, :] < counts[:, None]]


def tokenized(docs: DataFrame, files: tuple, end_id: int = END_ID) -> DataFrame:
    """``doc_id, ids``: the text's ids and the end id as little-endian numbers, 16 bits where that is enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = token_ids.encoder(*files)
        short = encoder.tokenizer.get_vocab_size() <= 1 << 16
        end = np.array([end_id], encoder.dtype).tobytes()
        for batch in batches:
            ids = [encoder.encode(t) + end for t in batch["text"]]
            if short:
                ids = [np.frombuffer(x, encoder.dtype).astype("<u2").tobytes() for x in ids]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "ids": ids, "wide": not short})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        run, "doc_id long, ids binary, wide boolean"
    )


def _numbers(ids: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(ids, "<u4" if wide else "<u2").astype(np.uint32)


def id_counts(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs in the whole table: counted per task, then summed; one number per id comes back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids, wide in zip(batch["ids"], batch["wide"]):
                numbers = _numbers(ids, wide)
                if numbers.size:
                    found = np.bincount(numbers, minlength=len(total))
                    found[: len(total)] += total
                    total = found
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"id": seen, "n": total[seen]})

    rows = tokens.select("ids", "wide").mapInPandas(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max([r["id"] for r in rows], default=-1) + 1, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return counts


def write(docs: DataFrame, path: str, files: tuple | None = None, limit: int = LIMIT) -> None:
    """Encode all rows of ``docs`` into the folder ``path``, ascending by doc_id, null ids first."""
    spark = docs.sparkSession
    tokens = C.stored(tokenized(docs, files or token_ids.public_files()), "token-ids")
    lengths = code_lengths(id_counts(tokens), limit)
    codes = canonical(lengths)
    used = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(used, "id long, bits int").coalesce(1).write.parquet(f"{path}/lengths")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                numbers = [_numbers(i, w) for i, w in zip(part["ids"], part["wide"])]
                payload, marks = zip(*encode(numbers, lengths, codes))
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].astype("Int64").array,
                        "n": [len(x) for x in numbers],
                        "payload": payload,
                        "checkpoints": marks,
                    }
                )

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size, bucket, number = [], 0, None, 0

        def block() -> pd.DataFrame:
            ids, counts, payload, marks = zip(*rows)
            starts = np.cumsum([0, *map(len, payload)])[:-1] * 8
            bits = [np.frombuffer(m, "<i8") + s for m, s in zip(marks, starts)]
            known = [-(1 << 63) if pd.isna(i) else int(i) for i in ids]
            return pd.DataFrame(
                {
                    "bucket": [bucket],
                    "block": [number],
                    "doc_ids": [np.array(known, "<i8").tobytes()],
                    "counts": [np.array(counts, "<i8").tobytes()],
                    "checkpoints": [np.concatenate(bits).astype("<i8").tobytes()],
                    "payload": [b"".join(payload)],
                }
            )

        for batch in batches:
            for b, doc_id, n, payload, marks in zip(
                batch["bucket"], batch["doc_id"], batch["n"], batch["payload"], batch["checkpoints"]
            ):
                if rows and (b != bucket or size >= BLOCK_BYTES):
                    yield block()
                    rows, size, number = [], 0, number + 1 if b == bucket else 0
                elif bucket != b:
                    number = 0
                bucket = b
                rows.append((doc_id, n, payload, marks))
                size += len(payload)
        if rows:
            yield block()

    coded = tokens.mapInPandas(run, "doc_id long, n long, payload binary, checkpoints binary")
    count = shuffle_tasks(spark)
    cuts = tokens.agg(F.percentile_approx("doc_id", [i / count for i in range(1, count)] or [0.5], 10_000)).first()[0]
    borders = F.array(*[F.lit(c).cast("long") for c in sorted(set(cuts or []))])
    bucket = F.size(F.filter(borders, lambda c: c <= F.col("doc_id"))) if cuts else F.lit(0)
    placed = coded.withColumn("bucket", bucket).repartition(count, "bucket")
    placed = placed.sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), F.crc32("payload"), "payload")
    kinds = "bucket int, block int, doc_ids binary, counts binary, checkpoints binary, payload binary"
    placed.mapInPandas(blocks, kinds).write.option("compression", "none").parquet(f"{path}/blocks")


def read_lengths(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/lengths").collect()
    lengths = np.zeros(max([r["id"] for r in rows], default=-1) + 1, np.uint8)
    for r in rows:
        lengths[r["id"]] = r["bits"]
    return lengths


def block_ids(row, table: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, their numbers of ids, and all ids of a block."""
    doc_ids, counts = np.frombuffer(row.doc_ids, "<i8"), np.frombuffer(row.counts, "<i8")
    stretches = (counts + STRIDE - 1) // STRIDE
    last = np.cumsum(stretches)
    each = np.full(int(stretches.sum()), STRIDE, np.int64)
    full = stretches > 0
    each[last[full] - 1] = counts[full] - (stretches[full] - 1) * STRIDE
    return doc_ids, counts, decode(row.payload, np.frombuffer(row.checkpoints, "<i8"), each, table)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in a written folder."""
    table = decode_table(read_lengths(spark, path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                doc_ids, counts, ids = block_ids(row, table)
                raw = memoryview(ids.astype("<u4").tobytes())
                ends = np.cumsum(counts)
                frame = pd.DataFrame({"bucket": row.bucket, "block": row.block, "doc_id": doc_ids, "within": ends - counts})
                frame["n_tokens"] = counts
                frame["ids_crc32"] = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends, counts)]
                yield frame

    kinds = "bucket int, block int, doc_id long, within long, n_tokens long, ids_crc32 long"
    rows = C.stored(spark.read.parquet(f"{path}/blocks").mapInPandas(run, kinds), "decoded")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("bucket", "block").agg(F.sum("n_tokens").alias("n"))
    inner = sums.withColumn("b", F.coalesce(F.sum("n").over(before(Window.partitionBy("bucket").orderBy("block"))), F.lit(0)))
    # one row per bucket, of which there are as many as shuffle partitions
    outer = sums.groupBy("bucket").agg(F.sum("n").alias("n")).select(
        "bucket", F.coalesce(F.sum("n").over(before(Window.orderBy("bucket"))), F.lit(0)).alias("a")
    )
    base = inner.join(outer, "bucket").select("bucket", "block", (F.col("a") + F.col("b")).alias("base"))
    return rows.join(base, ["bucket", "block"]).select(
        F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")).alias("doc_id"),
        (F.col("base") + F.col("within")).alias("start"),
        "n_tokens",
        "ids_crc32",
    )


def query(spark, folder: str) -> DataFrame:
    path = scratch_path(spark, "huffman")
    write(C.table(spark, folder, "documents"), path)
    return read(spark, path)
