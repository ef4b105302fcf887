"""Vocabulary, token ids and batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import hash_key
from ..functions.text import UNKNOWN_ID, attention_mask, truncate_pad, words
from .blocks import groups, met, numbers_of, pieces, text_blocks
from .scale import TASK_ROWS, number, running, spread, store

# Sequence length and batch size.
MAX_LENGTH = 128
BATCH_SIZE = 32

Tokenizer = Callable[[Column], Column]


def exploded_tokens(df: DataFrame, words: str = "w") -> DataFrame:
    """One row per element of the array column, as ``token``.

    The outer form with a filter after it: for the inner one Spark adds a check that the array is
    not empty below it, and so would split every text twice.
    """
    others = [c for c in df.columns if c != words]
    return df.select(*others, F.explode_outer(words).alias("token")).filter(F.col("token").isNotNull())


def token_counts(df: DataFrame, by: list[str] | None = None, tokenize: Tokenizer = words) -> DataFrame:
    """Occurrences ``n`` of each token of ``text``; counted where the rows lie, then merged."""
    by = by or []
    return exploded_tokens(df.select(*by, tokenize(F.col("text")).alias("w"))).groupBy(*by, "token").agg(
        F.count("*").alias("n")
    )


def build_vocab(
    df: DataFrame,
    min_frequency: int = 1,
    max_size: int | None = None,
    tokenize: Tokenizer = words,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """``(token, token_id, n)`` of all tokens, the commonest first; ids from 2, after padding and unknown.

    ``min_frequency`` and ``max_size`` leave out rare tokens on request. More than ``task_rows``
    tokens are numbered in several tasks. The vocabulary is stored, since encoding and scoring read
    it again and again.
    """
    counted = token_counts(df, tokenize=tokenize).filter(F.col("n") >= min_frequency)
    numbered = number(store(counted, "token-counts"), [F.col("n").desc(), F.col("token")], "_nth", task_rows)
    if max_size is not None:
        numbered = numbered.filter(F.col("_nth") <= max_size)
    return store(numbered.select("token", (F.col("_nth") + UNKNOWN_ID).alias("token_id"), "n"), "vocabulary")


def encode(
    df: DataFrame,
    vocab: DataFrame,
    id_column: str = "id",
    keep: list[str] | None = None,
    max_tokens: int | None = None,
    tokenize: Tokenizer = words,
) -> DataFrame:
    """``input_ids`` of each text: the ids of its tokens in order, unknown tokens as 1.

    ``max_tokens`` cuts each text before its tokens are looked up. The vocabulary meets the tokens
    of each block of texts once, so neither a row per token nor a hot token is ever shuffled.
    """
    keys = [id_column, *(keep or [])]
    tokens = tokenize(F.col("text"))
    if max_tokens is not None:
        tokens = F.slice(tokens, 1, max_tokens)
    blocks = text_blocks(df, keys, keys, tokens)
    known = vocab.select("token", F.col("token_id").cast("long").alias("token_id"))
    known = blocks.dictionary.join(known, "token").select("block", "code", "token_id")

    def look_up(texts: pa.Table, known: pa.Table) -> pa.Table:
        codes, offsets = numbers_of(texts["codes"], "<i4")
        found = np.full(int(codes.max(initial=0)) + 1, UNKNOWN_ID, np.int64)
        found[known["code"].to_numpy()] = known["token_id"].to_numpy()
        group, rows = groups(texts.select(keys)), texts.select(keys)
        if len(group) and group.max() + 1 < len(group):  # rows that repeat a key make one text, place by place
            lengths = np.diff(offsets)
            place = np.arange(len(codes)) - np.repeat(offsets[:-1], lengths)
            whose = np.repeat(group, lengths)
            codes = codes[np.lexsort((found[codes], place, whose))]
            rows = rows.take(pa.array(np.unique(group, return_index=True)[1]))
            offsets = np.concatenate([[0], np.cumsum(np.bincount(whose, minlength=rows.num_rows))])
        parts = []
        for a, b in pieces(offsets):
            bounds = offsets[a : b + 1]
            ids = pa.ListArray.from_arrays(pa.array((bounds - bounds[0]).astype(np.int32)), pa.array(found[codes[bounds[0] : bounds[-1]]]))
            parts.append(rows.slice(a, b - a).append_column("input_ids", ids))
        return pa.concat_tables(parts)

    schema = T.StructType([*[T.StructField(k, df.schema[k].dataType) for k in keys], T.StructField("input_ids", T.ArrayType(T.LongType()))])
    return met(blocks, known, look_up, schema)


def encode_fixed(
    df: DataFrame,
    vocab: DataFrame,
    id_column: str = "id",
    keep: list[str] | None = None,
    max_length: int = MAX_LENGTH,
    tokenize: Tokenizer = words,
) -> DataFrame:
    """``input_ids`` cut or padded to ``max_length``, and their ``attention_mask``."""
    ids = encode(df, vocab, id_column, keep, max_length, tokenize)
    padded = ids.withColumn("input_ids", truncate_pad(F.col("input_ids"), max_length))
    return padded.withColumn("attention_mask", attention_mask(F.col("input_ids")))


def make_batches(
    df: DataFrame, batch_size: int = BATCH_SIZE, shuffle: bool = True, epoch: int = 0, id_column: str = "id"
) -> DataFrame:
    """Add ``batch_id`` within each split; the last batch may be short.

    With ``shuffle`` the rows of train come in an order of their own for each ``epoch``; the other
    splits always go by id.
    """
    key = hash_key(F.col(id_column), f"shuffle:{epoch}") if shuffle else F.lit(0)
    keyed = df.withColumn("_key", F.when(F.col("split") == "train", key).otherwise(0))
    order = ["_key", id_column]
    placed = running(spread(keyed, ["split"], order), ["split"], order, {"_nth": (F.sum, F.lit(1), True)})
    return placed.withColumn("batch_id", F.floor((F.col("_nth") - 1) / batch_size)).select(*df.columns, "batch_id")
