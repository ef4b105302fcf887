"""Token counts by the whole-token shortcut.

A sentencepiece BPE model writes a space as U+2581 and, in the models accepted here, has no piece
in which that mark follows another character. So no merge crosses from a word into the space after
it, and a text's count is the sum over its space-separated words. Vocabulary strings that the
library itself encodes alone as one token are known beforehand and count 1; only other words are
merged, each distinct one once while the bounded memory of a worker lasts.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "▁"
REMEMBERED_WORDS = 400_000


@functools.lru_cache(maxsize=2)
def load(path: str):
    """The model and the words that are one token by themselves."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(MARK in piece.lstrip(MARK) for piece in pieces):
        raise ValueError("a piece of this model reaches across a space")
    return model, whole_words(model, pieces)


def whole_words(model, pieces: list[str]) -> frozenset[str]:
    """Words whose encoding is one token, found by encoding every vocabulary string."""
    candidates = [p[1:] for p in pieces if p.startswith(MARK) and len(p) > 1 and MARK not in p[1:]]
    return frozenset(w for w, ids in zip(candidates, model.encode(candidates, num_threads=1)) if len(ids) == 1)


class Counter:
    def __init__(self, path: str, remembered: int = REMEMBERED_WORDS):
        self.model, self.whole = load(path)
        self.remembered = remembered
        self.known = dict.fromkeys(self.whole, 1)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if text[0] == " " or text[-1] == " " or "  " in text or MARK in text:
            return len(self.model.encode(text))
        words = text.split(" ")
        rest = set(words).difference(self.known)
        if rest:
            if len(self.known) + len(rest) > self.remembered:
                self.known = dict.fromkeys(self.whole, 1)
                rest = set(words).difference(self.known)
            self.known.update((word, len(self.model.encode(word))) for word in rest)
        return sum(map(self.known.__getitem__, words))


def token_count(text: Column, model_path: str) -> Column:
    """Tokens of a text as the library counts them; null and the empty text have none."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(model_path)
        for texts in batches:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")

    return count(text)


def count_tokens(docs, model_path: str, limit: int = 4096):
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` for every row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        F.octet_length(text).cast("long").alias("n_bytes"),
        token_count(text, model_path).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
