"""Words, previews and fixed-length token arrays as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAD_ID = 0
UNKNOWN_ID = 1

# The characters that separate words (Unicode white space and four control characters).
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"


def words(text: Column) -> Column:
    """Whitespace-separated words of the whole text; blank text gives an empty array."""
    return F.array_remove(F.split(text, WHITESPACE), "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def preview(text: Column, length: int = 200) -> Column:
    """The text, or its first ``length`` characters and three dots when it is longer."""
    cut = F.concat(F.substring(text, 1, length), F.lit("..."))
    return F.when(F.length(text) > length, cut).otherwise(text)


def truncate_pad(ids: Column, max_length: int = 128, pad: int = PAD_ID) -> Column:
    """Exactly ``max_length`` ids: cut on the right, or filled up with the padding id."""
    filler = F.array_repeat(F.lit(pad).cast("long"), max_length)
    return F.slice(F.concat(ids, filler), 1, max_length)


def pad_blocks(ids: Column, block: int = 128, pad: int = PAD_ID) -> Column:
    """All ids, filled up with the padding id to full blocks; no ids give one block of padding."""
    missing = F.when(F.size(ids) == 0, block).otherwise(F.pmod(-F.size(ids), F.lit(block)))
    return F.concat(ids, F.array_repeat(F.lit(pad).cast("long"), missing))


def attention_mask(ids: Column, pad: int = PAD_ID) -> Column:
    """1 where the id is not the padding id, else 0: decided by value, not by position."""
    return F.transform(ids, lambda i: F.when(i != pad, 1).otherwise(0))


def last_valid(ids: Column, mask: Column | None = None) -> Column:
    """The element at the last masked-in position; the final element without any."""
    if mask is None:
        return F.element_at(ids, -1)
    valid = F.aggregate(mask, F.lit(0), lambda total, m: total + m)
    return F.element_at(ids, F.when(valid == 0, -1).otherwise(valid))
