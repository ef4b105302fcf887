"""Token ids of whole texts with a byte-level BPE of the tokenizers library.

A text is cut before each space that follows a non-space; the tokenizer's own rules cut there too,
so the ids of the parts, joined, are those of the text. Parts repeat a lot, so a worker remembers them in
two generations of bounded size: what was used while the younger one filled up outlives the older
one, and parts met once are soon forgotten. Those not remembered are encoded in one call for each text, and
told apart in its ids by the tokens' lengths in bytes. A text with the string of a special token is encoded in one go.
"""

from __future__ import annotations

import base64
import functools
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np

REMEMBERED_PARTS = 120_000
LONG_PART = 400
SPACE_AFTER_SPACE = re.compile(r"\s ")
BEFORE_SPACES = re.compile(r"(?<=\S)(?= )")
LATIN = "ɐ"  # letters below this one belong to the same class in every Unicode version since 5
BEYOND = re.compile(f"[{LATIN}-\U0010ffff]")


def _packed(ids: list[int]) -> bytes:
    numbers = array("I", ids)
    if sys.byteorder != "little":
        numbers.byteswap()
    return numbers.tobytes()


class Encoder:
    """``encode`` gives a text's ids as little-endian numbers of ``dtype``, without added tokens.

    ``ranks`` may name the same vocabulary as a rank file; short Latin parts then go through the
    faster library, which was proven equal on them by a test.
    """

    dtype = np.dtype("<u4")

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None, remembered: int = REMEMBERED_PARTS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.remembered = remembered
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.quick = None
        self.widths = np.zeros(0, np.int64)
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
            self.widths = np.zeros(max(table.values()) + 1, np.int64)
            for token, rank in table.items():
                self.widths[rank] = len(token)

    def _is_quick(self, part: str) -> bool:
        return self.quick is not None and len(part) < LONG_PART and (part.isascii() or max(part) < LATIN)

    def _ids(self, part: str) -> bytes:
        if self._is_quick(part):
            return _packed(self.quick.encode_ordinary(part))
        return _packed(self.tokenizer.encode(part, add_special_tokens=False).ids)

    def _ids_of_each(self, parts: list[str]) -> Iterator[tuple[str, bytes]]:
        """The ids of each part with a space before it; no part ends in white space."""
        if self.quick is None or not parts:
            yield from ((p, self._ids(" " + p)) for p in parts)
            return
        joined = " " + " ".join(parts)
        if len(max(parts, key=len)) + 1 >= LONG_PART or BEYOND.search(joined):
            yield from ((p, self._ids(" " + p)) for p in parts if not self._is_quick(" " + p))
            yield from self._ids_of_each([p for p in parts if self._is_quick(" " + p)])
            return
        ids = np.array(self.quick.encode_ordinary(joined), self.dtype)
        lengths = map(len, parts) if joined.isascii() else [len(p.encode()) for p in parts]
        upto = np.cumsum(np.fromiter(lengths, np.int64, len(parts)) + 1)
        ends = (4 * (np.searchsorted(np.cumsum(self.widths[ids]), upto) + 1)).tolist()
        raw = ids.tobytes()
        yield from zip(parts, [raw[a:b] for a, b in zip([0, *ends], ends)])

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if SPACE_AFTER_SPACE.search(text):
            return b"".join(map(self._ids, BEFORE_SPACES.split(text)))
        first, *parts = text.split(" ")
        new = set(parts).difference(self.known)
        if new:
            if len(self.known) + len(new) > self.remembered:
                self.known, self.older = {}, self.known
                new = set(parts)
            older = self.older
            self.known.update((part, older[part]) for part in new if part in older)
            new = new.difference(older)
            last = parts[-1]
            if last in new and last[-1:].isspace():  # would run on into the next one's space
                new.remove(last)
                self.known[last] = self._ids(" " + last)
            self.known.update(self._ids_of_each(list(new)))
        return (self._ids(first) if first else b"") + b"".join(map(self.known.__getitem__, parts))


@functools.lru_cache(maxsize=1)
def encoder(path: str, ranks: str | None = None, pattern: str | None = None) -> Encoder:
    """A worker's own encoder, kept from one batch to the next."""
    return Encoder(path, ranks, pattern)


def public_files() -> tuple[str, str, str]:
    """Vocabulary, ranks and word pattern of the 50k byte-level BPE."""
    import public_tokenizers

    return (
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )
