"""Suffix-array dedup against brute force over all strings of the given length."""

import collections
import hashlib
import random

import pytest

from labelloom.llm import suffix_dedup


def brute(texts, least):
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[i : i + least] for r in raws for i in range(len(r) - least + 1))
    out = []
    for r in raws:
        gone = set()
        for i in range(len(r) - least + 1):
            if seen[r[i : i + least]] > 1:
                gone.update(range(i, i + least))
        kept = bytes(b for i, b in enumerate(r) if i not in gone)
        spans = sum(1 for i in gone if i - 1 not in gone)
        out.append((len(r), len(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def some_texts(seed, alphabet, many):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, base = prose(12), prose(40)
    texts = [None, "", "short", base, base, "ü" * 70, "x" * 90, "ab" * 60, shared, shared + shared, "日本語のテキスト" * 9]
    for _ in range(many):
        kind = rng.random()
        if kind < 0.5:  # one passage in ever new surroundings
            texts.append(prose(rng.randint(0, 6)) + shared + prose(rng.randint(0, 6)))
        elif kind < 0.8:  # near copies
            at = rng.randrange(len(base))
            texts.append(base[:at] + word() + base[at + rng.randint(0, 3) :])
        else:
            texts.append(prose(rng.randint(1, 30)))
    return texts


@pytest.mark.parametrize("least, gram, group", [(24, 8, 2), (40, 8, 4), (60, 16, 2_000)])
def test_removed_bytes_equal_brute_force(spark, least, gram, group):
    for seed, alphabet in [(1, "abcdefgé日"), (2, "ab")]:
        texts = some_texts(seed, alphabet, 60)
        rows = [(i if i % 7 else None, t, "x", i) for i, t in enumerate(texts)]  # null ids too
        docs = spark.createDataFrame(rows, "doc_id long, text string, _body string, at int").repartition(3)
        got = {r["at"]: r.repeats for r in suffix_dedup.remove_repeats(docs, least, gram, group).collect()}
        for i, want in enumerate(brute(texts, least)):
            r = got[i]
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) == want, (seed, i)


def test_two_stage_sort_orders_all_suffixes():
    import numpy as np

    rng = random.Random(5)
    for alphabet in (b"a", b"ab", b"abcdefgh"):
        for _ in range(60):
            strings = [bytes(rng.choice(alphabet) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 5))]
            sizes = np.array([len(s) for s in strings])
            starts = np.concatenate([[0], np.cumsum(sizes[:-1] + 1)])
            data, ends = b"\xff".join(strings) + b"\xff", starts + sizes
            order = suffix_dedup.two_stage_sort(data, starts, ends, ends - 1)
            of = [int(np.searchsorted(starts, i, "right")) - 1 for i in order]
            suffixes = [data[i : ends[k]] for i, k in zip(order, of)]
            assert len(set(order.tolist())) == sizes.sum() and suffixes == sorted(suffixes)
            found = suffix_dedup.common_prefixes(data, order, np.array([ends[np.searchsorted(starts, i, "right") - 1] for i in range(len(data))]))
            for a, b, n in zip(suffixes, suffixes[1:], found[1:]):
                assert a[:n] == b[:n] and (len(a) == n or len(b) == n or a[n] != b[n])


def test_empty_table_and_wrong_sizes(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(empty).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(empty, least=20, gram=30)
