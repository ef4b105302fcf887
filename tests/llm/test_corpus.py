"""The corpus operators against brute force, on texts chosen to be awkward."""

import collections
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from labelloom.llm import (
    chat,
    common,
    components,
    decontaminate,
    fingerprints,
    huffman,
    licenses,
    line_dedup,
    packing,
    quality,
    simhash_dedup,
    token_counts,
    token_ids,
)

WORDS = [f"{a}{b}" for a in "the quick brown Über naïve 123 don't x".split() for b in ("", "s", "ing", "é", ",")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = prose(rng, 60)
    return [
        None, "", " ", "\n\n", "a", " a  b ", "tab\tand\nline", "<|endoftext|> in text", "</s>[INST] ok \\<", "▁mark ▁ x",
        "   three   spaces", "日本語のテキスト", "x" * 3000, base, base, base + " more", prose(rng, 3000), prose(rng, 700), "Kelvin MIT",
        *[prose(rng, rng.randint(1, 80)) for _ in range(30)],
    ]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "here", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, h long").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("doc_id < 0")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_token_counts(docs, texts, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = by_id(token_counts.count_tokens(docs, path, limit=100))
    for i, text in enumerate(texts):
        assert got[i].n_tokens == len(model.encode(text or "")) and got[i].n_bytes == len((text or "").encode())
        assert got[i].over_limit == (got[i].n_tokens > 100)
    assert token_counts.count_tokens(empty, path).count() == 0
    counter = token_counts.Counter(path, remembered=len(token_counts.load(path)[1]) + 5)
    assert [counter.count(t) for t in texts] == [len(model.encode(t or "")) for t in texts]


def test_token_ids_of_odd_characters():
    encoder = token_ids.Encoder(*token_ids.public_files(), remembered=50)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for c in [*map(chr, range(0x250)), " ", "　", "日", "\U0001f600"]:
        for form in ("a{}b", "{}", "a {} b", " {}{} a{}", "1{}2 {}x"):
            text = form.replace("{}", c)
            assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_fingerprints(docs, texts, empty):
    for buckets in (1, 4):
        got = by_id(fingerprints.edited_fingerprints(docs, buckets))
        assert len(got) == len(texts)
        for i, text in enumerate(texts):
            after = (i + 1) % len(texts)
            n, row = len(text or ""), got[i]
            edited = (text or "")[: n - n // 4] + (texts[after] or "")[: n // 4]
            import hashlib

            assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and row.n_chars == n
            alike = lambda a, b: 1 - ((a ^ b) & (2**64 - 1)).bit_count() / 64
            assert row.near_edited == alike(row.fingerprint, row.edited_fingerprint)
            assert row.near_next == alike(row.fingerprint, got[after].fingerprint)
        assert got[13].fingerprint == got[14].fingerprint and got[0].fingerprint == 0
    assert fingerprints.edited_fingerprints(empty).count() == 0


def test_fingerprints_of_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "n"), (1, "b b"), (1, "a a"), (1, "a a")], "doc_id long, text string")
    got = fingerprints.edited_fingerprints(df, 3).collect()
    assert collections.Counter(r.doc_id for r in got) == {None: 1, 1: 3}


def near_values(rng, n):
    values = [rng.getrandbits(64) for _ in range(n)]
    for v in values[: n // 2]:
        for bits in range(5):
            values.append(v ^ sum(1 << b for b in rng.sample(range(64), bits)))
    return sorted({v - 2**64 if v >> 63 else v for v in [*values, 0, 2**64 - 1, 1, 1 << 63]})


def test_hamming_searches_find_all_pairs(spark):
    values = near_values(random.Random(5), 40)
    df = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    close = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3
    want = {(a, b) for a in values for b in values if a < b and close(a, b)}
    links = simhash_dedup.trie_links(df).collect()
    assert len(links) == len(want) and {(r.x, r.y) for r in links} == want
    found = fingerprints.within_radius(df, df).collect()
    assert len(found) == len({(r.query, r.value) for r in found})
    assert {(r.query, r.value) for r in found} == want | {(b, a) for a, b in want} | {(v, v) for v in values}


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    edges = sorted({(min(e), max(e)) for e in edges if e[0] != e[1]})
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    links = spark.createDataFrame(edges, "x long, y long")
    labels = spark.createDataFrame([(a,) for a in root], "node long").withColumn("label", F.col("node"))
    got = {r.node: r.component for r in components.component_ids(links, labels).collect()}
    assert got == {a: find(a) for a in root}


def test_near_duplicates(docs, texts, empty):
    got = by_id(simhash_dedup.near_duplicates(docs))
    for i, text in enumerate(texts):
        words = [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if w]
        runs = [b" ".join(words[j : j + 3]) for j in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert got[i].fingerprint & (2**64 - 1) == want
    assert got[14].component_id == 13 and {got[i].component_id for i in (0, 1, 2, 3)} == {0}
    kept = {r.doc_id for r in simhash_dedup.keep_first(docs).collect()}
    assert kept == {r.component_id for r in got.values()}
    assert simhash_dedup.near_duplicates(empty).count() == 0


def test_rows_of_a_repeated_id_are_judged_by_their_own_text(spark):
    rng = random.Random(6)
    one, two, three = (prose(rng, 80) for _ in range(3))
    rows = [(1, one), (2, two), (2, two), (5, one), (5, three), (7, None), (8, ""), (None, one)]
    kept = simhash_dedup.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, one), (2, two), (2, two), (5, three), (7, None), (None, one)], key=str)


def test_chat_round_trip(spark, texts):
    rng = random.Random(2)
    rows = []
    for conv in range(12):
        for turn in range(rng.randint(1, 7)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", None, "<t>"]), rng.choice([*texts, chat.PROBE])))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    back = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    examples = chat.format_turns(df).collect()
    for conv in range(12):
        said = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        assert [(t.role, t.text) for t in back[conv].turns] == said
        assert back[conv].losses == [t for r, t in said if r == "assistant"]
        assert back[conv].formatted_chars == sum(len(e.formatted) for e in examples if e.conv_id == conv)
    assert chat.format_turns(df.filter("conv_id < 0")).count() == 0


def test_huffman_code_is_optimal_and_limited():
    rng = np.random.default_rng(4)
    counts = (rng.pareto(0.5, 500) * 10).astype(np.int64)
    lengths = huffman.code_lengths(counts, 30)
    import heapq

    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    assert int((lengths.astype(int) * counts).sum()) == cost
    short = huffman.code_lengths(counts, 10)
    assert short.max() <= 10 and sum(2.0 ** -int(x) for x in short if x) <= 1 and ((short > 0) == (counts > 0)).all()
    for table in (lengths[:0], huffman.code_lengths(np.array([0, 7])), short):
        if not len(table):
            continue
        ids = [np.array(rng.choice(np.flatnonzero(table), n), np.uint32) for n in (0, 1, 5000, 1024)]
        coded = huffman.encode(ids, table, huffman.canonical(table))
        for x, (payload, marks) in zip(ids, coded):
            marks = np.frombuffer(marks, "<i8")
            each = np.array([min(huffman.STRIDE, len(x) - huffman.STRIDE * k) for k in range(len(marks))], np.int64)
            if len(x):
                assert (huffman.decode(payload, marks, each, huffman.decode_table(table)) == x).all()


def test_huffman_files(spark, docs, texts, empty, tmp_path):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    huffman.write(docs, str(tmp_path / "ids"))
    got, start = by_id(huffman.read(spark, str(tmp_path / "ids"))), 0
    for i, text in enumerate(texts):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    huffman.write(empty, str(tmp_path / "none"))
    assert huffman.read(spark, str(tmp_path / "none")).count() == 0


def packed(rows, capacity):
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


def test_packing(docs, texts, empty):
    rows = packing.pack(docs, capacity=64).collect()
    bins = packed(rows, 64)
    total = sum(r.length for r in rows)
    assert len(bins) <= -(-total // 64) + 2
    for i in range(len(texts)):
        pieces = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == i)
        assert [p for p, _, _ in pieces] == list(range(len(pieces))) and all(n == 64 for p, _, n in pieces if p)
    few = packed(packing.pack(docs, capacity=64, max_documents=2).collect(), 64)
    assert max(map(len, few.values())) <= 2
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_packing_plan_keeps_every_capacity(seed):
    rng = random.Random(seed)
    counts = {n: rng.randint(1, 50) for n in rng.sample(range(1, 101), 40)}
    ranges = packing.plan(counts, 100, max_documents=4, max_attention=10_000)
    bins = collections.defaultdict(list)
    for length, low, high, first, offset in ranges:
        for k in range(high - low):
            bins[first + k].append((offset, length))
    assert collections.Counter(n for b in bins.values() for _, n in b) == counts
    for content in bins.values():
        assert len(content) <= 4 and sum(n * n for _, n in content) <= 10_000
        at = 0
        for offset, n in sorted(content):
            assert offset == at
            at += n
        assert at <= 100
    loose = packing.plan(counts, 100)
    assert len({f + k for _, a, b, f, _ in loose for k in range(b - a)}) <= -(-sum(n * c for n, c in counts.items()) // 100) * 1.25


def windows_similarity(text, item, k=5):
    cut = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()) if w]
    k = min(k, len(cut(item)))
    runs = lambda w: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if k else []
    doc, want = runs(cut(text)), collections.Counter(runs(cut(item)))
    n, best = sum(want.values()), 0.0
    for start in range(len(doc)):
        have = collections.Counter(doc[start : start + n])
        both = sum((have & want).values())
        best = max(best, both / (n + sum(have.values()) - both))
    return best


def test_decontamination_against_all_windows(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.randint(3, 40))) for i in range(12)] + [(20, "a b a b a b a b a b a b"), (21, ""), (22, None)]
    items += [(23, "alpha beta gamma delta"), (24, "Solo"), (25, "alpha beta gamma delta eps")]
    texts = [None, "", "a b a b a b a b a b a b", say(30), "x alpha, beta gamma delta eps", "alpha beta", "not solo here solo"]
    for _, item in items[:12]:
        words = item.split()
        for changes in (0, 1, 4):
            changed = list(words)
            for _ in range(min(changes, len(words) - 1)):
                changed[rng.randrange(len(changed))] = say(1)
            texts.append(f"{say(20)} {' '.join(changed)}, {say(10)}")
        texts.append(" ".join(words[: len(words) * 9 // 10]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(df, benchmark).collect()}
    want = {}
    for d, text in enumerate(texts):
        for i, item in items:
            s = windows_similarity(text or "", item or "")
            if s >= 0.8:
                want[d, i] = round(s, 6)
    assert got == want
    left = {r.doc_id for r in decontaminate.drop_contaminated(df, benchmark).collect()}
    assert left == set(range(len(texts))) - {d for d, _ in want}
    assert decontaminate.contaminated(df, benchmark.filter("item_id < 0")).count() == 0
    assert decontaminate.contaminated(df.filter("doc_id < 0"), benchmark).count() == 0


def test_items_with_a_much_repeated_shingle_are_found(spark):
    rng = random.Random(17)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    items, texts = [], []
    for i in range(40):
        head, tail = say(45), say(45)
        items.append((i, f"{head} {' '.join(['again'] * 15)} {tail}"))
        texts.append(f"{say(12)} {head} {' '.join(['again'] * rng.randint(3, 15))} {tail} {say(12)}")
        texts.append(f"{say(9)} {head} {say(rng.randint(1, 15))} {tail}")
    want = {(d, d // 2): round(s, 6) for d, t in enumerate(texts) if (s := windows_similarity(t, items[d // 2][1])) >= 0.8}
    assert len(want) > 30
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for radius in (decontaminate.RADIUS, 0):  # with 0 nearly all are met beyond the radius
        found = decontaminate.contaminated(df, benchmark, radius=radius).collect()
        assert {(r.doc_id, r.item_id): r.similarity for r in found} == want


def test_contaminated_rows_of_a_repeated_id_go_alone(spark):
    item = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(1, item), (1, "clean"), (None, item), (2, None), (1, item)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, item)], "item_id long, text string")
    left = {tuple(r) for r in decontaminate.drop_contaminated(df, benchmark).collect()}
    assert left == {(1, "clean"), (None, item), (2, None)}


def earlier_stretches(texts):
    """Brute force: units in any stretch of eight words or more that stood earlier, in the same text or one before."""
    seen, out = set(), []
    for text in texts:
        units, gone = [" ".join(u.split()) for u in line_dedup.cut(text or "")[0] if u.split()], set()
        for start in range(len(units)):
            for end in range(start + 1, len(units) + 1):
                if sum(len(u.split()) for u in units[start:end]) >= 8 and tuple(units[start:end]) in seen:
                    gone.update(range(start, end))
            seen.update(tuple(units[start:end]) for end in range(start + 1, len(units) + 1))
        out.append((None, 0) if text is None else line_dedup.without(text, [(p, p + 1) for p in gone]))
    return out


def test_line_dedup(spark):
    rng = random.Random(6)
    lines = [prose(rng, rng.randint(1, 14)) + rng.choice(["", ".", "!"]) for _ in range(25)]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(0, 9))) for _ in range(40)] + ["", None, " \n ", lines[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    df = df.withColumns({"_id": F.lit(1), "_BODY": F.lit(1), "_gone": F.lit(1), "_hash": F.lit(1), "_rest": F.lit(1)})
    got = by_id(line_dedup.dedup_lines(df))
    assert [(got[i].text, got[i]._removed) for i in range(len(texts))] == earlier_stretches(texts)
    assert line_dedup.dedup_lines(df.filter("doc_id < 0")).count() == 0


def test_crowded_fingerprints_are_told_apart_by_windows(spark):
    rng = random.Random(12)
    lines = ["Common line."] * 6 + [prose(rng, rng.randint(2, 9)) for _ in range(9)]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = earlier_stretches(texts)
    for group in (1, 3):
        gone = by_id(line_dedup.deleted_stretches(df, group=group))
        got = [line_dedup.without(t, [tuple(x) for x in gone[i].gone] if i in gone else []) for i, t in enumerate(texts)]
        assert got == want


def test_lone_places_go_no_further_and_crowded_lots_give_the_same(spark):
    rng = random.Random(14)
    lines = ["Common line."] * 8 + [prose(rng, rng.randint(1, 12)) for _ in range(12)]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(1, 14))) for _ in range(50)]
    texts += [f"Only{i} " + prose(rng, 9) for i in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = earlier_stretches(texts)
    for crowd in (0, 20, 1_000_000):  # every lot crowded, some, none
        gone = by_id(line_dedup.deleted_stretches(df, crowd=crowd))
        got = [line_dedup.without(t, [tuple(x) for x in gone[i].gone] if i in gone else []) for i, t in enumerate(texts)]
        assert got == want
    rows = [(c, 10 * c + r, d, p, p, p + 1) for c, r, d, p in [(1, 1, 1, 0), (2, 1, 1, 1), (2, 1, 2, 0), (3, 1, 1, 2), (3, 2, 2, 5)]]
    places = spark.createDataFrame(rows, line_dedup.PLACE)
    for crowd in (0, 1_000_000):
        later, firsts = line_dedup.repeats(places, crowd)
        assert [tuple(r) for r in later.collect()] == [(2, 0, 1)]
        assert sorted((r.code, r.n, r.doc_id, r.place) for r in firsts.collect()) == [(3, 2, 1, 2), (3, 2, 2, 5)]


def test_plain_texts_are_cut_as_the_expression_cuts_them():
    rng = random.Random(15)
    marks = ["a", "bc", ".", "!", "?", " ", "  ", "\n", "\t", "\0", "\xa0", "\x1c", "é", "日", "\u3000", "...", ". "]
    for _ in range(4_000):
        text = "".join(rng.choice(marks) for _ in range(rng.randint(0, 14)))
        pieces = line_dedup.BREAK.split(text)
        assert line_dedup.cut(text) == (pieces[0::2], [*pieces[1::2], ""]), repr(text)
        words = [u.split() for u in pieces[0::2] if u.split()]
        codes, sizes = line_dedup.unit_codes(text)
        assert sizes.tolist() == [len(w) for w in words], repr(text)
        assert codes.tolist() == [line_dedup.xxhash.xxh64_intdigest(" ".join(w)) for w in words], repr(text)


def test_windows_whose_units_stood_elsewhere_are_cut(spark):
    rng = random.Random(10)
    lines = [prose(rng, rng.randint(1, 5)) for _ in range(12)]
    passage = "\n".join(f"Line{i} of it" for i in range(6))
    texts = ["\n".join(f"Line{i} of it\nother {i}" for i in range(6)), f"a\n{passage}\nb", f"c\n{passage}\nd", "Eran.\nx", "Eran.\n" * 22]
    texts += ["\n".join(rng.choice(lines) for _ in range(rng.randint(0, 12))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = by_id(line_dedup.dedup_lines(df))
    assert [(got[i].text, got[i]._removed) for i in range(len(texts))] == earlier_stretches(texts)
    assert got[2].text == "c\nd" and got[4]._removed == 21


def test_passage_inside_lines_is_cut(spark):
    rng = random.Random(9)
    passage = " ".join(f"Passage{i} " + prose(rng, 11) + "." for i in range(6))
    df = spark.createDataFrame([(i, f"Own{i} start of line {passage} Then own{i} end.") for i in range(3)], "doc_id long, text string")
    got = by_id(line_dedup.dedup_lines(df))
    assert got[0].text.count("Passage") == 6 and got[1].text.count("Passage") <= 1 and "own2 end." in got[2].text


def test_null_and_repeated_ids_in_line_dedup(spark):
    text = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(None, text), (1, text), (1, text), (2, text)], "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.text) for r in line_dedup.dedup_lines(df).collect())
    assert got == {(None, text): 1, (1, text): 2, (2, ""): 1}


def test_licenses(spark, texts):
    rng = random.Random(7)
    bits = ["under the MIT License", "apache-license, VERSION 2", "CC by-NC", "cc by", "nc", "the mit", "x", "é", *[n for n, _ in licenses.NOTICES]]
    given = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 6))) for _ in range(40)] + texts
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").repartition(3)
    got = by_id(licenses.scan(df))
    assert len(got) == len(given)
    for i, text in enumerate(given):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        places = []
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            places += [(j, label) for j in range(len(words)) if words[j : j + len(p)] == p]
        row = got[i]
        starts = [j for j, _ in places]
        assert (row.n_words, row.n_base) == (len(words), len(places))
        assert (row.first_word, row.last_word) == (min(starts, default=None), max(starts, default=None))
        base = {label for _, label in places}
        assert row.base_labels == ",".join(sorted(base)) and base <= set(row.labels.split(",")) | {""} and 0 <= row.score <= 1
        for notice, label in licenses.NOTICES:
            if notice in (text or ""):
                assert label in row.labels.split(",")
    assert licenses.scan(df.filter("doc_id < 0")).count() == 0


def quality_rows(n, seed):
    rng, rows = random.Random(seed), []
    for i in range(n):
        text, kind = prose(rng, rng.randint(20, 60)), rng.choice(["good", "good", "good", "shout", "toxic"])
        if kind == "shout":
            text = " ".join(w.upper() + "!!" for w in text.split())
        if kind == "toxic":
            text = text.replace("quick", "vilewordish") + " vileword vilewording"
        rows.append((i, text, "en" if i % 2 else "de", f"s{i % 5}", kind))
    return rows


def test_quality(spark):
    rows = quality_rows(500, 1) + [(1000, None, "en", None, "empty"), (1001, "  ", None, "s1", "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kind string").repartition(3)
    labels = df.filter("doc_id < 250").select("doc_id", (F.col("kind") != "shout").cast("int").alias("quality"), (F.col("kind") == "toxic").cast("int").alias("toxic"))
    got = quality.classify(df, labels).filter("doc_id >= 250").collect()
    right = sum(r._good == (r.kind == "good") for r in got) / len(got)
    assert len(got) == 252 and right > 0.97
    assert not any(r._good for r in got if r.kind == "empty")
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns
    untrained = quality.keep_good(df, labels.filter("doc_id < 0"))
    assert untrained.count() == 500
    assert quality.keep_good(df.filter("doc_id < 0"), labels).count() == 0


def test_shrinking_follows_counts(spark):
    rows = [("big", "a", 1.0)] * 400 + [("big", "b", 0.0)] * 400 + [("small", "c", 0.0)] * 2 + [("mid", "d", 1.0)] * 100
    got = {r.path: r for r in quality.site_rates(spark.createDataFrame(rows, "host string, path string, evidence double")).collect()}
    assert got["a"].rate > 0.9 and got["b"].rate < 0.1
    assert 0 < got["c"].rate < got["c"].overall and got["d"].rate > got["d"].overall


def test_rates_are_those_of_plain_python(spark):
    rng = random.Random(12)
    rows = [(f"h{h}", f"p{p}", rng.random() ** (1 + h)) for h in range(4) for p in range(3) for _ in range(rng.randint(1, 60))]
    got = {(r.host, r.path): r for r in quality.site_rates(spark.createDataFrame(rows, "host string, path string, evidence double")).collect()}

    def strength(groups, centres):
        n = sum(c for _, c in groups)
        within = sum(m * (1 - m) for m in centres) / len(groups)
        between = sum((g / c - m) ** 2 * c for (g, c), m in zip(groups, centres)) / n
        return min(1000.0, max(5.0, within / between - 1))

    def sums(key):
        out = {}
        for row in rows:
            good, n = out.get(key(row), (0.0, 0))
            out[key(row)] = good + row[2], n + 1
        return out

    hosts, paths = sums(lambda r: r[0]), sums(lambda r: r[:2])
    overall = sum(r[2] for r in rows) / len(rows)
    s = strength(list(hosts.values()), [overall] * len(hosts))
    host_rate = {h: (g + s * overall) / (n + s) for h, (g, n) in hosts.items()}
    s = strength(list(paths.values()), [host_rate[h] for h, _ in paths])
    assert got.keys() == paths.keys()
    for (h, p), (g, n) in paths.items():
        assert got[h, p].overall == pytest.approx(overall) and got[h, p].host_rate == pytest.approx(host_rate[h])
        assert got[h, p].rate == pytest.approx((g + s * host_rate[h]) / (n + s))


def test_extra_columns_with_clashing_names(docs):
    clash = docs.withColumns({n: F.lit(1) for n in ("row", "w", "h", "n", "size", "pos", "rank", "part", "length", "bucket", "codes", "_salt", "_host", "_path", "_rate", "_overall", "_good", "_id", "_body", "_gone", "place", "start")})
    for made in (
        simhash_dedup.keep_first(clash), line_dedup.keep_lines(clash),
        decontaminate.drop_contaminated(clash, docs.selectExpr("doc_id AS item_id", "text").filter("item_id = 17")),
    ):
        assert made.columns == clash.columns and made.count() > 0
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) AS quality", "0 AS toxic", "1 AS _rate")
    good = quality.keep_good(clash, labels)
    assert good.columns == clash.columns and good.count() > 0
    assert licenses.scan(clash).count() == docs.count() and fingerprints.edited_fingerprints(clash).count() == docs.count()
    assert packing.pack(clash, capacity=512).count() >= docs.count()


def test_ascii_lower(spark):
    df = spark.createDataFrame([("AbZ",), ("ÉA",), ("KK",), ("İI",)], "t string")
    assert [r[0] for r in df.select(common.ascii_lower(F.col("t"))).collect()] == ["abz", "Éa", "Kk", "İi"]


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        path = common.scratch_path(spark, "test-stage")
        after.write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append(docs.count())
    assert kept == sorted(kept, reverse=True) and kept[-1] > 100
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    packed(rows, packing.CAPACITY)


def test_stretches_are_joined_when_they_overlap_or_touch():
    assert line_dedup.joined([]) == []
    assert line_dedup.joined([(5, 7), (0, 2), (2, 3), (6, 9), (6, 9)]) == [(0, 3), (5, 9)]


def test_encoder_that_forgets_gives_the_ids_of_the_tokenizer():
    from labelloom.llm import token_ids

    files = token_ids.public_files()
    forgetful = token_ids.Encoder(*files, remembered=3)
    for text in ("a b a c d e a f g", "", "b b b", "one two three four five", "a f one b"):
        want = forgetful.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(forgetful.encode(text), "<u4").tolist() == want
