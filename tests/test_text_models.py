import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelloom.operators import classifiers, encoding, scale, splits, token_models


@pytest.fixture(scope="module")
def corpus(spark):
    """Skewed words, a blank text, and words that only held-out texts have."""
    draw = random.Random(3)
    words = ["the"] * 12 + [f"w{i}" for i in range(25)]
    data = []
    for i in range(90):
        label = i % 3
        body = [draw.choice(words) if draw.random() < 0.7 else f"c{label}" for _ in range(draw.randint(1, 30))]
        split = "test" if i % 9 == 0 else "validation" if i % 9 == 4 else "train"
        if split != "train":
            body += ["rare", "rare"]
        data.append((i, " ".join(body), label, split))
    data += [(90, " ", 0, "test"), (91, "unseen only", 1, "test"), (92, "", 2, "train")]
    return data, spark.createDataFrame(data, "id int, text string, label int, split string").repartition(4)


@pytest.fixture(params=["broadcast", "salted"])
def join_kind(request, monkeypatch):
    """Force the shuffle join with salted keys, which needs large tables otherwise."""
    if request.param == "salted":
        monkeypatch.setattr(scale, "fits_broadcast", lambda table, max_bytes=0: False)
        monkeypatch.setattr(scale.salted_join, "__defaults__", ("inner", None, None, 20))
        monkeypatch.setattr(scale.sized_join, "__defaults__", ("inner", None, None, 0, 20))


def test_vocabulary_order_and_cap(spark, rows):
    df = spark.createDataFrame([("b a c",), ("a b d",), ("a e c  b",)], "text string")
    vocab = encoding.build_vocab(df, min_frequency=2, max_size=2)
    assert rows(vocab) == [("a", 2, 3), ("b", 3, 3)]
    assert rows(encoding.build_vocab(df, min_frequency=2)) == [("a", 2, 3), ("b", 3, 3), ("c", 4, 2)]
    every = [("a", 2, 3), ("b", 3, 3), ("c", 4, 2), ("d", 5, 1), ("e", 6, 1)]
    assert rows(encoding.build_vocab(df)) == rows(encoding.build_vocab(df, task_rows=2)) == every


def test_encode(spark, rows, join_kind):
    df = spark.createDataFrame([(1, "a b a x"), (2, ""), (3, "b " * 40), (4, "z")], "id int, text string")
    vocab = encoding.build_vocab(spark.createDataFrame([("a a b b",)], "text string"))
    assert rows(encoding.encode(df, vocab)) == [(1, [2, 3, 2, 1]), (2, []), (3, [3] * 40), (4, [1])]
    fixed = {r.id: r for r in encoding.encode_fixed(df, vocab, max_length=4).collect()}
    assert fixed[1].input_ids == [2, 3, 2, 1] and fixed[1].attention_mask == [1] * 4
    assert fixed[2].input_ids == [0] * 4 and fixed[2].attention_mask == [0] * 4
    assert fixed[3].input_ids == [3] * 4 and fixed[4].input_ids == [1, 0, 0, 0]


def test_encode_with_another_tokenizer(spark, rows):
    df = spark.createDataFrame([(1, "a,b,,a")], "id int, text string")
    by_comma = lambda text: F.split(text, ",")
    vocab = encoding.build_vocab(df, min_frequency=1, tokenize=by_comma)
    assert rows(vocab, "token") == [("",), ("a",), ("b",)]
    assert encoding.encode(df, vocab, tokenize=by_comma).first().input_ids == [2, 4, 3, 2]


@pytest.mark.parametrize("task_rows", [1_000_000, 10])
def test_batches(spark, monkeypatch, task_rows):
    monkeypatch.setattr(scale.spread, "__defaults__", (task_rows,))
    df = splits.split_train_val_test(spark.range(205).repartition(6))
    first = encoding.make_batches(df, 8, epoch=1)
    sizes = Counter((r.split, r.batch_id) for r in first.collect())
    assert sorted(v for (s, _), v in sizes.items() if s == "train") == [5] + [8] * 20
    val = [r.batch_id for r in first.filter("split = 'validation'").orderBy("id").collect()]
    assert val == [i // 8 for i in range(len(val))]
    order = lambda df: {r.id: r.batch_id for r in df.filter("split = 'train'").collect()}
    assert order(first) == order(encoding.make_batches(df, 8, epoch=1)) != order(encoding.make_batches(df, 8, epoch=2))
    plain = encoding.make_batches(df, 8, shuffle=False).filter("split = 'train'").orderBy("id").collect()
    assert [r.batch_id for r in plain] == [i // 8 for i in range(len(plain))]


def test_masked_loss_and_accuracy(spark):
    df = spark.createDataFrame([(5, 5, 1.0), (6, 5, 3.0), (0, 0, 100.0)], "target int, prediction int, nll double")
    masked = token_models.token_metrics(df, pad=0).first()
    assert (masked.loss, masked.perplexity, masked.token_accuracy) == (2.0, pytest.approx(math.exp(2)), 50.0)
    counted = df.withColumn("n", F.when(F.col("target") == 6, 3).otherwise(1))
    weighted = token_models.token_metrics(counted, pad=0, weight="n").first()
    assert (weighted.loss, weighted.token_accuracy) == (2.5, 25.0)
    every = token_models.token_metrics(df).first()
    assert round(every.token_accuracy, 4) == 66.6667 and round(every.loss, 4) == 34.6667
    nothing = token_models.token_metrics(df.filter("target = 0"), pad=0).first()
    assert (nothing.loss, nothing.perplexity, nothing.token_accuracy) == (math.inf, math.inf, 0.0)


def test_unigram_loss(corpus, join_kind):
    data, df = corpus
    train, held_out = df.filter("split = 'train'"), df.filter("split <> 'train'")
    counts = Counter(w for _, t, _, s in data if s == "train" for w in t.split())
    below = sum(counts.values()) + len(counts) + 1
    got = {r.split: r for r in token_models.unigram_loss(train, held_out, ["split"]).collect()}
    for split in ("validation", "test"):
        nll = [-math.log((counts[w] + 1) / below) for _, t, _, s in data if s == split for w in t.split()]
        assert got[split].tokens == len(nll) and got[split].loss == pytest.approx(sum(nll) / len(nll))
        assert got[split].perplexity == pytest.approx(math.exp(sum(nll) / len(nll)))
    every = {(r.grouping, r.value): r for r in token_models.unigram_perplexity(train, held_out, ["split", "label"]).collect()}
    assert every[("split", "test")].loss == pytest.approx(got["test"].loss)
    assert every[("all", "all")].tokens == got["test"].tokens + got["validation"].tokens
    assert sum(r.tokens for (by, _), r in every.items() if by == "label") == every[("all", "all")].tokens
    nothing = token_models.unigram_loss(train, held_out.filter("false")).first()
    assert nothing.tokens == 0 and nothing.loss == math.inf


def test_successor_accuracy(corpus):
    data, df = corpus
    pairs = Counter(p for _, t, _, s in data if s == "train" for p in zip(t.split(), t.split()[1:]))
    best = {}
    for (a, b), n in sorted(pairs.items(), key=lambda x: (-x[1], x[0][1])):
        best.setdefault(a, b)
    scored = [best.get(a) == b for _, t, _, s in data if s != "train" for a, b in zip(t.split(), t.split()[1:])]
    got = token_models.successor_accuracy(df.filter("split = 'train'"), df.filter("split <> 'train'")).first()
    assert got.tokens == len(scored) and got.token_accuracy == pytest.approx(100 * sum(scored) / len(scored))
    nothing = token_models.successor_accuracy(df, df.filter("id = 92")).first()
    assert nothing.tokens == 0 and nothing.token_accuracy == 0.0


def best_class(scores):
    return min(scores, key=lambda c: (-round(scores[c], 6), c))


def test_keyword_classifier(corpus, join_kind):
    data, df = corpus
    train = [(t.split(), label) for _, t, label, s in data if s == "train"]
    vocab = {w for ws, _ in train for w in ws}
    counts = {c: Counter(w for ws, label in train if label == c for w in ws) for c in range(3)}
    got = {r.id: r for r in classifiers.keyword_classifier(df).collect()}
    assert len(got) == len(data)
    for i, body, label, split in data:
        scores = {}
        for c in range(3):
            total = sum(counts[c].values()) + len(vocab)
            prior = math.log(sum(1 for _, other in train if other == c) / len(train))
            scores[c] = prior + sum(math.log((counts[c][w] + 1) / total) for w in body.split() if w in vocab)
        assert (got[i].label, got[i].split, got[i].prediction) == (label, split, best_class(scores))
        assert got[i].score == pytest.approx(scores[best_class(scores)], abs=1e-6)


def test_text_centroid_classifier(corpus, join_kind):
    data, df = corpus
    frequencies = {i: {w: n / len(t.split()) for w, n in Counter(t.split()).items()} for i, t, _, _ in data}
    centroids = {c: Counter() for c in range(3)}
    for c in range(3):
        ids = [i for i, _, label, s in data if s == "train" and label == c]
        for i in ids:
            for w, f in frequencies[i].items():
                centroids[c][w] += f / len(ids)
    got = {r.id: r for r in classifiers.text_centroid_classifier(df).collect()}
    for i, *_ in data:
        scores = {
            c: sum(f * centroids[c][w] for w, f in frequencies[i].items()) - 0.5 * sum(v * v for v in centroids[c].values())
            for c in range(3)
        }
        assert got[i].prediction == best_class(scores) and got[i].score == pytest.approx(scores[best_class(scores)], abs=1e-9)


def test_centroid_classifier_on_vectors(spark):
    data = [(i, "train" if i % 4 else "test", 2 * (i % 2), [float(i % 2), 1.0, 0.5 * (i % 3)]) for i in range(24)]
    df = spark.createDataFrame(data, "id int, split string, label int, features array<float>")
    got = {r.id: r for r in classifiers.centroid_classifier(df).collect()}
    blocks = classifiers.centroid_classifier(df, block_bytes=48)
    assert {r.id: r for r in blocks.collect()} == got
    means = {}
    for c in (0, 2):
        of_class = [x for _, s, label, x in data if s == "train" and label == c]
        means[c] = [sum(v) / len(of_class) for v in zip(*of_class)]
    for i, _, _, x in data:
        scores = {c: sum(a * b for a, b in zip(x, m)) - 0.5 * sum(b * b for b in m) for c, m in means.items()}
        assert got[i].prediction == best_class(scores) and got[i].score == pytest.approx(max(scores.values()), abs=1e-6)


def test_centroids_of_many_classes(spark):
    n = 100_000
    spot = lambda c: F.array((c % 317).cast("double"), F.floor(c / 317).cast("double"))
    known = spark.range(n).select("id", F.lit("train").alias("split"), F.col("id").alias("label"), spot(F.col("id")).alias("features"))
    asked = spark.range(7, n, 991).select(
        (F.col("id") + n).alias("id"), F.lit("test").alias("split"), F.col("id").alias("label"),
        F.transform(spot(F.col("id")), lambda v: v + 0.25).alias("features"),
    )
    df = known.filter("id % 991 = 7 OR id % 2 = 0").unionByName(asked).repartition(4)
    test = df.filter("split = 'test'")
    found = classifiers.centroid_classifier(df.filter("split = 'train'").unionByName(test), block_bytes=500_000)
    got = found.filter("split = 'test'").agg(F.count("*"), F.count_if(F.col("label") == F.col("prediction"))).first()
    assert got[0] == got[1] == test.count()


def test_keywords_of_many_classes(spark):
    """Five thousand classes of one word each, and texts whose known words decide or say nothing."""
    n = 5_000
    rows = [(i, "train", i, f"w{i} common") for i in range(n)] + [(n, "train", 4_321, "common common")]
    rows += [(n + 1 + i, "test", i * 7, f"common w{i * 7} w{i * 7} unheard w{i * 7}") for i in range(300)] + [(n + 400, "test", 4_321, "unheard of"), (n + 401, "test", 0, None)]
    df = spark.createDataFrame(rows, "id long, split string, label int, text string").repartition(4)
    got = {r.id: r for r in classifiers.keyword_classifier(df).collect()}
    assert len(got) == len(rows)
    assert all(got[n + 1 + i].prediction == i * 7 for i in range(300))
    assert got[n + 400].prediction == got[n + 401].prediction == 4_321  # the commonest class
    assert got[n + 401].score == pytest.approx(math.log(2 / (n + 1)))


def test_nothing_to_learn_from(corpus):
    with pytest.raises(ValueError, match="train"):
        classifiers.keyword_classifier(corpus[1].filter("split <> 'train'"))
