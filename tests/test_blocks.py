"""Texts in blocks: every token is looked up once per block, whatever the texts look like."""

import numpy as np
from pyspark.sql import functions as F

from labelloom.operators import blocks, classifiers, encoding


def test_a_block_has_each_token_once(spark):
    data = [(i, f"the the w{i % 9} the é{i % 4}") for i in range(200)] + [(200, ""), (201, None), (None, "lost the"), (5, "the again")]
    df = spark.createDataFrame(data, "id int, text string").repartition(5)
    made = blocks.text_blocks(df, ["id"], ["id"])
    words = {}
    for r in made.dictionary.collect():
        assert (r.block, r.code) not in words
        words[r.block, r.code] = r.token
    assert len({(b, t) for (b, _), t in words.items()}) == len(words)
    got = [(r.id, " ".join(words[r.block, c] for c in np.frombuffer(r.codes, "<i4").tolist())) for r in made.texts.collect()]
    assert sorted(got, key=repr) == sorted(((i, t or "") for i, t in data), key=repr)
    assert made.texts.filter("id = 5").select("block").distinct().count() == 1


def test_looking_up_shuffles_no_row_per_token(spark):
    """The text of a million tokens meets the vocabulary as its few different ones."""
    df = spark.range(4).select("id", F.array_join(F.array_repeat(F.lit("a b c d"), 62_500), " ").alias("text"))
    vocab = encoding.build_vocab(df)
    encoded = encoding.encode(df, vocab)
    assert "Generate" not in encoded._jdf.queryExecution().executedPlan().toString()
    sizes = {r.id: (r.n, r.tail) for r in encoded.select("id", F.size("input_ids").alias("n"), F.slice("input_ids", -4, 4).alias("tail")).collect()}
    assert sizes == {i: (250_000, [2, 3, 4, 5]) for i in range(4)}
    plan = classifiers.score_texts(
        df.withColumns({"split": F.lit("test"), "label": F.lit(0)}),
        classifiers.TextWeights(df.withColumns({"split": F.lit("train"), "label": F.lit(0)})),
        ["keywords"],
    )
    assert "posexplode" not in plan._jdf.queryExecution().toString() and plan.count() == 4


def test_encode_joins_texts_of_one_key(spark, rows):
    df = spark.createDataFrame([(1, "a b"), (1, "b b c"), (2, "c"), (None, "a"), (None, None)], "id int, text string")
    vocab = encoding.build_vocab(spark.createDataFrame([("a a b",)], "text string"))
    assert rows(encoding.encode(df, vocab)) == [(1, [2, 3, 3, 3, 1]), (2, [1]), (None, [2])]


def test_a_null_label_is_a_class(spark):
    data = [(i, "train", (None, 0, 1)[i % 3], f"c{i % 3} common") for i in range(30)] + [(30, "train", None, "")]
    data += [(31, "test", 0, "c1 c1"), (32, "test", 1, "unheard"), (33, None, None, None)]
    df = spark.createDataFrame(data, "id int, split string, label int, text string").repartition(3)
    got = {r.id: r.prediction for r in classifiers.keyword_classifier(df).collect()}
    assert len(got) == 34 and got[31] == 0 and got[1] == 0 and got[2] == 1 and got[32] is None and got[33] is None
