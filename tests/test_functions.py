import math

import pytest
from pyspark.sql import functions as F

from labelloom.functions import scores, text


def one(spark, expression, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expression.alias("x")).first().x


@pytest.mark.parametrize(
    "value",
    ["", "  \t\n", "one", " a  b ", "a b　c", "a\u0085b\x0bc\x1cd\x1fe", "x​y", "línea ñ 日本 語", "a b c d e"],
)
def test_words_split_like_python(spark, value):
    assert one(spark, text.words(F.col("t")), t=value) == value.split()
    assert one(spark, text.word_count(F.col("t")), t=value) == len(value.split())


def test_preview_cuts_only_longer_texts(spark):
    assert one(spark, text.preview(F.col("t")), t="x" * 200) == "x" * 200
    assert one(spark, text.preview(F.col("t")), t="x" * 201) == "x" * 200 + "..."


@pytest.mark.parametrize(
    "ids, padded, mask, last",
    [
        ([5, 6, 7], [5, 6, 7, 0, 0], [1, 1, 1, 0, 0], 7),
        ([1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 5], [1, 1, 1, 1, 1], 5),
        ([1, 2, 3, 4, 5], [1, 2, 3, 4, 5], [1, 1, 1, 1, 1], 5),
        ([], [0, 0, 0, 0, 0], [0, 0, 0, 0, 0], 0),
    ],
)
def test_pad_mask_and_last(spark, ids, padded, mask, last):
    df = spark.createDataFrame([(ids,)], "ids array<bigint>")
    df = df.withColumn("p", text.truncate_pad(F.col("ids"), 5)).withColumn("m", text.attention_mask(F.col("p")))
    row = df.select(
        "p", "m", text.last_valid(F.col("p"), F.col("m")).alias("last"), text.last_valid(F.col("p")).alias("final")
    ).first()
    assert (row.p, row.m, row.last, row.final) == (padded, mask, last, padded[-1])


def test_perplexity_values(spark):
    df = spark.createDataFrame([(2.5,), (2.0,), (1.5,), (1.0,), (0.5,)], ["loss"])
    got = [round(r[0], 6) for r in df.select(scores.perplexity(F.col("loss"))).collect()]
    assert got == [12.182494, 7.389056, 4.481689, 2.718282, 1.648721]


def test_argmax_takes_lowest_of_equals_and_rejects_nan(spark):
    assert one(spark, scores.argmax(F.col("x")), x=[1.0, 3.0, 3.0]) == 1
    with pytest.raises(Exception, match="NaN"):
        one(spark, scores.argmax(F.col("x")), x=[1.0, float("nan")])


@pytest.mark.parametrize("logits", [[1.0, 2.0, 3.0], [1000.0, 1001.0, 999.0], [-5000.0, -5001.0, -4999.0], [0.0, 0.0, 0.0]])
@pytest.mark.parametrize("smoothing", [0.0, 0.1])
def test_cross_entropy(spark, logits, smoothing):
    top = max(logits)
    log_total = top + math.log(sum(math.exp(x - top) for x in logits))
    nll = [log_total - x for x in logits]
    for label in range(3):
        want = (1 - smoothing) * nll[label] + smoothing * sum(nll) / 3
        got = one(spark, scores.cross_entropy(F.col("x"), F.lit(label), smoothing), x=logits)
        assert math.isfinite(got) and got == pytest.approx(want, abs=1e-9)


def test_padding_to_full_blocks_keeps_every_id(spark):
    df = spark.createDataFrame([(0,), (1,), (3,), (4,), (9,)], "n int")
    ids = F.transform(F.filter(F.sequence(F.lit(0), F.col("n")), lambda i: i > 0), lambda i: i.cast("long"))
    got = df.select("n", text.pad_blocks(ids, 4).alias("ids")).collect()
    assert [len(r.ids) for r in got] == [4, 4, 4, 4, 12]
    assert all(r.ids[: r.n] == list(range(1, r.n + 1)) and set(r.ids[r.n :]) <= {0} for r in got)
