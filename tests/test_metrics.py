import pytest
from pyspark.sql import functions as F

from labelloom.operators import metrics, scale

# Class 3 is predicted but never a label; the expected numbers are worked by hand.
LABELS = [0, 0, 0, 1, 1, 2, 2, 2]
PREDICTIONS = [0, 0, 1, 1, 2, 2, 2, 3]


def frame(spark, labels, predictions):
    return spark.createDataFrame(list(zip(labels, predictions)), "label int, prediction int")


def rounded(row):
    return {k: round(v, 6) for k, v in row.asDict().items()}


def test_known_metrics(spark):
    df = frame(spark, LABELS, PREDICTIONS)
    got = rounded(metrics.classification_metrics(df).first())
    assert got.pop("accuracy") == 0.625
    assert {k: v for k, v in got.items() if k.endswith("macro")} == {"precision_macro": 0.541667, "recall_macro": 0.458333, "f1_macro": 0.491667}
    assert {k: v for k, v in got.items() if k.endswith("weighted")} == {"precision_weighted": 0.75, "recall_weighted": 0.625, "f1_weighted": 0.675}
    per_class = {r.label: rounded(r) for r in metrics.per_class_metrics(metrics.confusion_matrix(df)).collect()}
    assert per_class[1] == {"label": 1, "tp": 1, "predicted": 2, "support": 2, "precision": 0.5, "recall": 0.5, "f1": 0.5}
    assert metrics.confusion_matrix(df).agg(F.sum("n")).first()[0] == 8


def test_class_seen_only_in_predictions(spark):
    got = rounded(metrics.classification_metrics(frame(spark, [0, 0], [0, 3])).first())
    assert got == {
        "accuracy": 0.5, "precision_macro": 0.5, "recall_macro": 0.25, "f1_macro": 0.333333,
        "precision_weighted": 1.0, "recall_weighted": 0.5, "f1_weighted": 0.666667,
    }


def test_grouped_and_single_class_and_empty(spark):
    df = frame(spark, LABELS, PREDICTIONS).withColumn("run", F.lit("a")).union(frame(spark, [4], [4]).withColumn("run", F.lit("b")))
    got = {r.run: r for r in metrics.classification_metrics(df, ["run"]).collect()}
    assert round(got["a"].f1_macro, 6) == 0.491667 and got["b"].f1_macro == got["b"].accuracy == 1.0
    assert round(got["a"].recall_weighted, 9) == round(got["a"].accuracy, 9)
    assert metrics.classification_metrics(df.filter("false")).first().accuracy is None


def test_loss_weightings(spark):
    df = spark.createDataFrame([(0, 1.0)] * 4 + [(1, 3.0)], "batch_id int, loss double")
    assert metrics.epoch_loss(df).first()[0] == 2.0
    assert metrics.epoch_loss(df, weighting="example").first()[0] == 1.4
    with pytest.raises(ValueError):
        metrics.epoch_loss(df, weighting="other")


@pytest.mark.parametrize("task_rows", [1_000_000, 3])
def test_running_accuracy(spark, monkeypatch, task_rows):
    monkeypatch.setattr(scale.spread, "__defaults__", (task_rows,))
    data = [("run", i // 4, i % 3, i % 5) for i in range(80)]
    df = spark.createDataFrame(data, "run_id string, batch_id int, label int, prediction int")
    got = {r.batch_id: r.running_accuracy for r in metrics.running_accuracy(df, ["run_id"]).collect()}
    for batch in range(20):
        seen = [d for d in data if d[1] <= batch]
        assert got[batch] == pytest.approx(sum(d[2] == d[3] for d in seen) / len(seen))
