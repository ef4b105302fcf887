import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.operators import metrics, models, splits


@pytest.fixture(scope="module")
def texts(spark):
    """Four classes, one of them twice as common; each has its words."""
    df = spark.range(300).select(
        "id", (F.least(F.col("id") % 5, F.lit(3))).cast("int").alias("label")
    ).withColumn("text", F.concat_ws(" ", F.lit("common word"), F.concat(F.lit("c"), "label"), F.concat(F.lit("n"), F.col("id") % 7)))
    return splits.split_train_val_test(df).repartition(4)


def f1(predictions, split):
    return metrics.classification_metrics(predictions.filter(F.col("split") == split)).first().f1_macro


def test_text_model_beats_the_commonest_class(texts):
    model, curve = models.train_from_text(texts)
    predictions = models.predict(models.save_and_reload(model, texts), texts)
    majority = texts.withColumn("prediction", F.lit(3))
    assert predictions.count() == 300 and predictions.schema["logits"].dataType.simpleString() == "array<double>"
    assert f1(predictions, "validation") > f1(majority, "validation")
    losses = {(r.split, r.epoch): r for r in curve.collect()}
    assert len(losses) == 15 and losses["train", 5].loss < losses["train", 2].loss
    right = predictions.filter("split = 'test' AND label = prediction").count() / losses["test", 5].n
    assert losses["test", 5].accuracy == pytest.approx(right)


def test_gradient_steps_equal_plain_numpy(spark):
    rng = np.random.default_rng(3)
    said = [" ".join(rng.choice(list("abcdefg"), rng.integers(0, 9))) for _ in range(40)]
    rows = [(i, ("train", "train", "validation", "test")[i % 4], int(rng.integers(0, 3)) * 2, t) for i, t in enumerate(said)]
    df = spark.createDataFrame(rows, "id int, split string, label int, text string").repartition(3)
    tried = [models.Candidate(0.1, 0.5, 2), models.Candidate(0.0, 3.0, 4)]
    fit = models.fit_texts(df, models.design_matrix(df, models.build_vocab(df.filter("split = 'train'"))), tried)
    got = {r.id: r.z for r in fit.logits[-1].collect()}
    train = np.array([s == "train" for _, s, *_ in rows])
    tokens = sorted({w for (_, s, _, t) in rows if s == "train" for w in t.split()})
    x = np.array([[t.split().count(w) for w in tokens] for *_, t in rows], float)
    x /= np.maximum(1e-300, np.sqrt([sum(t.split().count(w) ** 2 for w in set(t.split())) for *_, t in rows]))[:, None]
    x = np.column_stack([x, np.ones(len(rows))])
    classes = sorted({label for _, s, label, _ in rows if s == "train"})
    y = np.array([[label == c for c in classes] for *_, label, _ in rows], float)
    at = 0
    for c in tried:
        w = np.zeros((x.shape[1], len(classes)))
        for _ in range(c.steps):
            z = x[train] @ w
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            shrink = c.l2 * w
            shrink[-1] = 0
            w = w - c.rate * (x[train].T @ (p - y[train]) / train.sum() + shrink)
        want = x @ w
        for i in range(len(rows)):
            assert got[i][at : at + len(classes)] == pytest.approx(want[i], abs=1e-9)
        at += len(classes)


def test_head_on_fixed_vectors_and_other_scorers(texts, rows):
    vectors = texts.withColumn("features", F.transform(F.array(*[F.lit(i) for i in range(4)]), lambda i: (i == F.col("label")).cast("float")))
    model = models.train_head(vectors)
    predictions = models.predict(model, vectors)
    assert f1(predictions, "test") == 1.0
    solved = {r.feature: np.array(r.w) for r in model.weights.collect()}
    train = [r for r in vectors.filter("split = 'train'").collect()]
    x = np.column_stack([np.array([r.features for r in train], float), np.ones(len(train))])
    y = np.array([[r.label == c for c in model.classes] for r in train], float)
    w = np.array([*[solved[i] for i in range(4)], solved[-1]])
    residual = x.T @ x @ w + np.diag([0.1 * len(train)] * 4 + [0.0]) @ w - x.T @ y
    assert np.abs(residual).max() < 1e-6
    again = models.predict_with(vectors, lambda batch: [np.asarray(x, dtype=float) * 2 for x in batch["features"]], ["features"])
    assert rows(again, "id", "prediction") == rows(predictions, "id", "prediction")


def test_a_worker_loads_a_scorer_once(texts, tmp_path):
    folder = str(tmp_path)

    def load():
        import os
        import uuid

        open(os.path.join(folder, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()
        return lambda batch: [[0.0, 1.0]] * len(batch)

    scored = models.predict_with(texts.repartition(40), None, ["text"], load)
    assert scored.filter("prediction = 1").count() == 300
    loads = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert 1 <= len(loads) == len(set(loads)) < 40


def test_changed_weights_are_noticed(texts, tmp_path):
    vectors = texts.withColumn("features", F.array(F.col("label").cast("double"), F.lit(1.0)))
    model = models.train_head(vectors)
    path = str(tmp_path / "model")
    models.save(model, path, vectors)
    kept = models.load(texts.sparkSession, path, vectors)
    assert models.fingerprint(kept.weights) == models.fingerprint(model.weights)
    other = models.LinearModel(model.weights.withColumn("w", F.transform("w", lambda v: v + 1e-9)), model.classes, "features")
    other.weights.write.parquet(f"{path}-other/weights")
    for part in ("about", "classes"):
        read = texts.sparkSession.read.text(f"{path}/{part}") if part == "about" else texts.sparkSession.read.parquet(f"{path}/{part}")
        (read.write.text if part == "about" else read.write.parquet)(f"{path}-other/{part}")
    with pytest.raises(ValueError, match="weights"):
        models.load(texts.sparkSession, f"{path}-other")
    with pytest.raises(ValueError, match="predicts"):
        models.load(texts.sparkSession, path, vectors.withColumn("features", F.array(-F.col("label").cast("double"), F.lit(1.0))))


def test_select_model(texts):
    tried = [models.Candidate(0.0, 0.001, 1), models.Candidate(0.0, 6.0, 6), models.Candidate(0.0, 6.0, 6)]
    got = models.select_model(texts, tried).orderBy("candidate").collect()
    assert [r.best for r in got] == [False, True, False] and got[1].val_f1_macro == got[2].val_f1_macro
    assert got[1].test_accuracy > 0.9 and got[0].test_accuracy is None
