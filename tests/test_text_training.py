"""Training on texts reads them once, and steps as plain numpy does."""

import numpy as np
import pytest

from labelloom.operators import blocks, models


@pytest.fixture
def texts(spark):
    data = [(i, ("train", "validation")[i % 4 == 0], i % 2, f"c{i % 2} n{i % 3} common") for i in range(40)]
    return spark.createDataFrame(data, "id int, split string, label int, text string").repartition(3)


def test_saving_splits_the_texts_once(texts, monkeypatch):
    made = []
    monkeypatch.setattr(models, "text_blocks", lambda *a, **k: made.append(1) or blocks.text_blocks(*a, **k))
    bags = models.text_bags(texts)
    kept = models.save_and_reload(models.train_from_text(texts, bags=bags)[0], texts, bags)
    predicted = models.predict(kept, texts, bags)
    assert predicted.filter("label = prediction").count() == 40 and len(made) == 1


def test_rows_that_share_an_id_make_one_text(spark, texts):
    """Their tokens are counted together, and each row gets the logits of all of them."""
    once = texts.filter("id % 8 = 3")
    twice = texts.unionByName(once)
    fit = models.fit_texts(twice, models.design_matrix(twice, models.build_vocab(twice.filter("split = 'train'"))), [models.Candidate(0.01, 2.0, 2)])
    got = {}
    for r in fit.logits[-1].collect():
        got.setdefault(r.id, []).append(r.z)
    data = texts.orderBy("id").collect()
    n = np.array([2 if r.id % 8 == 3 else 1 for r in data])
    assert [len(got[r.id]) for r in data] == n.tolist()
    tokens = sorted({w for r in data if r.split == "train" for w in r.text.split()})
    x = np.array([[r.text.split().count(w) for w in tokens] for r in data], float)
    x = np.column_stack([x / np.linalg.norm(x, axis=1, keepdims=True), n])
    train, y = np.array([r.split == "train" for r in data]), np.eye(2)[[r.label for r in data]]
    w = np.zeros((x.shape[1], 2))
    for _ in range(2):
        p = np.exp(x @ w)
        missed = (n * train)[:, None] * (p / p.sum(axis=1, keepdims=True) - y)
        shrink = 0.01 * w
        shrink[-1] = 0
        w = w - 2.0 * (x.T @ missed / (n * train).sum() + shrink)
    for r, z in zip(data, x @ w):
        assert all(g == pytest.approx(z, abs=1e-9) for g in got[r.id])
