import random

import pytest
from pyspark.sql import functions as F

from labelloom.operators import compare, history, scale

# A plateau below an early best, and steady growth that ends with a tie.
EARLY = [0.5, 0.7, *[0.6] * 9, 0.65]
STEADY = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.75, 0.8]


def runs(spark, **series):
    data = [(run, i, v) for run, values in series.items() for i, v in enumerate(values, start=1)]
    return spark.createDataFrame(data, "run_id string, epoch int, val_f1 double")


@pytest.fixture(params=[1_000_000, 3], ids=["whole runs", "cut runs"])
def both_ways(request, monkeypatch):
    monkeypatch.setattr(scale.spread, "__defaults__", (request.param,))


def by_epoch(df, run, column):
    return [r[column] for r in df.filter(F.col("run_id") == run).orderBy("epoch").collect()]


def test_plateau_and_tie(spark, rows, both_ways):
    df = runs(spark, early=EARLY, steady=STEADY)
    assert rows(history.best_epoch(df)) == [("early", 2, 0.7), ("steady", 8, 0.8)]
    streaks = history.improvement_streak(df)
    assert by_epoch(streaks, "early", "improved") == [True, True] + [False] * 10
    assert by_epoch(streaks, "early", "streak") == [0, 0, *range(1, 11)]
    assert by_epoch(streaks, "steady", "improved") == [True] * 8 + [False] * 2
    assert max(by_epoch(streaks, "steady", "streak")) == 2
    stopped = history.early_stop(df)
    assert rows(stopped.filter("stopped"), "run_id", "epoch") == [("early", 12)]
    assert stopped.count() == 22


def loop(values, patience):
    """What a training loop would do."""
    best, streak, kept = 0.0, 0, []
    for epoch, v in enumerate(values, start=1):
        improved = v > best
        best, streak = (v, 0) if improved else (best, streak + 1)
        stop = patience > 0 and streak >= patience
        kept.append((epoch, improved, streak, stop))
        if stop:
            break
    return kept


@pytest.mark.parametrize("patience", [0, 1, 2, 4])
def test_early_stop_follows_the_loop(spark, both_ways, patience):
    draw = random.Random(patience)
    series = {f"r{i}": [draw.choice([0.0, 0.1, 0.2, 0.3, -1.0, 0.25]) for _ in range(draw.randint(1, 15))] for i in range(12)}
    series["hot"] = [draw.random() for _ in range(60)]
    got = history.early_stop(runs(spark, **series), patience)
    for run, values in series.items():
        kept = got.filter(F.col("run_id") == run).orderBy("epoch").collect()
        assert [(r.epoch, r.improved, r.streak, r.stopped) for r in kept] == loop(values, patience)


def test_ties_and_runs_never_above_zero(spark, rows):
    df = runs(spark, tied=[0.1, 0.5, 0.5], never=[0.0, -1.0], nan=[float("nan"), 0.2])
    assert rows(history.best_epoch(df)) == [("nan", 2, 0.2), ("tied", 2, 0.5)]
    assert by_epoch(history.improvement_streak(df), "never", "streak") == [1, 2]
    assert by_epoch(history.improvement_streak(df), "nan", "improved") == [False, True]


def test_number_epochs(spark, both_ways):
    data = [(r, t, e) for r in ("a", "b") for t in range(5) for e in range(3)]
    df = spark.createDataFrame(data, "run_id string, ts int, event int").repartition(4)
    got = history.number_epochs(df, ["ts", "event"]).orderBy("run_id", "ts", "event").collect()
    assert [r.epoch for r in got] == [*range(1, 16), *range(1, 16)]


def test_gaps(spark, rows):
    data = [("a", 1, 0.5, 0.6, 0.3), ("a", 2, 0.9, 0.7, 0.2), ("b", 1, 0.4, 0.4, 0.0)]
    df = spark.createDataFrame(data, "run_id string, epoch int, train_acc double, val_acc double, val_f1 double")
    got = {r.run_id: r for r in history.generalization_gap(df).collect()}
    assert (got["a"].last_epoch, round(got["a"].gap_last, 6), got["a"].best_epoch, round(got["a"].gap_best, 6)) == (2, 0.2, 1, -0.1)
    assert (got["b"].best_epoch, got["b"].gap_best) == (None, None)
    results = spark.createDataFrame([("a", 0.8)], "run_id string, test_acc double")
    gap, untested = rows(history.val_test_gap(df, results))
    assert gap[0] == "a" and round(gap[3], 6) == -0.1 and untested == ("b", 0.4, None, None)


def test_curves_checkpoints_and_summary(spark, rows):
    df = spark.createDataFrame([("a", i, float(i), 2.0) for i in range(1, 21)], "run_id string, epoch int, val_loss double, epoch_time double")
    assert [r[1] for r in rows(history.checkpoint_epochs(df))] == [10, 20]
    assert [r[1] for r in rows(history.checkpoint_epochs(df, 5).orderBy("epoch"))] == [10, 15, 20, 5]
    assert history.history_curves(df, ["val_loss", "epoch_time"]).count() == 40
    first = history.with_perplexity(df).orderBy("epoch").first()
    assert round(first.val_perplexity, 6) == 2.718282
    assert [round(x, 6) for x in rows(history.run_summary(df))[0][1:]] == [40.0, 2.0, 1.0, 2.718282]
    empty = spark.createDataFrame([("a", None, None)], "run_id string, val_loss double, epoch_time double")
    assert rows(history.run_summary(empty)) == [("a", 0.0, 0.0, float("inf"), float("inf"))]


@pytest.fixture
def results(spark):
    return spark.createDataFrame(
        [
            ("early", "news", 0.75, 0.5, 6.0, 1000, 1000, 12),
            ("steady", "news", 0.5, 0.25, 24.0, 20, 1000, 10),
            ("other", "mail", 0.5, 0.1, 60.0, 1, 2, 70),
        ],
        "run_id string, dataset string, f1_macro double, loss double, training_time_minutes double, "
        "trainable_parameters long, total_parameters long, epochs int",
    )


def test_compare_runs(results):
    measured = ["f1_macro", "loss", "training_time_minutes"]
    got = {r.metric: r for r in compare.compare_runs(results, "early", "steady", measured).collect()}
    assert got["f1_macro"].winner == got["training_time_minutes"].winner == "early"
    assert round(got["f1_macro"].difference, 6) == 0.25 and got["loss"].winner is None
    same = {r.metric: r for r in compare.compare_runs(results, "early", "steady", measured, same_loss=True).collect()}
    assert same["loss"].winner == "steady"
    counted = {r.metric: r.winner for r in compare.compare_runs(results, "early", "steady", ["epochs", "trainable_parameters"]).collect()}
    assert counted == {"epochs": None, "trainable_parameters": None}
    by_request = compare.compare_runs(results, "early", "steady", ["epochs"], directions={"epochs": "lower"})
    assert by_request.first().winner == "steady"


def test_kinds_of_loss(spark):
    df = spark.createDataFrame([("a", 0.2, 0.4), ("b", 0.1, 0.3)], "run_id string, val_loss double, perplexity double")
    assert {r.winner for r in compare.compare_runs(df, "a", "b", ["val_loss", "perplexity"]).collect()} == {None}
    assert {r.winner for r in compare.compare_runs(df, "a", "b", ["val_loss", "perplexity"], same_loss=True).collect()} == {"b"}


def test_zero_minutes(spark):
    df = spark.createDataFrame([("a", 0.0, 0, 0, 3)], "run_id string, training_time_minutes double, trainable_parameters long, total_parameters long, epochs int")
    got = compare.run_efficiency(df, 5).first()
    assert got.ratio_to_fastest is None and got.trainable_share is None and got.epochs_saved == 2


def test_leaderboard_keeps_every_run(spark):
    data = [("d", "a", 0.5), ("d", "b", None), ("d", "c", float("nan")), (None, "e", 0.1)]
    df = spark.createDataFrame(data, "dataset string, run_id string, f1_macro double")
    got = {r.run_id: r["rank"] for r in compare.leaderboard(df).collect()}
    assert got == {"a": 1, "b": 2, "c": 2, "e": 1}


def test_run_efficiency(results):
    got = {r.run_id: r for r in compare.run_efficiency(results, planned_epochs=50).collect()}
    assert round(got["steady"].ratio_to_fastest, 1) == 4.0 and round(got["steady"].cost, 2) == 0.60
    assert round(got["early"].cost, 2) == 0.15 and got["early"].epochs_saved == 38 and got["other"].epochs_saved == 0
    assert got["steady"].trainable_share == 0.02


def test_leaderboard_shares_ranks(spark, rows, both_ways):
    data = [("d", f"r{i}", s) for i, s in enumerate([0.9, 0.8, 0.9, 0.7, 0.8, 0.8])] + [("e", "x", 0.1)]
    df = spark.createDataFrame(data, "dataset string, run_id string, f1_macro double")
    got = {(r.dataset, r.run_id): r["rank"] for r in compare.leaderboard(df).collect()}
    assert got == {("d", "r0"): 1, ("d", "r2"): 1, ("d", "r1"): 3, ("d", "r4"): 3, ("d", "r5"): 3, ("d", "r3"): 6, ("e", "x"): 1}
