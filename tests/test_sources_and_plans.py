import json

import pytest
from pyspark.sql import functions as F

from labelloom.plans.experiment import experiment
from labelloom.plans.prepare import prepare_dataset
from labelloom.sources import datasets, runs


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_load_splits(spark, tmp_path):
    a, b = write(tmp_path / "a.json", '{"text": "x", "label": 1}\n'), write(tmp_path / "b.json", '{"text": "y", "more": 2}\n')
    with pytest.raises(ValueError, match="train lacks"):
        datasets.load_splits(spark, {"train": a, "val": b}, format="json", optional=["label"])
    df = datasets.load_splits(spark, {"train": a, "val": b}, format="json", optional=["label", "more"])
    assert {(r.split, r.text, r.label, r.more) for r in df.collect()} == {("train", "x", 1, None), ("val", "y", None, 2)}
    with pytest.raises(ValueError, match="train"):
        datasets.load_splits(spark, {"test": a})


def test_jsonl_round_trip(spark, tmp_path, rows):
    data = [("línea 日本\n\"q\" \\  ", 1, "train"), ("", 0, "train"), ("x", -3, "test")]
    df = spark.createDataFrame(data, "text string, label int, split string").withColumn("extra", F.lit(1))
    datasets.write_jsonl(df, str(tmp_path / "out"))
    assert rows(datasets.read_jsonl(spark, str(tmp_path / "out"))) == sorted(data, key=repr)
    raw = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out").rglob("*.json"))
    assert "日本" in raw and "extra" not in raw


@pytest.mark.parametrize(
    "line", ['{"text": "a", "label": ', '{"text": "a"}', '{"label": 1}', '{"text": null, "label": 1}', '{"text": "a", "label": "no"}']
)
def test_bad_lines_fail(spark, tmp_path, line):
    path = write(tmp_path / "x.jsonl", '{"text": "ok", "label": 1, "more": [1]}\n' + line + "\n")
    with pytest.raises(Exception):
        datasets.read_jsonl(spark, path).collect()


def test_metadata_written_by_hand(spark, tmp_path):
    text = json.dumps(
        {"dataset_name": "news", "num_classes": 2, "class_names": ["a", "ü"], "splits": {"train": 9, "val": 1, "test": 2}},
        indent=2, ensure_ascii=False,
    )
    got = datasets.load_metadata(spark, write(tmp_path / "metadata.json", text)).first()
    assert (got.dataset_name, got.class_names, got.splits.val, got.text_stats) == ("news", ["a", "ü"], 1, None)


def test_history_files(spark, tmp_path, rows):
    history = {"train_loss": [1.0, 0.5], "val_f1": [0.1, 0.2], "learning_rate": [0.01, 0.005]}
    write(tmp_path / "run_a" / "history.json", json.dumps(history, indent=2))
    write(tmp_path / "run_b" / "history.json", json.dumps({"val_f1": [0.9]}))
    df = runs.read_history(spark, str(tmp_path / "*" / "history.json"))
    assert rows(df, "run_id", "epoch", "train_loss", "val_f1", "val_acc") == [
        ("run_a", 1, 1.0, 0.1, None), ("run_a", 2, 0.5, 0.2, None), ("run_b", 1, None, 0.9, None)
    ]
    runs.write_history(df, str(tmp_path / "out"))
    again = runs.read_history(spark, str(tmp_path / "out"), lines=True)
    assert rows(again) == rows(df)
    many = spark.range(1, 6).select(F.lit("r").alias("run_id"), F.col("id").alias("epoch"), (F.col("id") / 2).alias("val_f1"))
    runs.write_history(many, str(tmp_path / "pieces"), piece_epochs=2)
    assert spark.read.text(str(tmp_path / "pieces")).count() == 3
    pieces = runs.read_history(spark, str(tmp_path / "pieces"), lines=True)
    assert rows(pieces, "run_id", "epoch", "val_f1") == [("r", i, i / 2) for i in range(1, 6)]
    write(tmp_path / "run_c" / "history.json", json.dumps({"val_f1": []}))
    empty = runs.read_history(spark, str(tmp_path / "run_c" / "history.json"))
    assert rows(empty, "run_id", "epoch", "val_f1") == [("run_c", None, None)]


def test_tracker_files(spark, tmp_path):
    write(tmp_path / "r" / "m.json", json.dumps({"train_losses": [2.0], "epoch_times": [3.0], "total_time": 3.0}))
    got = runs.read_tracker(spark, str(tmp_path / "r" / "m.json")).first()
    assert (got.run_id, got.epoch, got.train_loss, got.epoch_time, got.val_loss) == ("r", 1, 2.0, 3.0, None)


def test_results_files(spark, tmp_path):
    record = {
        "model_size": "small", "dataset": "news", "num_classes": 4, "training_time_minutes": 5.95,
        "test_metrics": {"accuracy": 0.92, "f1_macro": 0.91}, "config": {"batch_size": 192, "use_amp": True, "model_size": "small"},
    }
    path = write(tmp_path / "scratch_small" / "final.json", json.dumps(record, indent=2))
    got = runs.flatten_results(runs.read_results(spark, path)).first()
    assert (got.run_id, got.dataset, got.accuracy, got.f1_macro, got.loss) == ("scratch_small", "news", 0.92, 0.91, None)
    assert got.config == {"batch_size": "192", "use_amp": "true", "model_size": "small"}
    runs.write_results(runs.read_results(spark, path), str(tmp_path / "out"))
    assert runs.read_results(spark, str(tmp_path / "out"), lines=True).first().test_metrics.accuracy == 0.92


def test_prepare_dataset(spark, tmp_path):
    data = [(i, f"text number {i} " * (i % 4), i % 3) for i in range(100)]
    spark.createDataFrame(data, "key int, review string, category int").write.parquet(str(tmp_path / "train"))
    done = prepare_dataset(spark, "reviews", {"train": str(tmp_path / "train")}, str(tmp_path / "out"), "key")
    meta = datasets.load_metadata(spark, str(tmp_path / "out" / "metadata")).first()
    assert meta.splits.asDict() == {"train": 81, "val": 9, "test": 10}
    assert (meta.text_column, meta.label_column, meta.num_classes) == ("review", "category", 3)
    assert meta.class_names == ["class_0", "class_1", "class_2"] and meta.text_stats.min_words == 0
    written = datasets.read_jsonl(spark, str(tmp_path / "out" / "data"))
    assert written.count() == 100 and done.examples.count() == 3
    assert done.distribution.agg(F.sum("n")).first()[0] == 100


def test_experiment(spark):
    data = [(i, f"k{i % 2} k{i % 2} common", i % 2, "train" if i % 5 > 1 else "test" if i % 5 else "validation") for i in range(60)]
    df = spark.createDataFrame(data, "id int, text string, label int, split string")
    got = {r.run_id: r for r in experiment(df, "toy").collect()}
    assert set(got) == {"keywords", "centroids"}
    assert all((r["rank"], r.f1_macro, r.best_val_f1, r.dataset) == (1, 1.0, 1.0, "toy") for r in got.values())
