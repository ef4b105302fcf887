import math

import pytest
from pyspark.sql import functions as F

from labelloom.operators import profile, schema, splits


def test_first_listed_column_names_win_and_case_counts():
    assert schema.find_columns(["id", "review", "sentence", "category", "labels"]) == ("sentence", "labels")
    with pytest.raises(ValueError, match="text"):
        schema.find_columns(["Text", "label"])
    with pytest.raises(ValueError, match="label"):
        schema.find_columns(["text", "Label"])


def test_normalize_picks_exact_case_and_casts(spark, rows):
    df = spark.createDataFrame([(1, "no", "yes", "2", "9")], ["id", "Text", "text", "class", "category"])
    assert rows(schema.normalize(df, "id")) == [(1, "yes", 2)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        schema.normalize(spark.createDataFrame([(1, "a", "b")], ["id", "text", "label"]), "id").collect()


@pytest.mark.parametrize("task_rows", [10_000, 2])
def test_class_catalog(spark, rows, task_rows):
    names = spark.createDataFrame([("fr",), ("de",), ("fr",), ("en",), (None,)], "lang string")
    assert rows(schema.class_catalog(names, "lang", task_rows=task_rows)) == [(0, "de"), (1, "en"), (2, "fr")]
    gapped = spark.createDataFrame([(0,), (5,), (2,), (5,)], "label int")
    assert rows(schema.class_catalog(gapped, task_rows=task_rows)) == [(0, "class_0"), (1, "class_1"), (2, "class_2")]
    assert rows(schema.class_catalog(gapped, names=["no", "yes"])) == [(0, "no"), (1, "yes")]
    many = spark.range(1500).selectExpr("concat('c', lpad(id, 4, '0')) AS lang")
    assert sorted(rows(schema.class_catalog(many, "lang", task_rows=100))) == [(i, f"c{i:04}") for i in range(1500)]


def test_labels_to_names_and_back(spark, rows):
    catalog = spark.createDataFrame([(0, "de"), (1, "en")], "label int, class_name string")
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 7), (4, -1)], "id int, label int")
    got = rows(schema.decode_label(df, catalog), "id", "class_name")
    assert got == [(1, "de"), (2, "en"), (3, "class_7"), (4, "class_-1")]
    named = spark.createDataFrame([(1, "en"), (2, "de"), (3, "xx")], "id int, lang string")
    assert rows(schema.encode_label(named, catalog, "lang"), "id", "label") == [(1, 1), (2, 0), (3, None)]


@pytest.mark.parametrize("n", [0, 1, 7, 100, 1001])
def test_exact_sizes_and_disjoint(spark, n):
    df = splits.split_train_val_test(spark.range(n))
    sizes = {r.split: r["count"] for r in df.groupBy("split").count().collect()}
    test = math.ceil(n / 10)
    val = math.ceil((n - test) / 10)
    want = {"test": test, "validation": val, "train": n - test - val}
    assert sizes == {k: v for k, v in want.items() if v}


def test_exact_split_takes_the_lowest_hashes(spark):
    df = splits.carve_test(spark.range(500).withColumn("split", F.lit("train")))
    keyed = df.withColumn("h", splits.hash_key(F.col("id"), splits.TEST_SALT)).orderBy("h", "id").collect()
    assert [r.split for r in keyed] == ["test"] * 50 + ["train"] * 450


@pytest.mark.parametrize("mode", ["exact", "hash"])
def test_split_does_not_depend_on_partitioning(spark, rows, mode):
    a = splits.split_train_val_test(spark.range(700).repartition(7), mode=mode)
    b = splits.split_train_val_test(spark.range(699, -1, -1).coalesce(1), mode=mode)
    assert rows(a) == rows(b)


def test_hash_mode_keeps_its_choices_as_rows_are_added(spark, rows):
    few = splits.split_train_val_test(spark.range(500), mode="hash")
    more = splits.split_train_val_test(spark.range(2000), mode="hash").filter("id < 500")
    assert rows(few) == rows(more)
    shares = {r.split: r["count"] / 2000 for r in splits.split_train_val_test(spark.range(2000), mode="hash").groupBy("split").count().collect()}
    assert abs(shares["test"] - 0.1) < 0.03 and abs(shares["validation"] - 0.09) < 0.03


def test_copies_stay_together_on_request(spark):
    df = spark.range(900).withColumn("text", F.concat(F.lit("t"), F.col("id") % 90))
    apart = splits.split_train_val_test(df, mode="hash", group_key="text").groupBy("text").agg(F.countDistinct("split").alias("n"))
    assert apart.agg(F.max("n")).first()[0] == 1
    with pytest.raises(ValueError, match="group_key"):
        splits.split_train_val_test(df, group_key="text")


def test_three_way_shares(spark):
    df = splits.split_three_way(spark.range(4000))
    shares = {r.split: r["count"] / 4000 for r in df.groupBy("split").count().collect()}
    assert abs(shares["train"] - 0.85) < 0.03 and abs(shares["validation"] - 0.10) < 0.02 and abs(shares["test"] - 0.05) < 0.02
    with pytest.raises(ValueError, match="add up"):
        splits.split_three_way(spark.range(1), (0.5, 0.1, 0.1))


@pytest.mark.parametrize(
    "given, want",
    [
        ({"train": 100, "test": 9, "validation": 8}, {"train": 100, "test": 9, "validation": 8}),
        ({"train": 100, "test": 9, "val": 8}, {"train": 100, "test": 9, "validation": 8}),
        ({"train": 100, "test": 9}, {"train": 90, "test": 9, "validation": 10}),
        ({"train": 100, "val": 8}, {"train": 90, "test": 10, "validation": 8}),
        ({"train": 100}, {"train": 81, "test": 10, "validation": 9}),
        ({"train": 100, "val": 3, "validation": 4, "extra": 5}, {"train": 90, "test": 10, "validation": 4}),
    ],
)
def test_resolve_splits(spark, given, want):
    data = [(i, name) for k, (name, n) in enumerate(given.items()) for i in range(k * 1000, k * 1000 + n)]
    df = splits.resolve_splits(spark.createDataFrame(data, "id long, split string"), set(given))
    assert {r.split: r["count"] for r in df.groupBy("split").count().collect()} == want
    with pytest.raises(ValueError, match="train"):
        splits.resolve_splits(df, {"test"})


def test_overlap_and_drift(spark, rows):
    data = [("train", "a", 0)] * 6 + [("train", "b", 1)] * 2 + [("test", "a", 0)] * 3 + [("test", "c", 2), ("validation", "d", 0)]
    df = spark.createDataFrame(data, "split string, text string, label int")
    assert rows(splits.split_overlap(df)) == [("test", 4, 3, 0.75), ("validation", 1, 0, 0.0)]
    drift = {(r.split, r.label): (r.share, r.train_share, r.drift) for r in splits.split_drift(df).collect()}
    assert drift[("test", 0)] == (0.75, 0.75, 0.0) and drift[("test", 2)] == (0.25, 0.0, 0.25)
    assert drift[("validation", 1)] == (0.0, 0.25, -0.25)


def test_profile(spark, rows):
    data = [(i, "w " * i, i % 2, "train") for i in range(1, 11)] + [(11, "", 0, "test")]
    df = spark.createDataFrame(data, "id int, text string, label int, split string")
    catalog = spark.createDataFrame([(0, "even"), (1, "odd")], "label int, class_name string")
    train = df.filter("split = 'train'")
    assert rows(profile.text_stats(train, sample=4)) == [(2.5, 1, 4, 5)]
    assert rows(profile.text_stats(train, sample=None)) == [(5.5, 1, 10, 11)]
    assert rows(profile.text_stats(train.filter("false"))) == [(None, None, None, None)]
    long = spark.createDataFrame([(1, "w " * 900)], "id int, text string")
    assert profile.text_stats(long).first().recommended_max_seq_length == 512
    assert rows(profile.class_distribution(df, catalog)) == [
        ("test", 0, "even", 1, 100.0), ("train", 0, "even", 5, 50.0), ("train", 1, "odd", 5, 50.0)
    ]
    assert rows(profile.sample_examples(train, catalog, 2)) == [(1, 1, "odd", "w "), (2, 0, "even", "w w ")]


def test_null_ids_are_an_error(spark):
    df = spark.createDataFrame([(1,), (None,)], "id int")
    with pytest.raises(ValueError, match="null"):
        splits.split_train_val_test(df)
