import random

import pytest
from pyspark.sql import functions as F

from labelloom.operators import scale


@pytest.fixture
def skewed(spark):
    """One run holds most of the rows; one has a single row."""
    draw = random.Random(7)
    data = [("hot", i, draw.randint(-5, 50)) for i in range(1, 401)]
    data += [(f"r{r}", i, draw.randint(0, 9)) for r in range(12) for i in range(1, 10)] + [("one", 1, 3), (None, 1, 1), (None, 2, 4)]
    draw.shuffle(data)
    return spark.createDataFrame(data, "run string, epoch int, value int").repartition(5)


def totals():
    return {
        "nth": (F.sum, F.lit(1), True),
        "so_far": (F.sum, F.col("value"), True),
        "sum_before": (F.sum, F.col("value"), False),
        "best": (F.max, F.col("value"), True),
        "best_before": (F.max, F.col("value"), False),
    }


@pytest.mark.parametrize("descending", [False, True])
def test_cut_groups_give_the_same_running_totals(skewed, rows, descending):
    order = [F.col("epoch").desc()] if descending else ["epoch"]
    whole = scale.spread(skewed, ["run"], order)
    cut = scale.spread(skewed, ["run"], order, task_rows=20)
    assert scale.PART not in whole.columns and scale.PART in cut.columns
    pieces_of_hot = cut.filter("run = 'hot'").select(scale.PART).distinct().count()
    assert pieces_of_hot > 1
    names = ["run", "epoch", *totals()]
    want = rows(scale.running(whole, ["run"], order, totals()), *names)
    assert rows(scale.running(cut, ["run"], order, totals()), *names) == want


def test_only_the_long_group_is_cut(spark):
    key = F.when(F.col("id") < 6_000, F.lit(-7)).otherwise((F.col("id") - 6_000) % 10_000)
    df = spark.range(46_000).select(key.alias("run"), F.col("id").alias("epoch"), (F.col("id") % 3).alias("value"))
    cut = scale.spread(df, ["run"], ["epoch"], task_rows=1_000)
    parts = {r.run: r.n for r in cut.groupBy("run").agg(F.countDistinct(scale.PART).alias("n")).filter("run < 0 OR n > 1").collect()}
    assert parts.keys() == {-7} and parts[-7] >= 6
    assert cut.filter(F.col("run") >= 0).select(scale.PART).distinct().collect() == [(-1,)]
    sums = {"nth": (F.sum, F.lit(1), True), "before": (F.sum, F.col("value"), False)}
    got, want = (scale.running(x, ["run"], ["epoch"], sums).select("run", "epoch", "nth", "before") for x in (cut, df))
    assert got.count() == 46_000 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_running_twice_on_one_cut(skewed, rows):
    def twice(df):
        first = scale.running(df, ["run"], ["epoch"], {"best_before": (F.max, F.col("value"), False)})
        first = first.withColumn("up", (F.col("value") > F.coalesce("best_before", F.lit(0))).cast("int"))
        return scale.running(first, ["run"], ["epoch"], {"ups": (F.sum, F.col("up"), True)})

    cut = scale.spread(skewed, ["run"], ["epoch"], task_rows=20)
    assert rows(twice(cut), "run", "epoch", "ups") == rows(twice(skewed), "run", "epoch", "ups")


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_keeps_every_row_once(spark, rows, how):
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 200)).alias("key"))
    table = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 200, 2)], "key string, weight int")
    salted = scale.salted_join(left, table, ["key"], how, ["id"], task_rows=50)
    assert "_salt" in salted._jdf.queryExecution().toString()
    assert rows(salted, "id", "key", "weight") == rows(left.join(table, "key", how), "id", "key", "weight")


def test_sized_join_broadcasts_only_what_it_measured(spark, rows):
    left = spark.range(100).select(F.concat(F.lit("k"), F.col("id") % 10).alias("key"), "id")
    table = spark.createDataFrame([(f"k{i}", "x" * 100) for i in range(10)], "key string, body string")
    small = scale.sized_join(left, table, ["key"], spread_by=["id"])
    large = scale.sized_join(left, table, ["key"], spread_by=["id"], max_bytes=500)
    assert "ResolvedHint (strategy=broadcast)" in small._jdf.queryExecution().toString() or "Broadcast" in small._jdf.queryExecution().toString()
    assert rows(small, "id", "body") == rows(large, "id", "body")
    assert not scale.fits_broadcast(table, 1000) and scale.fits_broadcast(table, 2000)


def test_stored_table_is_read_from_the_shared_folder(spark):
    stored = scale.store(spark.range(10))
    assert stored.count() == 10
    folder = scale.shared_folder(spark).removeprefix("file:")
    assert all(f.removeprefix("file://").startswith(folder) for f in stored.inputFiles())


def test_widen_moves_only_narrow_inputs(spark):
    narrow, wide = spark.range(100).coalesce(1), spark.range(100).repartition(64)
    assert scale.widen(narrow, narrow, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert scale.widen(wide, wide, "id") is wide


def test_null_keys_are_spread_too(spark, rows):
    left = spark.range(400).select("id", F.when(F.col("id") % 2 == 0, F.col("id") % 7).alias("key"))
    table = spark.range(5).select(F.col("id").alias("key"), F.col("id").alias("weight"))
    salted = scale.salted_join(left, table, ["key"], "left", ["id"], task_rows=20)
    assert rows(salted) == rows(left.join(table, "key", "left"))
    salts = scale.salted_join(left, table.withColumn("key", F.lit(None).cast("long")), ["key"], "left", ["id"], task_rows=20)
    assert salts.count() == 400 and "_hot_key" in salts._jdf.queryExecution().toString()
