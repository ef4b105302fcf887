"""What the other operators use to stay correct and balanced when one key holds a large share.

* ``store``        - written table in the shared folder: cuts lineage, survives lost executors.
* ``sized_join``   - equi-join that broadcasts only after measuring, and salts hot keys beyond that.
* ``spread`` and ``running`` - running sums and maxima per group, also when a group is too long
  for one task.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 * 1024 * 1024
TASK_ROWS = 1_000_000
PART = "_part"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, else its warehouse; both are shared by all executors."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")


def scratch_path(spark: SparkSession, name: str = "table") -> str:
    """A path in the shared folder that nothing has written to yet."""
    application = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/labelloom/{application}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str = "table") -> DataFrame:
    """Write once, read from there: a pruned, compressed scan with known size and no lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int | None = None, name: str = "buckets") -> DataFrame:
    """As ``store``, in buckets by ``key``: joins and sums on it move only the other side.

    The frame keeps what the catalog said of the table, so the entry goes at once and only files stay.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    entry = f"labelloom_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").bucketBy(buckets or shuffle_tasks(spark), key).sortBy(key)
    writer.option("path", path).option("compression", "zstd").saveAsTable(entry)
    table = spark.table(entry)
    spark.sql(f"DROP TABLE {entry}")
    return table


def free_name(wanted: str, taken) -> str:
    """``wanted``, lengthened until no column in ``taken`` has that name; Spark doesn't tell cases apart."""
    used = {c.lower() for c in taken}
    while wanted.lower() in used:
        wanted += "_"
    return wanted


def shuffle_tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def widen(df: DataFrame, source: DataFrame, by: str) -> DataFrame:
    """Give an input that Spark reads in fewer tasks than there are cores to all of them.

    That happens with files that cannot be split, such as a single row group. ``source`` is the
    plain scan under ``df``; where it has tasks enough nothing is moved.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df if source.rdd.getNumPartitions() >= tasks else df.repartition(tasks, by)


def _column_bytes(name: str, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(name), F.lit(0)) + 8
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(0))
    return F.lit(8)


def fits_broadcast(table: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure what the table's values take in one pass over it."""
    row = sum((_column_bytes(f.name, f.dataType) for f in table.schema), F.lit(0).cast("long"))
    return (table.agg(F.sum(row)).first()[0] or 0) <= max_bytes


def sized_join(
    left: DataFrame,
    table: DataFrame,
    keys: list[str],
    how: str = "inner",
    spread_by: list[str] | None = None,
    counts: DataFrame | None = None,
    max_bytes: int = BROADCAST_BYTES,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Join a large left side to a keyed table (``how`` is ``inner`` or ``left``).

    Broadcasts when the table was measured to be small; otherwise shuffles with hot keys salted.
    Pass a stored table, because it is measured before it is joined.
    """
    if fits_broadcast(table, max_bytes):
        return left.join(F.broadcast(table), keys, how)
    return salted_join(left, table, keys, how, spread_by, counts, task_rows)


def salted_join(
    left: DataFrame,
    table: DataFrame,
    keys: list[str],
    how: str = "inner",
    spread_by: list[str] | None = None,
    counts: DataFrame | None = None,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Shuffle join in which each hot key of the left side is cut over several tasks.

    A key is hot when it has more rows than a fair task; there are at most as many such keys as
    tasks, so the list of them is small enough to broadcast whatever the data holds. Only the hot
    keys' rows of ``table`` are repeated. ``spread_by`` names left columns that differ within a
    key, since the salt must come out the same when a lost task runs again. ``counts`` may give
    rows per key in a column ``count`` if the caller has them already.
    """
    spark = left.sparkSession
    if counts is None:
        counts = left.groupBy(*keys).count()
    counts = store(counts, "key-counts")
    total = counts.agg(F.sum("count")).first()[0] or 0
    fair = max(total / shuffle_tasks(spark), task_rows)
    hot = store(
        counts.filter(F.col("count") > fair).select(*keys, F.ceil(F.col("count") / fair).cast("int").alias("_salts")),
        "hot-keys",
    )
    if hot.isEmpty():
        return left.join(table, keys, how)
    others = spread_by or [c for c in left.columns if c not in keys]
    taken = {*left.columns, *table.columns}
    salt, salts = free_name("_salt", taken), free_name("_salts", taken)
    named = {k: free_name(f"_hot_{k}", taken) for k in keys}
    # Null keys match nothing in the table, but in a left join they are rows that must not meet in one task.
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(F.col(named[k]))
    hot = hot.withColumnRenamed("_salts", salts)
    renamed = hot.select(*[F.col(k).alias(named[k]) for k in keys], salts)
    salted_left = (
        left.join(F.broadcast(renamed), same, "left")
        .drop(*named.values())
        .withColumn(salt, F.pmod(F.xxhash64(*others), F.coalesce(salts, F.lit(1))).cast("int"))
        .drop(salts)
    )
    salted_table = (
        table.join(F.broadcast(hot), keys, "left")
        .withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(salts, F.lit(1)) - 1)))
        .drop(salts)
    )
    return salted_left.join(salted_table, [*keys, salt], how).drop(salt)


def spread(df: DataFrame, group: list[str], order: list[str | Column], task_rows: int = TASK_ROWS) -> DataFrame:
    """Get rows ready for ``running``.

    When every group fits a task, nothing changes. Otherwise only the rows of longer groups are
    range-partitioned on group and order, so that each is cut into consecutive pieces, and stored
    together with the number of their piece; all other rows stay where they are, in piece -1.
    ``order`` must tell the rows of a group apart.
    """
    sizes = store(df.groupBy(*group).count().filter(F.col("count") > task_rows), "long-groups")
    total = sizes.agg(F.sum("count")).first()[0]
    if total is None:
        return df
    # every long group has over ``task_rows`` rows, so this list is short whatever the data holds
    named = {g: free_name(f"_long_{g}", df.columns) for g in group}
    long = F.broadcast(sizes.select(*[F.col(g).alias(n) for g, n in named.items()]))
    same = F.lit(True)
    for g, n in named.items():
        same = same & F.col(g).eqNullSafe(F.col(n))
    pieces = max(shuffle_tasks(df.sparkSession), -(-total // task_rows))
    cut = df.join(long, same, "left_semi").repartitionByRange(pieces, *group, *order)
    cut = store(cut.withColumn(PART, F.spark_partition_id()), "pieces")
    return cut.unionByName(df.join(long, same, "left_anti").withColumn(PART, F.lit(-1)))


Total = tuple[Callable[[Column], Column], Column, bool]


def running(df: DataFrame, group: list[str], order: list[str | Column], totals: dict[str, Total]) -> DataFrame:
    """Add running totals in the given order of each group.

    ``totals`` maps a new column to ``(F.sum or F.max, value, with the current row)``. Rows that
    came cut from ``spread`` get the total within their piece, combined with that of the pieces
    before it. A piece boundary lies inside at most one group, so what is carried over has fewer
    rows than there are pieces; it is broadcast. The result is stored, so that further totals on
    the same pieces do not repeat these. Drop the column ``PART`` when done.
    """
    cut = PART in df.columns
    window = Window.partitionBy(*group, *([PART] if cut else [])).orderBy(*order)
    frames = {
        True: window.rowsBetween(Window.unboundedPreceding, Window.currentRow),
        False: window.rowsBetween(Window.unboundedPreceding, -1),
    }
    within = {name: add(value).over(frames[with_row]) for name, (add, value, with_row) in totals.items()}
    if not cut:
        return df.withColumns(within)

    by_piece = Window.partitionBy(*group).orderBy(PART)
    before = by_piece.rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        df.filter(F.col(PART) >= 0)
        .groupBy(*group, PART)
        .agg(*[add(value).alias(name) for name, (add, value, _) in totals.items()])
        .select(
            *[F.col(g).alias(f"_at_{g}") for g in group],
            F.col(PART).alias("_at_part"),
            F.row_number().over(by_piece).alias("_nth"),
            *[add(name).over(before).alias(f"_before_{name}") for name, (add, _, _) in totals.items()],
        )
        .filter("_nth > 1")
        .drop("_nth")
    )
    same = F.col(PART) == F.col("_at_part")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_at_{g}"))
    joined = df.withColumns(within).join(F.broadcast(carried), same, "left")
    combined = {}
    for name, (add, _, _) in totals.items():
        here, earlier = F.col(name), F.col(f"_before_{name}")
        combined[name] = F.greatest(here, earlier) if add is F.max else F.coalesce(here + earlier, here, earlier)
    return store(joined.withColumns(combined).select(*df.columns, *totals), "totals")


def number(df: DataFrame, order: list[str | Column], name: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """Add ``name``, the place 1, 2, ... of each row in the given order over the whole table.

    Pass a stored table, because it is counted before it is numbered.
    """
    one_group = df.withColumn("_all", F.lit(0))
    cut = spread(one_group, ["_all"], order, task_rows)
    return running(cut, ["_all"], order, {name: (F.sum, F.lit(1), True)}).select(*df.columns, name)
