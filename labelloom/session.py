"""A local Spark session for tests and timings. On a cluster, use the session it gives you."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(
    cpus: int | str = 8, shuffle_partitions: int = 8, memory: str = "12g", shared: str | None = None
) -> SparkSession:
    """``shared`` is the folder for stored intermediates (``spark.checkpoint.dir``); unset, the warehouse is used."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("labelloom")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
