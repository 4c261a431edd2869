"""A session with the settings that the library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "joinloom", master: str | None = None, shuffle_partitions: int | None = None, **more: str) -> SparkSession:
    """master: only where no launcher sets one. shuffle_partitions: about twice the cluster's cores, or
    one for each 128 MB shuffled if that is more; adaptive execution merges what is too small."""
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | more)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()
