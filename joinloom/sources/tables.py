"""Parquet tables as relations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, sf_dir: str, name: str, *columns: str, **casts: str) -> DataFrame:
    """The named columns of a table, in this order; casts: types that columns are widened to. Only
    these columns are read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[F.col(c).cast(casts[c]).alias(c) if c in casts else F.col(c) for c in columns]) if columns else df


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, on any file system that Spark knows."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at))


def kept_or_made(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, which is made and written first unless a writer has finished it before."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
