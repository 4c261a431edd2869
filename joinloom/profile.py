"""Timed runs, appended to CSV folders."""

from __future__ import annotations

import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from joinloom.operators.relational import materialised


def append_csv(spark: SparkSession, rows: list[dict], sink: str) -> None:
    """Appends rows with the same keys to a folder of CSV files, through Spark, so that any file system
    it knows will do. Columns are text unless all their values are whole numbers or numbers."""
    if not rows:
        return

    def kind(name: str):
        given = [r[name] for r in rows if r[name] is not None]
        whole = all(isinstance(x, int) and not isinstance(x, bool) for x in given)
        return LongType() if given and whole else DoubleType() if given and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in given) else StringType()

    schema = StructType([StructField(n, kind(n)) for n in rows[0]])
    cast = {LongType: int, DoubleType: float, StringType: str}
    values = [tuple(None if r[f.name] is None else cast[type(f.dataType)](r[f.name]) for f in schema) for r in rows]
    spark.createDataFrame(values, schema).coalesce(1).write.mode("append").csv(sink, header=True)


def profiled(df: DataFrame, sink: str | None = None, **labels) -> dict:
    """Computes every row of df, keeps none, and returns utc, the labels and seconds. There is one clock
    for the whole plan: Spark runs its phases in one pipeline, which has no time of its own for each."""
    began, utc = time.perf_counter(), datetime.now(timezone.utc).isoformat()
    materialised(df)
    row = {"utc": utc, **labels, "seconds": time.perf_counter() - began}
    if sink:
        append_csv(df.sparkSession, [row], sink)
    return row
