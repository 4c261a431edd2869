"""Filters, projections, row positions and materialisation, as functions from relations to relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from joinloom.storage import written


def filtered(df: DataFrame, *conditions: Column) -> DataFrame:
    """Rows for which all conditions hold. They reach the scan, where the reader can use them."""
    for c in conditions:
        df = df.filter(c)
    return df


def in_range(column: str, low: object, high: object) -> Column:
    return F.col(column).between(low, high)


def either_way(a: str, b: str, x: object, y: object) -> Column:
    """(a, b) is (x, y) or (y, x)."""
    return ((F.col(a) == x) & (F.col(b) == y)) | ((F.col(a) == y) & (F.col(b) == x))


def projected(df: DataFrame, *columns: str, **computed: Column) -> DataFrame:
    """The columns, in this order, then the computed ones."""
    return df.select(*columns, *[c.alias(n) for n, c in computed.items()])


def peek(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows by an order, which a relation has none of by itself; n of 0 or less: all."""
    return df.orderBy(*order).limit(n) if n > 0 else df.orderBy(*order)


def counted(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count("*").alias(name))


def row_ids(spark: SparkSession, df: DataFrame, order: list[str], name: str = "rid", start: int = 0) -> DataFrame:
    """The rows and their number in a global order, from start. Rows are dealt by ranges of the order
    and written; each task numbers its range, to which the sizes of earlier ranges, one number for
    each, are added. Rows that tie are numbered in any order."""
    dealt, _ = written(spark, df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    rows = dealt.withColumn("_own", number).join(sizes, "_part")
    return rows.withColumn(name, (F.col("_own") + F.col("_before") - 1 + start).cast("long")).drop("_own", "_before", "_part")


def gathered(source: DataFrame, positions: DataFrame, at: str, index: str) -> DataFrame:
    """For each row of positions (index, ...) the source row whose column `at` is that index."""
    return positions.join(source.withColumnRenamed(at, index), index)


def materialised(df: DataFrame) -> None:
    """Computes every row and keeps none; what a benchmark times."""
    df.write.format("noop").mode("overwrite").save()
