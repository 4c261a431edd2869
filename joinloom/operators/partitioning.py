"""Radix partitions of a relation by bits of a key, their sizes and offsets, and work units."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from joinloom.functions.bits import radix

#: Partition numbers are listed, and their offsets summed, in one task: so many at most.
MOST_BITS = 20


def radix_partitioned(df: DataFrame, key: str, bits: int, first_bit: int = 0) -> DataFrame:
    """The rows, dealt and ordered by partition number, which is column `part`."""
    return df.withColumn("part", radix(F.col(key), bits, first_bit)).repartition("part").sortWithinPartitions("part")


def histogram(df: DataFrame, key: str, bits: int, first_bit: int = 0) -> DataFrame:
    """(part, n) of the partitions that have rows."""
    return df.groupBy(radix(F.col(key), bits, first_bit).alias("part")).agg(F.count("*").alias("n"))


def offsets(df: DataFrame, key: str, bits: int, first_bit: int = 0) -> DataFrame:
    """(part, n, end_offset) of all 2**bits partitions, empty ones included; end_offset is the number of
    rows up to the partition's end. The data are counted before anything is gathered."""
    if bits > MOST_BITS:
        raise ValueError(f"at most {MOST_BITS} bits")
    every = df.sparkSession.range(1 << bits).withColumnRenamed("id", "part")
    dense = every.join(histogram(df, key, bits, first_bit), "part", "left").select("part", F.coalesce("n", F.lit(0)).alias("n"))
    return dense.withColumn("end_offset", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)))


def two_level(df: DataFrame, key: str, bits1: int, bits2: int, first_bit: int = 0) -> DataFrame:
    """(p1, p2, n): partitions of the second level, by the lower bits2 bits, within those of the first,
    by the bits1 bits above them."""
    k = F.col(key)
    return df.groupBy(radix(k, bits1, first_bit + bits2).alias("p1"), radix(k, bits2, first_bit).alias("p2")).agg(F.count("*").alias("n"))


def work_units(df: DataFrame, key: str, bits: int, most: int, first_bit: int = 0) -> DataFrame:
    """(part, unit, len): each partition cut into units of at most `most` rows."""
    units = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / most)))
    cut = histogram(df, key, bits, first_bit).withColumn("unit", units)
    return cut.select("part", "unit", F.least(F.lit(most).cast("long"), F.col("n") - F.col("unit") * most).alias("len"))
