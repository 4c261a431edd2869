"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinloom.llm.common import dropped, written


def star_components(spark: SparkSession, links: DataFrame, most: int | None = None) -> DataFrame:
    """links(a, b): long node ids; most: how many there can be, if that is known. Returns (node, root)
    for every node that has a link to another; root is the smallest id of the node's component, and a
    root is listed with itself.

    Each round replaces links by links to the least neighbour and writes them to the shared folder,
    so that nothing but a count and a checksum reaches the driver. A node with very many links is
    met by partial aggregation and by the adaptive splitting of skewed joins. No links: no rows."""
    edges = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, path = written(spark, edges, "links", most)
    seen = _mark(edges)
    while seen[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after, new = written(spark, small.unionByName(down.select("a", F.col("m").alias("b"))).distinct(), "links", seen[0])
        dropped(spark, path)
        edges, path, mark = after, new, _mark(after)
        if mark == seen:
            break
        seen = mark
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple[int, int | None]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]
