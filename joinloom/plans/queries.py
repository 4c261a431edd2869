"""Join plans over TPC-style tables and the star pipeline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinloom.operators.joins import equi_join
from joinloom.operators.relational import filtered, in_range
from joinloom.sources.tables import scan
from joinloom.sources.workloads import star


def day(text: str):
    return F.lit(text).cast("timestamp_ntz")


def q7(spark: SparkSession, sf_dir: str, strategy: str = "AUTO", first: str = "1995-01-01", last: str = "1996-12-31") -> DataFrame:
    """Shipped lines of a range of days with the nation of the customer who ordered them. The strategy
    is that of the last and largest join; the others are left to the optimizer."""
    lines = filtered(scan(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_discount"), in_range("l_shipdate", day(first), day(last)))
    customers = equi_join(scan(spark, sf_dir, "nation", "n_nationkey", "n_name"), scan(spark, sf_dir, "customer", "c_nationkey", "c_custkey"), ("n_nationkey", "c_nationkey"))
    orders = equi_join(customers.select("c_custkey", "n_name"), scan(spark, sf_dir, "orders", "o_custkey", "o_orderkey"), ("c_custkey", "o_custkey"))
    joined = equi_join(orders.select("o_orderkey", "n_name"), lines, ("o_orderkey", "l_orderkey"), strategy)
    return joined.select(F.col("o_orderkey").alias("l_orderkey"), "l_suppkey", "l_shipdate", "l_extendedprice", "l_discount", "n_name")


def q18(spark: SparkSession, sf_dir: str, strategy: str = "AUTO") -> DataFrame:
    orders = equi_join(scan(spark, sf_dir, "customer", "c_custkey", "c_name"), scan(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"), ("c_custkey", "o_custkey"))
    return equi_join(orders.select("o_orderkey", "c_name", "o_orderdate", "o_totalprice"), scan(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity"), ("o_orderkey", "l_orderkey"), strategy)


def q19(spark: SparkSession, sf_dir: str, strategy: str = "AUTO") -> DataFrame:
    """The tables at hand have no ship mode, instruction and container: return flag, line status and
    type stand in for them."""
    lines = scan(spark, sf_dir, "lineitem", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus")
    lines = filtered(lines, F.col("l_returnflag").isin("A", "R") & (F.col("l_linestatus") == "O")).drop("l_returnflag", "l_linestatus")
    return equi_join(scan(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type", "p_size"), lines, ("p_partkey", "l_partkey"), strategy)


def q64(spark: SparkSession, sf_dir: str, strategy: str = "AUTO") -> DataFrame:
    """A wide join: one payload column on the left, ten on the right."""
    wide = ["l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    return equi_join(scan(spark, sf_dir, "part", "p_partkey", "p_brand"), scan(spark, sf_dir, "lineitem", "l_partkey", *wide), ("p_partkey", "l_partkey"), strategy)


def q95(spark: SparkSession, sf_dir: str, strategy: str = "SMJ") -> DataFrame:
    """A self-join: all pairs of lines of an order. Both sides are the fact table, which is never to be
    broadcast, however small the optimizer may find it: they are merged unless told otherwise."""
    lines = scan(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey")
    a, b = (lines.select(F.col("l_orderkey").alias("order_number"), F.col("l_suppkey").alias(w)) for w in ("wh1", "wh2"))
    return equi_join(a, b, "order_number", strategy)


def star_join(fact: DataFrame, dim: DataFrame, strategy: str = "AUTO") -> DataFrame:
    """fact(tid, fk0 .. fk7) joined with dim(k, p) once for each foreign key, to k (the last key), p7
    .. p0, tid. All keys travel in the row, so no join fetches."""
    n = len(fact.columns) - 1

    def step(rows: DataFrame, j: int) -> DataFrame:
        return equi_join(dim.select(F.col("k").alias(f"fk{j}"), F.col("p").alias(f"p{j}")), rows, f"fk{j}", strategy)

    joined = reduce(step, range(n), fact)
    return joined.select(F.col(f"fk{n - 1}").alias("k"), *[f"p{j}" for j in reversed(range(n))], "tid")


def star_join_8(spark: SparkSession, n_fact: int = 2000, n_dim: int = 256, strategy: str = "AUTO") -> DataFrame:
    return star_join(*star(spark, n_fact, n_dim), strategy)
