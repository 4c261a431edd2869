"""Synthetic join inputs in closed form: the same rows at every run and on every cluster.

Keys are a permutation of positions, so no row waits for another: generation needs no shuffle and no
random state, and multiplicities are exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from joinloom.functions.bits import FK_MULTIPLIER, FK_OFFSET, PK_MULTIPLIER, PK_OFFSET, permuted

#: What rows without a partner have added to their key.
MISS = 1 << 30
ZIPF_ONE = 1 << 20
ZIPF_DRAW = (2654435761, 12345)
#: Ranks whose weights are summed in one task.
ZIPF_RANGE = 1 << 16


def positions(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "pos")


def primary_keys(spark: SparkSession, n: int, key: str = "long") -> DataFrame:
    """(pos, k): each of 0 .. n - 1 once."""
    return positions(spark, n).withColumn("k", permuted(F.col("pos"), n, PK_MULTIPLIER, PK_OFFSET).cast(key))


def uniform_keys(spark: SparkSession, n: int, n_pk: int, key: str = "long") -> DataFrame:
    """(pos, k): n foreign keys of n_pk primary keys: each n // n_pk times, and the first n % n_pk of
    the primary keys once more."""
    at = permuted(F.col("pos"), n, FK_MULTIPLIER, FK_OFFSET) % n_pk
    return positions(spark, n).withColumn("k", permuted(at, n_pk, PK_MULTIPLIER, PK_OFFSET).cast(key))


def cyclic_keys(spark: SparkSession, n: int, unique: int, key: str = "long") -> DataFrame:
    """(pos, k): n keys of `unique` different ones, in turn; for many-to-many joins."""
    return positions(spark, n).withColumn("k", (F.col("pos") % unique).cast(key))


def zipf_weight(z: float) -> Column:
    if 2 * z != int(2 * z):
        return F.floor(F.lit(float(ZIPF_ONE)) / F.pow("i", F.lit(float(z))))
    k, one = int(2 * z), ZIPF_ONE**2
    if not k:
        return F.lit(ZIPF_ONE)
    most = int(one ** (1 / k)) + 1  # beyond it the quotient is zero, and the power may be no long
    quotient = F.expr(f"{one} div ({' * '.join(['i'] * k)})")
    return F.when(F.col("i") <= most, F.floor(F.sqrt(quotient.cast("double")))).otherwise(0)


def zipf_keys(spark: SparkSession, n: int, alphabet: int, z: float, key: str = "long") -> DataFrame:
    """(pos, k): n keys of 1 .. alphabet; key i has weight 2**20 // i**z, one at least. Where 2 * z is whole,
    that is the whole root of 2**40 // i**(2 * z), in whole numbers, so that any engine has the same.

    Weights are summed by ranges of ranks, then over the ranges. A draw finds its rank's interval by
    the cell of the line it falls into: intervals are listed under each cell that they touch, so the
    join is an equi-join with at most alphabet + cells rows on that side, and a hot rank, which
    touches most cells, is spread over them."""
    weight = F.greatest(F.lit(1), zipf_weight(z)).cast("long")
    ranks = spark.range(1, alphabet + 1).select(F.col("id").alias("i"), F.floor(F.col("id") / ZIPF_RANGE).alias("part")).withColumn("w", weight)
    sums = ranks.groupBy("part").agg(F.sum("w").alias("all"))
    sums = sums.select("part", F.coalesce(F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.sum("w").over(Window.partitionBy("part").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    spans = ranks.withColumn("own", own).join(sums, "part").select("i", (F.col("before") + F.col("own")).alias("hi"), "w").select("i", (F.col("hi") - F.col("w")).alias("lo"), "hi")
    total = int(ranks.agg(F.sum("w").alias("t")).first()["t"])
    width = max(1, total // max(alphabet, min(n, 1 << 16)))

    def cell(x: Column) -> Column:
        return F.floor(x / width).cast("long")

    spans = spans.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi") - 1))))
    step, offset = ZIPF_DRAW
    draw = (F.col("pos") % total * F.lit(step % total).cast("long") + F.lit(offset % total).cast("long")) % total
    draws = positions(spark, n).withColumn("u", draw).withColumn("cell", cell(F.col("u")))
    return draws.join(spans, "cell").where("u >= lo and u < hi").select("pos", F.col("i").cast(key).alias("k"))


def missed(keys: DataFrame, one_in: int) -> DataFrame:
    """Keys of which one in `one_in`, by position, keeps its partner; the others get none."""
    kind = dict(keys.dtypes)["k"]
    return keys.withColumn("k", F.when(F.col("pos") % one_in == 0, F.col("k")).otherwise(F.col("k") + MISS).cast(kind))


def first_of(keys: DataFrame, n: int, one_in: int) -> DataFrame:
    """The first n // one_in of n keys by position: the other way to lower a match rate."""
    return keys.where(F.col("pos") < n // one_in)


def drawn_keys(spark: SparkSession, n: int, low: int, high: int, seed: int = 42, key: str = "long") -> DataFrame:
    """(pos, k): n keys drawn evenly from low .. high, with repeats, by a hash of the position."""
    draw = F.pmod(F.xxhash64(F.lit(seed), "pos"), F.lit(high - low + 1).cast("long")) + low
    return positions(spark, n).withColumn("k", draw.cast(key))


def with_payload(keys: DataFrame, names: list[str], payload: str | None = None) -> DataFrame:
    """k and payload columns that are copies of it, in the type asked for."""
    return keys.select("k", *[(F.col("k").cast(payload) if payload else F.col("k")).alias(n) for n in names])


def constant(spark: SparkSession, n: int, value: int) -> DataFrame:
    return spark.range(n).select(F.lit(value).alias("k"))


def star(spark: SparkSession, n_fact: int, n_dim: int, joins: int = 8) -> tuple[DataFrame, DataFrame]:
    """fact(tid, fk0 ..) and dim(k, p): p is ten times k, so that they can't be mistaken."""
    tid = F.col("tid")
    keys = [((tid * (3 + 2 * j) + j) % n_fact % n_dim).alias(f"fk{j}") for j in range(joins)]
    fact = spark.range(n_fact).withColumnRenamed("id", "tid").select("tid", *keys)
    return fact, spark.range(n_dim).select(F.col("id").alias("k"), (F.col("id") * 10).alias("p"))
