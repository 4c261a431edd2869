"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from fractions import Fraction
from math import lcm

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from joinloom.llm.common import pick, written

WEIGHTS = (3, 1, 2)
#: The mix's words for each word there is, and the most passes over a source.
SHARE = Fraction(3, 2)
EPOCHS = 2
#: A copy of more words is queued in pieces of so many, as a network's messages are in packets: it is
#: by less than a piece that a source can be behind or ahead of its share.
PIECE = 256
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"


#: Rows that a running sum goes over in one task, about; rows are dealt into ranges of so many.
RANGE_ROWS = 200_000


def ranked(spark: SparkSession, sources: DataFrame) -> DataFrame:
    """sources and, as `at`, each one's place in code-point order, null last, from 0. Nothing is
    gathered in one task: rows are dealt by ranges of the order, written, and numbered within their
    partition; the sizes of earlier partitions, one number for each, are added."""
    order = F.col("source").asc_nulls_last()
    dealt, _ = written(spark, sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "sources")
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))
    earlier = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    numbered = dealt.withColumn("own", F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1)
    return numbered.join(earlier, "part").withColumn("at", F.col("own") + F.col("earlier")).drop("part", "own", "earlier")


def running(rows: DataFrame, group: list[str], part: str, order: list, value: str, below: int | None = None) -> DataFrame:
    """rows and, as `before`, the sum of value over the rows of the group that come earlier: those of
    lower parts, and those of the same part earlier in the order. A part is a range of the order, so
    a task sums one range and a group of any size is spread over many. below: parts that begin at that
    sum or later are left out."""
    sums = rows.groupBy(*group, part).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_earlier", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    if below is not None:
        sums = sums.where(F.col("_earlier") < below)
    within = Window.partitionBy(*group, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("_own", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return summed.join(sums, [*group, part]).withColumn("before", (F.col("_own") + F.col("_earlier")).cast("long")).drop("_own", "_earlier", part)


def targets(spark: SparkSession, sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """sources(source, source_size long) to (source, source_size, weight long, target double, at long).

    Sources in code-point order, null last, weigh weights, repeating. They share `share` of all sizes
    by weight; a target stops at epochs times its source's size, and what it can't use is shared
    again. That ends where target = min(cap, level * weight): each round sums the caps below the level
    and spreads the rest over the weights above it, in whole numbers, until the level stands. Only
    these sums reach the driver. at: the source's place in the order."""
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    rows = ranked(spark, sources)
    rows = rows.withColumn("weight", F.element_at(cycle, (F.col("at") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * epochs)
    rows, _ = written(spark, rows, "weights")
    budget = share * int(rows.agg(F.sum("source_size").alias("n")).first()["n"] or 0)
    level = Fraction(0)
    while budget:
        full = F.col("cap").cast("decimal(38,0)") * level.denominator <= F.col("weight").cast("decimal(38,0)") * F.lit(level.numerator).cast("decimal(38,0)")
        got = rows.agg(F.sum(F.when(full, F.col("cap"))).alias("caps"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not got["open"]:
            break
        new = (budget - int(got["caps"] or 0)) / int(got["open"])
        if new <= level:
            break
        level = new
    return rows.select("source", "source_size", "weight", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(float(level))).alias("target"), "at")


def dealt(seed: int) -> Column:
    """Where a document comes in its source: 60 bits of a hash of its id and text."""
    own = F.concat_ws("/", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    return F.conv(F.substring(F.md5(own.cast("binary")), 1, 15), 16, 10).cast("long")


def mix(spark: SparkSession, documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, epochs: int = EPOCHS, seed: int = SEED, piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """Returns (rows, sequence).

    rows: row long, doc_id, source, size, source_size, target, for every document row. sequence: the
    mix in order: row, epoch int, start long (words of the document before it), words long, finish
    long (its virtual finish time, times the weights' least common multiple), position long (the
    mix's words before it).

    A source's documents are shuffled by a seeded hash, and wait in that order, `epochs` times over,
    each copy in pieces of at most `piece` words. A piece's virtual finish time is the source's words
    up to its end, over all passes, divided by the source's weight: a whole number, by the least common
    multiple of the weights. All sources' pieces are range-sorted by finish time, ties by the sources'
    order, and the mix is what comes before `share` of all words is used up; the piece that crosses
    that is cut. A source with fewer words than its share runs dry, and the others go on. target is
    what the fluid limit of the queue would give the source: no row is taken by it.

    A null text has size 0; documents of size 0 are never taken. Null sources are one source. Rows of
    one doc_id are separate documents; of rows equal in all columns it is undefined, and without
    effect, which is taken. Reruns agree, since order depends on the rows' values alone. A size that
    would take finish times beyond a long is an error. No rows: no rows. Other columns are ignored,
    whatever their names."""
    docs = pick(documents, "doc_id", "text", "source")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select("doc_id", "source", size.alias("size"), dealt(seed).alias("dealt"), F.monotonically_increasing_id().alias("row"))
    sized, _ = written(spark, sized, "sizes")
    aims = targets(spark, sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, epochs)
    total = int(aims.agg(F.sum("source_size").alias("n")).first()["n"] or 0)
    unit = lcm(*weights)
    if total * epochs * unit >= 2**63:
        raise ValueError(f"{total} words, {epochs} times over, have finish times in units of 1/{unit} beyond a long")

    bits = max(6, (sized.count() // RANGE_ROWS).bit_length())
    own = aims.withColumnRenamed("source", "_s")
    rows = sized.join(own, sized["source"].eqNullSafe(own["_s"])).drop("_s")
    placed = running(rows.withColumn("part", F.shiftright("dealt", 60 - bits)), ["at"], "part", ["dealt", F.col("doc_id").asc_nulls_first(), "size"], "size")

    many = F.ceil(F.col("size") / piece)
    queued = placed.where("size > 0").withColumn("many", many).withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") * epochs - 1)))
    queued = queued.withColumn("epoch", F.floor(F.col("n") / F.col("many"))).withColumn("start", F.col("n") % F.col("many") * piece)
    queued = queued.withColumn("words", F.least(F.lit(piece).cast("long"), F.col("size") - F.col("start")))
    ends = F.col("before") + F.col("epoch") * F.col("source_size") + F.col("start") + F.col("words")
    queued = queued.select("row", F.col("epoch").cast("int").alias("epoch"), "start", "words", (ends * F.expr(f"{unit} div weight")).alias("finish"), "at")
    # No two pieces of a source finish together, so this order is total.
    order = ["finish", "at"]
    queue, _ = written(spark, queued.repartitionByRange(*order).withColumn("part", F.spark_partition_id()).withColumn("_all", F.lit(0)), "queue")
    budget = int(share * total)
    taken = running(queue, ["_all"], "part", order, "words", budget).where(F.col("before") < budget)
    sequence = taken.select("row", "epoch", "start", F.least("words", F.lit(budget) - F.col("before")).alias("words"), "finish", F.col("before").alias("position"))
    return rows.select("row", "doc_id", "source", "size", "source_size", "target"), sequence


def mixed(spark: SparkSession, documents: DataFrame, **how) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: a row for each document row; see mix()."""
    rows, sequence = mix(spark, documents, **how)
    taken = sequence.groupBy("row").agg(F.sum("words").alias("taken"))
    return rows.join(taken, "row", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
