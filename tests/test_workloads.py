"""Invariants of generated inputs, partitions, raw files and the experiment runner."""

from collections import Counter
from math import gcd

import pytest
from pyspark.sql import functions as F

from joinloom.functions.bits import permuted, radix
from joinloom.operators import partitioning
from joinloom.operators.joins import checksum, equi_join
from joinloom.operators.relational import peek, row_ids
from joinloom.plans import experiments
from joinloom.sources import raw
from joinloom.sources import workloads as w
from joinloom.sources.tables import exists, kept_or_made


@pytest.mark.parametrize("n", [1, 2, 7, 97, 1024, 5489])
def test_permutations(spark, n):
    got = spark.range(n).select(permuted(F.col("id"), n).alias("k")).collect()
    assert sorted(r.k for r in got) == list(range(n))


def test_permutation_of_a_large_range_stays_within_a_long(spark):
    n = 2**40
    step = min(2654435761 % n, (2**63 - 43) // n)
    while gcd(step, n) > 1:
        step -= 1
    got = spark.range(n - 3, n).select(permuted(F.col("id"), n).alias("k")).collect()
    assert [r.k for r in got] == [(i * step + 42) % n for i in range(n - 3, n)]


def test_uniform_multiplicities(spark):
    n = Counter(r.k for r in w.uniform_keys(spark, 1000, 64).collect())
    assert len(n) == 64 and Counter(n.values()) == {16: 40, 15: 24}


def test_match_rate_and_checksum(spark):
    r = w.with_payload(w.missed(w.primary_keys(spark, 256), 4), ["r1"])
    s = w.with_payload(w.uniform_keys(spark, 1024, 256), ["s1"])
    got = checksum(equi_join(r, s, "k"), "k").first()
    kept = sum(x.k for x in w.primary_keys(spark, 256).where("pos % 4 = 0").collect())
    assert (got.n, got.key_sum) == (256, 4 * kept)


@pytest.mark.parametrize("z", [0, 0.25, 0.5, 1, 1.75, 2])
def test_zipf(spark, z):
    weights = [max(1, int(w.ZIPF_ONE / i**z)) for i in range(1, 101)]
    total, step, offset = sum(weights), *w.ZIPF_DRAW
    ends = [sum(weights[: i + 1]) for i in range(100)]
    want = Counter(next(k + 1 for k, e in enumerate(ends) if (p * step + offset) % total < e) for p in range(500))
    assert Counter(r.k for r in w.zipf_keys(spark, 500, 100, z).collect()) == want


@pytest.mark.parametrize("bits, first", [(1, 0), (6, 0), (4, 3), (9, 30)])
def test_radix_partitions(spark, bits, first):
    keys = [0, 1, -1, -(2**40), 2**40 + 5, 2**62, 77, 77, 8]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    want = Counter(((k % 2**64) >> first) % 2**bits for k in keys)
    assert {r.part: r.n for r in partitioning.histogram(df, "k", bits, first).collect()} == want
    dense = partitioning.offsets(df, "k", bits, first).orderBy("part").collect()
    assert [r.part for r in dense] == list(range(2**bits)) and dense[-1].end_offset == len(keys)
    assert all(a.end_offset + b.n == b.end_offset for a, b in zip(dense, dense[1:], strict=False))
    units = partitioning.work_units(df, "k", bits, 2, first).collect()
    assert sum(u.len for u in units) == len(keys) and max(u.len for u in units) <= 2
    dealt = partitioning.radix_partitioned(df, "k", bits, first).withColumn("task", F.spark_partition_id()).collect()
    assert len(dealt) == len(keys) and len({(r.part, r.task) for r in dealt}) == len(want)


def test_row_ids_and_peek(spark):
    df = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("v"))
    assert all(r.rid == r.v for r in row_ids(spark, df, ["v"]).collect())
    assert [r.v for r in peek(df, 3, "v").collect()] == [0, 1, 2] and peek(df, 0, "v").count() == 1000
    assert row_ids(spark, df.limit(0), ["v"]).count() == 0


@pytest.mark.parametrize("kind", ["int", "bigint", "float", "double"])
def test_raw_files(spark, kind):
    df = spark.range(1000).select((F.col("id") - 500).cast(kind).alias("v")).repartition(3)
    folder = raw.write_raw(spark, df, "v")
    got = raw.read_raw(spark, folder, "v", kind, block=64).collect()
    assert sorted(r.v for r in got) == list(range(-500, 500)) and sorted(r.pos for r in got) == list(range(1000))
    assert raw.read_raw(spark, folder, "v", kind, to="bigint").dtypes[1] == ("v", "bigint")


def test_raw_files_refuse_nulls_and_cut_values(spark):
    with pytest.raises(Exception, match="nulls"):
        raw.write_raw(spark, spark.createDataFrame([(1,), (None,)], "v int"), "v")
    folder = raw.write_raw(spark, spark.range(3).select(F.col("id").cast("int").alias("v")).coalesce(1), "v")
    with pytest.raises(ValueError, match="ends inside"):
        raw.read_raw(spark, folder, "v", "bigint")


def test_radix_reads_twos_complement(spark):
    assert spark.range(1).select(radix(F.lit(-1), 8).alias("p")).first().p == 255


def test_runner_keeps_going_and_appends(spark, tmp_path):
    some = [experiments.Config(nr=20, ratio=1, pr=1, ps=1, algo=a) for a in ("smj", "phj", "nonsense")]
    some.append(experiments.Config(nr=20, ratio=0, pr=2, ps=1, dist="zipf", zipf_factor=0.75, algo="smji"))
    some.append(experiments.Config(nr=20, ratio=0, pr=1, ps=1, join_type="fkfk", unique_keys=18, algo="shj"))
    sink = f"file://{tmp_path}/runs"
    for _ in range(2):
        found = experiments.run(spark, some, sink, smaller=12, repeats=1)
    assert [r["rows"] for r in found] == [512, 512, None, 256, 1024]
    assert "nonsense" in found[2]["error"] and found[3]["strategy"] == "SMJI"
    assert spark.read.csv(sink, header=True).count() == 10


@pytest.mark.parametrize("name, columns", [("vanilla", "algo nr ratio pr ps"), ("skew", "algo nr ratio pr ps zipf_factor"), ("matchrate", "algo nr pr ps selectivity")])
def test_choices_are_in_order(spark, name, columns):
    places = [tuple(getattr(c, n) for n in columns.split()) for c in experiments.configs(experiments.choice(spark, name))]
    assert places == sorted(places) and len(set(places)) == len(places)


def test_choices_run(spark):
    found = experiments.configs(experiments.choice(spark, "8b8b"))
    assert len(found) == 24
    rows = experiments.run(spark, found[:2], widths=experiments.WIDTHS["8b8b"], smaller=16, repeats=1)
    assert all(not r["error"] and r["rows"] == 2 ** (r["nr"] + r["ratio"] - 16) for r in rows)


def test_star_steps(spark, tmp_path):
    fact, dim = w.star(spark, 300, 16)
    rows = experiments.star_steps(fact, dim, "SHJ", f"file://{tmp_path}/star")
    assert [r["jid"] for r in rows] == list(range(8)) and spark.read.csv(f"file://{tmp_path}/star", header=True).count() == 8


def test_other_generators(spark):
    assert [r.pos for r in w.first_of(w.primary_keys(spark, 100), 100, 8).orderBy("pos").collect()] == list(range(12))
    drawn = [r.k for r in w.drawn_keys(spark, 5000, -3, 6).collect()]
    assert set(drawn) == set(range(-3, 7)) and max(Counter(drawn).values()) < 700
    assert [r.k for r in w.drawn_keys(spark, 5000, -3, 6).orderBy("pos").collect()] == [r.k for r in w.drawn_keys(spark, 5000, -3, 6).orderBy("pos").collect()]


def test_inputs_are_made_once(spark, tmp_path):
    path, made = f"file://{tmp_path}/r", []

    def make():
        made.append(1)
        return w.primary_keys(spark, 50)

    first, again = (kept_or_made(spark, path, make) for _ in range(2))
    assert len(made) == 1 and sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect()))
    assert exists(spark, path) and not exists(spark, f"{path}-none")
