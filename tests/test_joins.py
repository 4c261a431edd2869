"""The four strategies: equal rows, the plans that were asked for, and cases at the edge."""

import itertools

import pytest
from pyspark.sql import functions as F

from joinloom.operators.joins import STRATEGIES, equi_join, plan_of, strategy_of
from joinloom.plans import queries as plans
from joinloom.sources import workloads as w

ALL = list(STRATEGIES)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def sides(spark, name):
    if name == "pkfk":
        return w.with_payload(w.primary_keys(spark, 512), ["r1", "r2"]), w.with_payload(w.uniform_keys(spark, 2048, 512), ["s1", "s2"])
    if name == "fkfk":
        return tuple(w.cyclic_keys(spark, n, 32).select("k", F.col("pos").alias(p)) for n, p in ((128, "r1"), (256, "s1")))
    if name == "misses":
        return w.with_payload(w.missed(w.primary_keys(spark, 512), 8), ["r1"]), w.with_payload(w.uniform_keys(spark, 2048, 512), ["s1"])
    if name == "half on one key":
        s = w.uniform_keys(spark, 2048, 512).withColumn("k", F.when(F.col("pos") % 2 == 0, F.lit(7).cast("long")).otherwise(F.col("k")))
        return w.with_payload(w.primary_keys(spark, 512), ["r1"]), s.withColumnRenamed("pos", "s1").select("k", "s1")
    schema = "k long, {0} long"
    given = {
        "null keys": ([(None, 1), (1, 2), (2, None)], [(None, 3), (1, 4), (1, 4), (2, None)]),
        "no match": ([(1, 1)], [(2, 2)]),
        "empty left": ([], [(1, 1)]),
        "empty right": ([(1, 1)], []),
        "one key": ([(5, i) for i in range(20)], [(5, i) for i in range(30)]),
        "high bits and negative": ([(-1, 1), (2**40 + 1, 2), (2**41 + 1, 3), (-(2**40), 4)], [(-1, 5), (2**40 + 1, 6), (2**41 + 1, 7), (1, 8), (-(2**40), 9)]),
    }[name]
    return tuple(spark.createDataFrame(x, schema.format(p)) for x, p in zip(given, ("r1", "s1"), strict=True))


CASES = ["pkfk", "fkfk", "misses", "half on one key", "null keys", "no match", "empty left", "empty right", "one key", "high bits and negative"]


@pytest.mark.parametrize("case", CASES)
def test_strategies_agree_with_brute_force(spark, case):
    left, right = sides(spark, case)
    by_key = {}
    for s in right.collect():
        by_key.setdefault(s[0], []).append(tuple(s)[1:])
    want = sorted(((*r, *s) for r in left.collect() if r[0] is not None for s in by_key.get(r[0], [])), key=repr)
    for name in ALL:
        got = equi_join(left, right, "k", name)
        assert got.columns == ["k", *left.columns[1:], *right.columns[1:]]
        assert rows(got) == [tuple(x) for x in want], name


@pytest.mark.parametrize("n_left, n_right", list(itertools.product((0, 1, 2), (0, 1, 3))))
def test_any_number_of_payload_columns(spark, n_left, n_right):
    left = w.with_payload(w.primary_keys(spark, 64), [f"r{i}" for i in range(n_left)])
    right = w.with_payload(w.uniform_keys(spark, 128, 64), [f"s{i}" for i in range(n_right)])
    found = [rows(equi_join(left, right, "k", s)) for s in ALL]
    assert all(f == found[0] for f in found) and len(found[0]) == 128
    assert all(len(set(r)) == 1 for r in found[0])  # payload is a copy of the key


@pytest.mark.parametrize("name, node, fetches", [("SMJ", "SortMergeJoin", 0), ("SMJI", "SortMergeJoin", 2), ("SHJ", "ShuffledHashJoin", 0), ("PHJ", "ShuffledHashJoin", 2)])
def test_plan_has_the_join_asked_for(spark, name, node, fetches):
    left, right = sides(spark, "pkfk")
    plan = plan_of(equi_join(left, right, "k", name))
    other = {"SortMergeJoin": "ShuffledHashJoin", "ShuffledHashJoin": "SortMergeJoin"}[node]
    assert plan.count(node) == 1 + fetches and other not in plan and "BroadcastHashJoin" not in plan


def test_names_and_fallback():
    assert strategy_of("smji", 1, 1).name == "SMJ"
    assert strategy_of("SMJI", 1, 2).name == "SMJI"
    with pytest.raises(ValueError):
        strategy_of("hash", 1, 1)


def test_repeated_names_are_refused(spark):
    left, right = sides(spark, "pkfk")
    with pytest.raises(ValueError):
        equi_join(left, right.withColumnRenamed("s1", "r1"), "k")


def test_filters_and_columns_reach_the_scan(spark, data):
    plan = plan_of(plans.q7(spark, data))
    assert "GreaterThanOrEqual(l_shipdate" in plan and "l_tax" not in plan and "o_totalprice" not in plan


@pytest.mark.parametrize("strategy", ["SMJ", "SMJI", "SHJ", "PHJ"])
def test_plans_take_any_strategy(spark, data, strategy):
    for plan in (plans.q7, plans.q18, plans.q19):
        assert rows(plan(spark, data, strategy)) == rows(plan(spark, data))
    assert rows(plans.star_join_8(spark, 200, 16, strategy)) == rows(plans.star_join_8(spark, 200, 16))
