import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from joinloom.llm import knn, queries

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, every=50, k=5):
    sound = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            sound.append((i, [math.floor(256 * x) for x in v]))
    out = []
    for q in {i for i, _ in sound if i % every == 0}:
        best = []
        for v in {tuple(v) for i, v in sound if i == q}:
            best += [(-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in sound if i != q]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(best)[:k])]
    return sorted(out)


def found(spark, rows, **how):
    df = knn.quantised(spark.createDataFrame(rows, SCHEMA))
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in knn.top_products(spark, df, lambda i: i % 50 == 0, **how).collect())


@pytest.mark.parametrize("blocks", [{}, {"data_block": 64, "query_block": 3}])
def test_clusters_and_copies(spark, blocks):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 12))
    v = centres[rng.integers(0, 6, 900)] + rng.normal(size=(900, 12)) * 0.05
    v[300:600] = v[300]  # a third of all vectors are one
    rows = [(int(i), x.tolist()) for i, x in zip(rng.permutation(2000)[:900], v, strict=True)]
    assert found(spark, rows, **blocks) == brute(rows)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (50, None), (100, []), (150, [None, 1.0]), (200, [float("nan"), 1.0]), (250, [float("inf"), 0.0]), (None, [1.0, 1.0]), (3, [0.5]), (4, [-1.0, -1.0, 7.0]), (0, [1.0, 2.0]), (300, [0.001, -0.001]), (5, [0.5]), (5, [0.5])]
    assert found(spark, rows) == brute(rows)


def test_one_query_id_with_two_vectors(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0])] + [(i, [i / 10, (7 - i) / 10]) for i in range(1, 8)]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("scale", [1e-9, 1.0, 300.0, 40_000.0])
def test_scores_are_exact_at_any_scale(spark, scale):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=8) * scale).tolist()) for i in range(160)]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, [1.0])], [(50, [1.0])], [(50, None)], [(50, []), (1, [])]])
def test_small_tables(spark, rows):
    assert found(spark, rows) == brute(rows)


def test_bounds_leave_out_far_cells(spark):
    """Tight clusters far apart: a query's group meets its own cluster, not the rest."""
    rng = np.random.default_rng(3)
    centres = np.eye(8) * 4
    v = np.repeat(centres, 200, axis=0) + rng.normal(size=(1600, 8)) * 0.01
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    df = knn.quantised(spark.createDataFrame([r for r in rows if r[0] % 50 or r[0] < 200], SCHEMA))
    got = knn.top_products(spark, df, lambda i: i % 50 == 0)
    got.collect()
    assert all(r.vec_id < 200 for r in got.collect())


def test_clashing_columns(spark):
    df = spark.createDataFrame([(i, [float(i)]) for i in range(0, 60)], SCHEMA)
    wide = df.withColumns({"cell": F.lit(1), "id": F.lit(2), "v": F.lit(3), "EMBEDDING_": F.lit(4)})
    got = knn.top_products(spark, knn.quantised(wide), lambda i: i % 50 == 0)
    assert got.count() == 10


def test_whole_table(spark, data):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in queries.QUERIES["op2_top_products"](spark, data).collect())
    assert got == brute(rows)
