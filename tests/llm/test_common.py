import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from joinloom.llm.common import pick, raw_texts, whole_groups, written


def test_pick_among_names_that_clash(spark):
    df = spark.range(2).select(F.lit("a").alias("text"), F.lit("b").alias("TEXT"), F.lit("c").alias("text"), F.col("id").alias("Doc_ID"), F.lit(1).alias("_0"))
    got = pick(df, "doc_id", "text")
    assert got.columns == ["doc_id", "text"] and sorted(map(tuple, got.collect())) == [(0, "a"), (1, "a")]
    assert pick(df, "TEXT").first()[0] == "b"
    with pytest.raises(ValueError):
        pick(df, "html")


def test_raw_texts():
    assert raw_texts(pa.array(["é", None, ""])) == ["é".encode(), None, b""]
    assert raw_texts(pa.array(["x"], pa.large_string())) == [b"x"]


@pytest.mark.parametrize("least", [1, 4, 10, 1000])
def test_groups_stay_whole_over_batches(least):
    rng = np.random.default_rng(least)
    a = np.sort(rng.integers(0, 12, 200))
    b = np.concatenate([np.sort(rng.integers(0, 3, n)) for n in np.bincount(a)])
    whole = pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.arange(200))], names=["a", "b", "v"])
    cuts = [0, *np.sort(rng.integers(0, 200, 30)).tolist(), 200]
    parts = list(whole_groups((whole.slice(x, y - x) for x, y in zip(cuts, cuts[1:], strict=False)), 2, least))
    assert np.concatenate([p.column("v").to_numpy() for p in parts]).tolist() == list(range(200))
    keys = [{*zip(p.column("a").to_pylist(), p.column("b").to_pylist(), strict=True)} for p in parts]
    assert sum(map(len, keys)) == len(set.union(*keys))


def test_no_groups():
    assert list(whole_groups(iter([]), 1)) == []


def test_written_tables_are_read_back(spark):
    df = spark.range(1000, numPartitions=7).withColumn("x", F.col("id") * 2)
    for rows in (None, 1000):
        got, path = written(spark, df, "t", rows)
        assert got.schema == df.schema or got.columns == df.columns
        assert sorted(map(tuple, got.collect())) == [(i, 2 * i) for i in range(1000)]
    assert got.rdd.getNumPartitions() == 1
