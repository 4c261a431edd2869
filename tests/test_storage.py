"""The shared folder, and what is left in it."""

from types import SimpleNamespace

import pytest

from joinloom import storage
from joinloom.sources.tables import exists


def test_scratch_deletes_all_but_what_is_kept(spark):
    with storage.scratch(spark) as outer:
        with storage.scratch(spark) as paths:
            df, kept = storage.written(spark, spark.range(5), "kept")
            _, gone = storage.written(spark, spark.range(5), "gone")
            paths.remove(kept)
        assert df.count() == 5 and not exists(spark, gone)
        _, later = storage.written(spark, spark.range(3), "later", by=None)
        assert outer == [later]
    assert exists(spark, kept) and not exists(spark, later)
    _, after = storage.written(spark, spark.range(3), "after")
    assert exists(spark, after)


def test_scratch_deletes_after_errors(spark):
    with pytest.raises(RuntimeError), storage.scratch(spark):
        _, gone = storage.written(spark, spark.range(5), "gone")
        raise RuntimeError
    assert not exists(spark, gone)


def test_folders_by_value(spark):
    df, _ = storage.written(spark, spark.range(100).selectExpr("id", "id % 10 = 0 as tenth"), "parts", by="tenth")
    assert df.where("tenth").count() == 10 and df.columns == ["id", "tenth"]
    assert "PartitionFilters: [isnotnull(tenth" in df.where("tenth")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("master, own", [("local", True), ("local[4]", True), ("local[*]", True), ("local-cluster[2,1,1024]", False), ("yarn", False), ("spark://h:7077", False), ("k8s://h", False)])
def test_only_a_single_machine_has_a_folder_by_itself(master, own):
    set_ = {}
    unset = SimpleNamespace(get=lambda name, default=None: default)
    fake = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: unset, master=master), conf=SimpleNamespace(get=lambda name, default=None: default, set=set_.__setitem__))
    if own:
        assert storage.shared_dir(fake) == set_["spark.checkpoint.dir"]
    else:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            storage.shared_dir(fake)
