"""The folder that driver and executors share, and tables and flat files in it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


#: Bytes of the rows that a Python worker gets at a time, and Spark's own default. Rows with texts are large,
#: and a worker holds a batch several times over.
BATCH_BYTES, DEFAULT_BATCH_BYTES = "8m", "64m"


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver found it, too, and gives them batches
    of BATCH_BYTES, unless the session says otherwise."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(setting, DEFAULT_BATCH_BYTES) in (DEFAULT_BATCH_BYTES, "67108864b"):
        spark.conf.set(setting, BATCH_BYTES)
    env, here = spark.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), here]))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where it is unset and all
    is one machine, as in tests, a temporary folder is made and noted in the session; on a cluster,
    whose machines each have their own, that is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir is unset; on {master} it has to name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="joinloom-")
        atexit.register(shutil.rmtree, own, True)
        found = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", found)
    if "://" not in found and not found.startswith("file:"):
        found = f"file://{found}"
    return found.rstrip("/")


_scratches: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at its end what was written to the shared folder within. Yields the list of the paths; those
    that are taken off it stay. Results are computed when they are read, so write them within."""
    paths: list[str] = []
    _scratches.append(paths)
    try:
        yield paths
    finally:
        _scratches.remove(paths)
        for path in paths:
            dropped(spark, path)


def fresh_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    if _scratches:
        _scratches[-1].append(path)
    return path


#: Narrow rows to a file, where it is known how many there are at most.
FILE_ROWS = 100_000


def written(spark: SparkSession, df: DataFrame, what: str, rows: int | None = None, by: str | None = None) -> tuple[DataFrame, str]:
    """df, computed once into a table in the shared folder; and the table's path. A lost executor
    costs no more than its running tasks, since the table outlives it. rows: how many there are at
    most, if they are narrow and the number is known; then no more files and last tasks are made than
    that many need. by: a column whose values get folders of their own, so that a filter on it reads
    nothing else."""
    path = fresh_path(spark, what)
    if rows is not None:
        df = df.coalesce(1 + rows // FILE_ROWS)
    df.write.parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any longer."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """For executors that write or read flat files in the shared folder."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)
