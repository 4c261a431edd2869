"""Headerless files of one column of fixed-width values."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinloom.storage import file_system, fresh_path, importable, written

#: Spark's name of a type, and how its values stand in a file.
TYPES = {"int": "<i4", "bigint": "<i8", "float": "<f4", "double": "<f8"}
BLOCK = 1 << 20


def write_raw(spark: SparkSession, df: DataFrame, column: str, folder: str | None = None) -> str:
    """Writes a column without nulls as one file for each partition, in a folder; returns the folder.
    A file gets its name when it is whole, so a task may run twice."""
    importable(spark)
    folder = folder or fresh_path(spark, f"raw-{column}")
    kind = df.select(column).dtypes[0][1]
    if kind not in TYPES:
        raise ValueError(f"{column} is {kind}; raw columns are {', '.join(TYPES)}")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, at = file_system(folder)
        fs.create_dir(at, recursive=True)
        part, rows = TaskContext.get(), 0
        name = f"part-{part.partitionId():06d}.bin"
        tried = f"{at}/_{name}-{part.taskAttemptId()}"
        with fs.open_output_stream(tried, compression=None) as out:
            for batch in batches:
                if batch.column(0).null_count:
                    raise ValueError(f"{column} has nulls, which raw files can't hold")
                out.write(batch.column(0).to_numpy(zero_copy_only=False).astype(TYPES[kind]).tobytes())
                rows += batch.num_rows
        if rows:
            fs.move(tried, f"{at}/{name}")
        else:
            fs.delete_file(tried)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([rows], pa.int64())], names=["file", "rows"])

    written(spark, df.select(column).mapInArrow(write, "file string, rows long"), "raw-files")
    return folder


def read_raw(spark: SparkSession, folder: str, column: str, kind: str, to: str | None = None, block: int = BLOCK) -> DataFrame:
    """(pos long, column): all values of a folder's files, with their place in the order of the files;
    `to` is a type to cast to. Tasks read ranges of files, which may be of any size. A file that ends
    inside a value is an error."""
    importable(spark)
    width = np.dtype(TYPES[kind]).itemsize
    fs, at = file_system(folder)
    files = sorted((x.base_name, x.size) for x in fs.get_file_info(pafs.FileSelector(at)) if x.is_file and x.base_name[0] not in "_.")
    if bad := [n for n, size in files if size % width]:
        raise ValueError(f"{bad[0]} ends inside a value")
    listed, before = [], 0
    for name, size in files:
        listed.append((name, before, ceil(size / width / block)))
        before += size // width
    parts = spark.createDataFrame(listed, "file string, before long, blocks long").where("blocks > 0")
    parts = parts.select("file", "before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = file_system(folder)
        for batch in batches:
            for want in batch.to_pylist():
                with fs.open_input_file(f"{at}/{want['file']}") as source:
                    values = np.frombuffer(source.read_at(block * width, want["block"] * block * width), TYPES[kind])
                first = want["before"] + want["block"] * block
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(values))), pa.array(values)], names=["pos", column])

    tasks = max(1, min(sum(b for _, _, b in listed), 8 * spark.sparkContext.defaultParallelism))
    out = parts.repartition(tasks).mapInArrow(read, f"pos long, {column} {kind}")
    return out.withColumn(column, F.col(column).cast(to)) if to else out
