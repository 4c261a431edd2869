"""What the operators of this subpackage share: column picking and raw access to Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinloom.storage import dropped, file_system, fresh_path, importable, scratch, shared_dir, written

__all__ = ["LOWER_ASCII", "dropped", "each_text", "file_system", "fresh_path", "importable", "pick", "place_of", "positional", "raw_texts", "scratch", "shared_dir", "sized", "table", "whole_groups", "written"]

UPPER = bytes(range(65, 91))
LOWER_ASCII = bytes.maketrans(UPPER, UPPER.lower())


def positional(df: DataFrame) -> DataFrame:
    """The same rows with the column names _0, _1, ..., so that names that clash do no harm."""
    importable(df.sparkSession)
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))])


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns. Of columns with equal names the first counts; case decides
    before case-insensitive equality does."""
    flat = positional(df)
    return flat.select(*[F.col(f"_{place_of(df, n)}").alias(n) for n in names])


def place_of(df: DataFrame, name: str) -> int:
    """Where the column is that pick() takes."""
    have = list(df.columns)
    return have.index(name) if name in have else [c.lower() for c in have].index(name.lower())


#: Rows of a few numbers or short names that a broadcast may hold, about 100 MB as a hash table.
BROADCAST_ROWS = 1_000_000


def sized(df: DataFrame, rows: int) -> DataFrame:
    """df, of narrow rows, to be broadcast if there are few enough; else it is joined as it may be."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """A string column's values as UTF-8 bytes."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def each_text(column: pa.Array, rows: int = 256) -> Iterator[bytes | None]:
    """The same one by one; so many of them are held as bytes at a time."""
    for at in range(0, len(column), rows):
        yield from raw_texts(column.slice(at, rows))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int, least: int = 100_000) -> Iterator[pa.Table]:
    """Tables of whole groups, from rows sorted by the first columns, which are the key. What is
    held is at most least rows, one batch and one group."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        whole = pa.Table.from_batches(held)
        new = np.ones(whole.num_rows, bool)
        if whole.num_rows > 1:
            same = np.ones(whole.num_rows - 1, bool)
            for k in range(keys):
                v = whole.column(k).to_numpy()
                same &= v[1:] == v[:-1]
            new[1:] = ~same
        last = int(np.flatnonzero(new)[-1])
        if last:
            yield whole.slice(0, last)
            rest = whole.slice(last).combine_chunks()
            held, rows = rest.to_batches(), rest.num_rows
        else:
            held, rows = whole.combine_chunks().to_batches(), whole.num_rows
            least = max(least, 2 * rows)
    if rows:
        yield pa.Table.from_batches(held)
