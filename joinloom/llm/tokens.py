"""Token counts by separator scans of flat token files.

A token file is an array of little-endian ids, document after document, each closed by an
end-of-document id; nothing says where documents begin. Blocks of it are searched on their own, and a
prefix scan over the blocks' summaries joins what block borders cut."""

from __future__ import annotations

import base64
import functools
import math
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from joinloom.llm.common import dropped, file_system, fresh_path, pick, written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
VOCABULARY_BYTES = 32_000_000
#: How the vocabulary's tokenizer cuts text into pieces. A fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: What its \s is, and the white space that is cut out before the pattern sees it, whose steps back would
#: go too deep. A fixed value.
SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{20000,}")
END = 50256
BLOCK_TOKENS = 1 << 20
#: Blocks whose summaries are scanned together; their sums are scanned in turn.
SCAN_BLOCKS = 1024


def _known(ranks: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}


@functools.lru_cache(2)
def _encoding(ranks: bytes) -> tiktoken.Encoding:
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=_known(ranks), special_tokens={})


def encoded(encoding: tiktoken.Encoding, text: str) -> list[int]:
    """The text's ids. A long run of white space is one piece of the pattern up to its last character, which
    goes with what follows, or up to its end where the text ends; no other piece reaches into it. So
    it can be cut out."""
    out, at = [], 0
    for run in SPACES.finditer(text):
        begin, end = run.span()
        end -= end < len(text)
        out += encoding.encode_ordinary(text[at:begin])
        out += encoding._core_bpe.encode_single_piece(text[begin:end].encode())
        at = end
    return out + encoding.encode_ordinary(text[at:]) if at else encoding.encode_ordinary(text)


def width_of(ranks: bytes, end: int) -> str:
    """The narrowest type of a token file that holds all ids of a vocabulary and the end id."""
    ids = set(_known(ranks).values())
    if end in ids:
        raise ValueError(f"the end id {end} is an id of the vocabulary")
    most = max({end, *ids})
    if most >= 1 << 32:
        raise ValueError(f"the id {most} is beyond four bytes")
    return "<u2" if most < 1 << 16 else "<u4"


def vocabulary(path: str = VOCABULARY) -> bytes:
    """The ranks file, read by the driver and sent along, so that executors need no copy of it."""
    if (n := Path(path).stat().st_size) > VOCABULARY_BYTES:
        raise ValueError(f"{path} has {n} bytes; {VOCABULARY_BYTES} are the most that is sent to tasks")
    return Path(path).read_bytes()


def _writer(folder: str, ranks: bytes, end: int, dtype: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (doc_id, text) of a partition to one token file, which gets its name when it is whole. Yields
    (file, ordinal, doc_id): which document is which in the file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, at = file_system(folder)
        fs.create_dir(at, recursive=True)
        part = TaskContext.get()
        name = f"part-{part.partitionId():06d}.tokens"
        tried = f"{at}/_{name}-{part.taskAttemptId()}"
        encode, stop, n = functools.partial(encoded, _encoding(ranks)), np.array([end], dtype).tobytes(), 0
        with fs.open_output_stream(tried, compression=None) as out:
            for batch in batches:
                for text in batch.column(1).to_pylist():
                    if text:
                        out.write(np.array(encode(text), dtype).tobytes())
                    out.write(stop)
                rows = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name] * rows, pa.string()), pa.array(np.arange(n, n + rows)), batch.column(0)], names=["file", "ordinal", "doc_id"])
                n += rows
        if n:
            fs.move(tried, f"{at}/{name}")
        else:
            fs.delete_file(tried)

    return write


def token_files(spark: SparkSession, documents: DataFrame, ranks: bytes, folder: str | None = None, end: int = END, dtype: str | None = None) -> tuple[str, DataFrame]:
    """Writes the documents' texts as token files in a folder, by default a new one in the shared
    folder; returns it and (file, ordinal, doc_id). dtype: width_of() the vocabulary unless given.
    A null or empty text is an end id alone; texts may have any length and hold runs of any length."""
    folder, dtype = folder or fresh_path(spark, "tokens"), dtype or width_of(ranks, end)
    docs = pick(documents, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names, _ = written(spark, docs.mapInArrow(_writer(folder, ranks, end, dtype), f"file string, ordinal long, doc_id {kind}"), "token-names")
    return folder, names


def _searcher(folder: str, end: int, dtype: str, block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (file, block) to (file, block, ends, stop): where in the file the block's end ids are, and where
    the block ends, in tokens."""
    width = np.dtype(dtype).itemsize

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = file_system(folder)
        for batch in batches:
            ends, stops = [], []
            for want in batch.to_pylist():
                with fs.open_input_file(f"{at}/{want['file']}") as source:
                    ids = np.frombuffer(source.read_at(block * width, want["block"] * block * width), dtype)
                ends.append(np.flatnonzero(ids == end) + want["block"] * block)
                stops.append(want["block"] * block + len(ids))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends, pa.list_(pa.int64())), pa.array(stops, pa.int64())], names=["file", "block", "ends", "stop"])

    return search


def scan(spark: SparkSession, folder: str, end: int = END, dtype: str = "<u2", block: int = BLOCK_TOKENS, scan_blocks: int = SCAN_BLOCKS) -> DataFrame:
    """The documents of all token files in a folder: (file, ordinal long, start long, n_tokens long), in
    tokens and without the end ids. What follows a file's last end id is a document, too.

    Files may be of any size: tasks read blocks, by offset. Only the list of files is held by the
    driver. The scan over block summaries has two levels, so that a file of very many blocks is no
    single task's. Files that start with _ or . are passed over; empty files have no documents; a file
    that ends inside an id is an error."""
    width = np.dtype(dtype).itemsize
    fs, at = file_system(folder)
    found = fs.get_file_info(pafs.FileSelector(at, allow_not_found=True))
    files = sorted((x.base_name, x.size) for x in found if x.is_file and x.base_name[0] not in "_." and x.size)
    for name, size in files:
        if size % width:
            raise ValueError(f"{name} ends inside an id")
    listed = spark.createDataFrame([(n, math.ceil(s / (block * width))) for n, s in files], "file string, blocks long")
    wanted = listed.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    tasks = max(1, min(sum(math.ceil(s / (block * width)) for _, s in files), 8 * spark.sparkContext.defaultParallelism))
    blocks, _ = written(spark, wanted.repartition(tasks).mapInArrow(_searcher(folder, end, dtype, block), "file string, block long, ends array<long>, stop long"), "separators")

    parts = blocks.select("file", "block", F.floor(F.col("block") / scan_blocks).alias("part"), F.size("ends").cast("long").alias("n"), F.when(F.size("ends") > 0, F.element_at("ends", -1)).alias("last"), "stop")
    before = Window.partitionBy("file", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inner = parts.select("file", "block", "part", F.sum("n").over(before).alias("n"), F.max("last").over(before).alias("last"))
    outer = parts.groupBy("file", "part").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    outer = outer.select("file", "part", F.sum("n").over(earlier).alias("n0"), F.max("last").over(earlier).alias("last0"))
    carried = inner.join(outer, ["file", "part"]).select("file", "block", (F.coalesce("n", F.lit(0)) + F.coalesce("n0", F.lit(0))).alias("first"), (F.coalesce("last", "last0", F.lit(-1)) + 1).alias("open"))

    ends = blocks.where(F.size("ends") > 0).join(carried, ["file", "block"])
    starts = F.concat(F.array("open"), F.transform(F.slice("ends", 1, F.size("ends") - 1), lambda e: e + 1))
    each = ends.select("file", "first", F.posexplode(F.arrays_zip(starts.alias("start"), F.col("ends").alias("end"))).alias("k", "doc"))
    closed = each.select("file", (F.col("first") + F.col("k")).alias("ordinal"), F.col("doc.start").alias("start"), (F.col("doc.end") - F.col("doc.start")).alias("n_tokens"))
    tail = parts.groupBy("file").agg(F.sum("n").alias("ordinal"), (F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("start"), F.max("stop").alias("stop")).where("start < stop")
    return closed.unionByName(tail.select("file", "ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens")))


def counted(spark: SparkSession, documents: DataFrame, ranks: bytes, end: int = END) -> DataFrame:
    """(doc_id, n_tokens long), a row for each document row: written as token files and counted by the
    scan, after which the files are deleted. Null and empty texts have none, very long ones, also of
    blanks alone, count whole; a row for each of repeated rows. No rows: no rows. Other columns are
    ignored."""
    dtype = width_of(ranks, end)
    folder, names = token_files(spark, documents, ranks, end=end, dtype=dtype)
    counts = scan(spark, folder, end, dtype)  # has read the files by now; what is left works on their separators
    dropped(spark, folder)
    return names.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")
