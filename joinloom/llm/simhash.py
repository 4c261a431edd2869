"""SimHash near-duplicates, compared on vertical bit planes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinloom.llm.common import LOWER_ASCII, pick, place_of, positional, raw_texts, sized, whole_groups, written
from joinloom.llm.components import star_components

SHINGLE = 3
SEED = 42
RADIUS = 2
BAND_BITS = 16
#: Rows of a bucket that are compared in one task; larger buckets are cut into pairs of blocks.
BLOCK = 4096

ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
ONE = np.uint64(1)


def shingle_hashes(words: list[bytes], shingle: int) -> Iterator[np.ndarray]:
    """The 64-bit hashes of the shingles of some words, in pieces; fewer words than a shingle has are one."""
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 16384):
        part = words[at : min(at + 16384, n) + shingle - 1]
        joined = b" ".join(part)
        if len(part) <= shingle:
            hashes = [digest(joined, SEED)]
        else:
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
            starts = [0, *(ends[: len(part) - shingle] + 1).tolist()]
            hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
        yield np.array(hashes, "<u8")


def fingerprint(raw: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles; no words: zero. Long texts are hashed in
    pieces, so that memory holds the counters and one piece."""
    words = (raw or b"").translate(LOWER_ASCII).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(64, np.int64)
    for hashes in shingle_hashes(words, shingle):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def _print_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(x) for x in raw_texts(batch.column(0))), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(prints.view(np.int64))], names=[*batch.schema.names[1:], "fp"])


def close_pairs(prints: np.ndarray, group: np.ndarray, radius: int = RADIUS, slab: int = 1 << 14, heap: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j), i < j, of fingerprints of one group that differ in at most radius bits. prints:
    64-bit words, one for each fingerprint, or a row of them. group: sorted keys. They come in pieces
    of at most 64 * slab pairs, or 64 of a row's words. heap: keys, sorted within each group, of rows
    that are known to belong together; words that hold but the row's own heap are passed over.

    Each group fills words of 64 lanes, and a plane for each bit holds that bit of every lane. A row
    meets a word of its group at a time: plane by plane its bit is compared with 64 lanes at once, and
    the differences go into carry-save counters, one bit of the count to a word. The counters start at
    2**k - 1 - radius, so that a carry out of the top says "further than the radius". Every eight
    planes, (row, word) blocks whose lanes have all gone over are abandoned."""
    n = len(prints)
    whole = prints[:, None] if prints.ndim == 1 else prints
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[first, n])
    lane = np.arange(n) - np.repeat(first, sizes)
    words = -(-sizes // 64)
    base = np.cumsum(words) - words
    word = np.repeat(base, sizes) + lane // 64
    opens = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if n else first
    closes = np.r_[opens[1:], n] - 1
    shift = (lane % 64).astype(np.uint64)
    planes = [np.bitwise_or.reduceat(((whole[:, k] >> np.uint64(b)) & ONE) << shift, opens) if n else whole[:, k] for k in range(whole.shape[1]) for b in range(64)]
    filled = np.bitwise_or.reduceat(ONE << shift, opens) if n else shift
    ahead = np.repeat(base + words, sizes) - word  # words from the row's own to its group's last
    bits = max(1, int(radius).bit_length())
    start = 2**bits - 1 - radius
    ends = np.cumsum(ahead)
    at = 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + slab, "right")))
        row = np.repeat(np.arange(at, upto), ahead[at:upto])
        met = word[row] + np.arange(len(row)) - np.repeat(np.cumsum(ahead[at:upto]) - ahead[at:upto], ahead[at:upto])
        if heap is not None:
            apart = (heap[row] != heap[opens[met]]) | (heap[row] != heap[closes[met]])
            row, met = row[apart], met[apart]
        later = np.where(met == word[row], ~((ONE << shift[row]) | ((ONE << shift[row]) - ONE)), ALL)
        over = ~(filled[met] & later)
        count = [np.full(len(row), ALL if start >> k & 1 else 0, np.uint64) for k in range(bits)]
        mine = None
        for b, plane in enumerate(planes):
            if b % 64 == 0:
                mine = whole[row, b // 64]
            carry = plane[met] ^ (np.uint64(0) - ((mine >> np.uint64(b % 64)) & ONE))
            for k in range(bits):
                count[k], carry = count[k] ^ carry, count[k] & carry
            over |= carry
            if b % 8 == 7 and 2 * np.count_nonzero(over != ALL) < len(over):
                alive = over != ALL
                row, met, over, mine, count = row[alive], met[alive], over[alive], mine[alive], [c[alive] for c in count]
                if not len(row):
                    break
        left = ~over
        some = left != 0
        row, met, left = row[some], met[some], left[some]
        for b in range(64):
            hit = (left >> np.uint64(b)) & ONE != 0
            if hit.any():
                yield row[hit], opens[met[hit]] + b
        at = upto


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least position reachable from each of n positions. Pieces of pairs are folded in one by one."""
    label = np.arange(n)
    for a, b in pairs:
        x, y = label[a], label[b]
        while (apart := x != y).any():
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label = label[label]
            x, y = label[a], label[b]
    return label


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, tile, fp), sorted: a spanning forest of the links in each group, not all pairs."""
    for part in whole_groups(batches, 2):
        bucket, tile, prints = (part.column(k).to_numpy() for k in range(3))
        new = np.r_[True, (bucket[1:] != bucket[:-1]) | (tile[1:] != tile[:-1])]
        root = forest(len(prints), close_pairs(prints.view(np.uint64), np.cumsum(new)))
        linked = np.flatnonzero(root != np.arange(len(prints)))
        yield pa.RecordBatch.from_arrays([pa.array(prints[linked]), pa.array(prints[root[linked]])], names=["a", "b"])


def links(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """prints(fp): distinct fingerprints. Returns links (a, b) that join exactly those that a chain of
    pairs within the radius joins.

    Four bands of 16 bits: of two fingerprints that differ in at most two bits at least two bands are
    equal, so each pair meets in one of the six buckets of two bands. A bucket larger than block is
    cut into blocks, and every pair of blocks is a group of its own: no group exceeds about twice
    that, and no pair is left out."""
    mask = (1 << BAND_BITS) - 1
    band = [F.shiftrightunsigned("fp", BAND_BITS * k).bitwiseAND(mask) for k in range(4)]
    two = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    keys = F.array(*[F.lit(t << 2 * BAND_BITS).cast("long") + F.shiftleft(band[i], BAND_BITS) + band[j] for t, (i, j) in enumerate(two)])
    rows = prints.select("fp", F.explode(keys).alias("bucket"))
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    met = rows.join(counts, "bucket").select("bucket", "fp", blocks.alias("blocks"), own.alias("own"), other.alias("other"))
    tiles = met.select("bucket", (F.least("own", "other").cast("long") * F.col("blocks") + F.greatest("own", "other")).alias("tile"), "fp")
    sorted_ = tiles.repartition("bucket", "tile").sortWithinPartitions("bucket", "tile")
    return sorted_.mapInArrow(_link_batches, "a long, b long")


def near_duplicates(spark: SparkSession, documents: DataFrame, mark: str | None = None) -> DataFrame:
    """documents(doc_id, text, ...) to (doc_id, fp long, root long, component_id, mark long), a row for each
    row. root: the least fingerprint (as a signed long) of the component; component_id: the smallest
    doc_id in it. mark: of the column named so, by default a hash of the text; it tells rows of one
    doc_id apart.

    Null and empty texts, and texts without words, have fingerprint zero and link to each other as
    any others do. Rows of one doc_id are separate rows of one id. A null doc_id counts only where its
    component has no other id: component_id is null there. No rows: no rows. Other columns are
    ignored, whatever their names."""
    docs = pick(documents, "text", "doc_id", *([mark] if mark else [])).toDF("text", "doc_id", *(["mark"] if mark else []))
    docs = docs.select("text", "doc_id", (F.col("mark") if mark else F.xxhash64("text")).cast("long").alias("mark"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, mark long, fp long"
    rows, _ = written(spark, docs.mapInArrow(_print_batches, schema), "simhash")
    prints, _ = written(spark, rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints", rows.count())
    found = star_components(spark, links(prints.select("fp")), 6 * prints.count()).select(F.col("node").alias("fp"), "root")
    rooted = prints.join(found, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    member = rooted.select("fp", "root").join(least, "root")
    return rows.join(member, "fp").select("doc_id", "fp", "root", "component_id", "mark")


def one_of_each(spark: SparkSession, documents: DataFrame, groups: Callable[..., DataFrame] = near_duplicates) -> DataFrame:
    """The documents, whole and with their columns as they were, of which one of each group of
    near-duplicates stays: that with the smallest doc_id, a null one last; of rows with equal doc_id in
    a group that with the least hash of all its columns, and of wholly equal rows one. groups: what finds the
    groups, with the columns of near_duplicates, which says what null, empty and long texts are. No
    rows: no rows. The first column of a name counts, in any case.

    Only ids and hashes are shuffled. The texts are passed by the rows that go, as a broadcast while
    these are few enough for one, and else by a join."""
    names = list(documents.columns)
    flat = positional(documents)
    doc_id, text = (f"_{place_of(documents, n)}" for n in ("doc_id", "text"))
    own = [F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in flat.schema]
    marked = flat.withColumn("_mark", F.xxhash64(*own))
    found = groups(spark, marked.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col("_mark").alias("mark")), "mark")
    each, _ = written(spark, found.groupBy("root", "doc_id", "mark").agg(F.count("*").alias("n")), "groups")
    best = each.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "n")).alias("best"), F.count("*").alias("many"))
    most = each.count()
    best, _ = written(spark, best.where("many > 1 or best.n > 1"), "best", most)
    other = ~(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("mark") == F.col("best.mark")))
    gone, _ = written(spark, each.join(best.where("many > 1").select("root", "best"), "root").where(other).select(F.col("doc_id").alias("_k"), F.col("mark").alias("_h")), "gone", most)
    again, _ = written(spark, best.where("best.n > 1").select(F.col("best.doc_id").alias("_k"), F.col("best.mark").alias("_h")), "again", most)

    def those(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = sized(keys, keys.count())
        return rows.join(keys, rows[doc_id].eqNullSafe(keys["_k"]) & (rows["_mark"] == keys["_h"]), how)

    kept = those(marked, gone, "left_anti")
    if again.limit(1).count():  # wholly equal rows
        kept = those(kept, again, "left_anti").unionByName(those(kept, again, "left_semi").dropDuplicates([doc_id, "_mark"]))
    return kept.drop("_mark").toDF(*names)
