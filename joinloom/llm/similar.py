"""Near-duplicates by the similarity of their word shingles: SimHash finds the pairs that may be similar,
and the shingles decide."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinloom.llm import common
from joinloom.llm.common import LOWER_ASCII, each_text, pick, sized, whole_groups, written
from joinloom.llm.components import star_components
from joinloom.llm.simhash import SEED, close_pairs, forest

SHINGLE = 5
#: Two texts are linked if SHARED of UNION shingles that either has are in both, or more.
SHARED, UNION = 4, 5
#: Bits of a fingerprint, and how many of them may differ in a pair that is looked at. Texts that are just
#: similar enough differ in 19.4 on average, with a deviation of 4.1, and texts without anything in
#: common in 64, with a deviation of 5.7.
BITS, RADIUS = 128, 32
#: Fingerprints that a bucket holds on average, and the share of the texts that are just similar enough
#: that meet in a bucket of one table or another. Nearer ones do more often.
BUCKET, RECALL = 1024, 0.995
#: Fingerprints of a bucket, and shingles of a cluster, that are compared in one task; larger ones are cut
#: into blocks, and each pair of blocks is a task.
BLOCK, SHINGLES = 4096, 1_000_000
#: Words whose hashes a task holds at most.
HELD = 200_000
#: Bits that texts are looked up in where those that are looked for are too many to be broadcast: so many for
#: each, within these limits.
MARKS, LEAST_MARKS, MOST_MARKS = 16, 1 << 23, 1 << 29
ODD = [np.uint64(int(0x9E3779B97F4A7C15 * (2 * k + 1)) % 2**64 | 1) for k in range(SHINGLE)]


class _Hashes(dict):
    """Words' hashes, of which HELD are kept."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, SEED)
        if len(self) < HELD:
            self[word] = h
        return h


def words_of(raw: bytes | None) -> list[bytes]:
    return (raw or b"").translate(LOWER_ASCII).split()


def _mixed(x: np.ndarray) -> np.ndarray:
    """Each bit of the result hangs on all bits of x."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def shingles(words: list[bytes], hashes: dict[bytes, int] | None = None) -> np.ndarray:
    """The sorted hashes of the different shingles: SHINGLE words in a row, all words of a shorter text; no
    words: none."""
    if not words:
        return np.zeros(0, np.uint64)
    hashes = _Hashes() if hashes is None else hashes
    own = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - SHINGLE + 1)
    out = np.full(n, min(len(words), SHINGLE), np.uint64)
    for k in range(min(SHINGLE, len(words))):
        out += own[k : k + n] * ODD[k]
    return np.unique(_mixed(out))


def key_of(own: np.ndarray) -> int:
    """One signed 64-bit number for texts of equal shingles."""
    return xxhash.xxh64_intdigest(own.tobytes(), SEED) - 2**63


def fingerprint(own: np.ndarray) -> np.ndarray:
    """The SimHash of a set of shingles, as 64-bit words: bits that over half of the hashes have, and of those
    that half have the ones that the least has, so that fingerprints of few shingles have as many ones as
    others. No shingles: zero."""
    words = np.column_stack([_mixed(own + ODD[k]) for k in range(BITS // 64)])
    counts = np.zeros(BITS, np.int64)
    tie = np.unpackbits(words[:1].view(np.uint8), bitorder="little").astype(np.int64) if len(own) else counts
    for at in range(0, len(own), 1 << 16):
        part = np.ascontiguousarray(words[at : at + (1 << 16)])
        counts += np.add.reduce(np.unpackbits(part.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.int32)
    return np.packbits(2 * counts + tie > len(own), bitorder="little").view(np.uint64)


def tables(n: int) -> list[np.ndarray]:
    """The bits that make the key of each table for n fingerprints: as many that a bucket holds BUCKET, in
    as many tables that RECALL is met. SimHash bits of two sets differ with the angle between them. With
    few fingerprints there is one bucket."""
    bits = max(0, ceil(log2(max(1, n) / BUCKET)))
    cosine = 2 * SHARED / (SHARED + UNION)  # of sets of equal size
    meet = (1 - acos(cosine) / pi) ** bits
    many = ceil(log(1 - RECALL) / log(1 - meet)) if bits else 1
    rng = np.random.default_rng(11)
    return [rng.choice(BITS, bits, replace=False) for _ in range(many)]


def _print_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, ...) to (..., key, n, f0, f1); n: the number of shingles."""
    hashes = _Hashes()
    for batch in batches:
        keys, sizes, prints = [], [], np.zeros((batch.num_rows, BITS // 64), np.uint64)
        for i, raw in enumerate(each_text(batch.column(0))):
            own = shingles(words_of(raw), hashes)
            keys.append(key_of(own))
            sizes.append(len(own))
            prints[i] = fingerprint(own)
        words = [pa.array(np.ascontiguousarray(prints[:, k]).view(np.int64)) for k in range(BITS // 64)]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), *words], names=[*batch.schema.names[1:], "key", "n", *FP])


FP = [f"f{k}" for k in range(BITS // 64)]


def _prints(columns: list[pa.ChunkedArray]) -> np.ndarray:
    return np.column_stack([c.to_numpy().view(np.uint64) for c in columns])


def _bucket_batches(positions: list[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (key, f0, f1, ...) under their bucket of each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [batch.column(1 + k).to_numpy().view(np.uint64) for k in range(BITS // 64)]
            for t, own in enumerate(positions):
                bucket = np.full(batch.num_rows, t, np.int64)
                for p in own.tolist():
                    bucket = bucket << 1 | (prints[p // 64] >> np.uint64(p % 64) & np.uint64(1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), *batch.columns], names=["bucket", *batch.schema.names])

    return run


def _tiles(spark: SparkSession, rows: DataFrame, by: str, blocks: DataFrame, most: int) -> DataFrame:
    """rows(by, key, ...) by (by, tile), sorted. Two rows of a group meet in a tile. blocks(by, blocks): the
    groups that are cut into more than one block, of which there are `most` at most; each pair of blocks
    is a tile."""
    blocks, _ = written(spark, blocks, "blocks", most)
    many, columns = blocks.count(), rows.columns
    if many:
        rows = rows.join(sized(blocks, many), by, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)).cast("int"))
        rows = rows.withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        tile = F.least("own", "other").cast("long") * F.col("blocks") + F.greatest("own", "other")
    else:
        tile = F.lit(0).cast("long")
    return rows.withColumn("tile", tile).select(by, "tile", *[c for c in columns if c != by])


def _met(rows: DataFrame, by: str) -> DataFrame:
    return rows.repartition(by, "tile").sortWithinPartitions(by, "tile")


def _cuts(part: pa.Table) -> np.ndarray:
    """Where the groups of a table begin, by its first two columns."""
    one, two = (part.column(k).to_numpy() for k in range(2))
    return np.flatnonzero(np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])])


def _gathered(prints: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """A label for each row: rows of a group with one label are within the radius of one of them. Only large
    heaps are gathered, so that they need not be compared row by row."""
    label = np.arange(len(prints))
    for at, end in zip(cuts, np.r_[cuts[1:], len(prints)], strict=True):
        left = np.arange(at, end)
        while len(left) >= 256:
            near = np.bitwise_count(prints[left] ^ prints[left[0]]).sum(axis=1) <= RADIUS
            label[left[near]] = left[0]
            if np.count_nonzero(near) < 64:
                break
            left = left[~near]
    return label


def _forest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, tile, key, f0, f1), sorted: a spanning forest of the pairs within the radius."""
    for part in whole_groups(batches, 2):
        key, prints, cuts = part.column(2).to_numpy(), _prints(part.columns[3:]), _cuts(part)
        group, label = np.zeros(len(key), np.int64), _gathered(prints, cuts)
        group[cuts] = 1
        order = np.lexsort((label, group.cumsum()))  # heaps in a row
        key, prints, group = key[order], np.ascontiguousarray(prints[order]), group.cumsum()
        _, first, heap = np.unique(label[order], return_index=True, return_inverse=True)
        root = forest(len(key), itertools.chain([(np.arange(len(key)), first[heap])], close_pairs(prints, group, RADIUS, heap=heap)))
        some = np.flatnonzero(root != np.arange(len(key)))
        yield _pairs(key[some], key[root[some]])


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def local_links(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of similar sets: each set meets all others at once, by the places that
    its shingles have among all shingles there."""
    sizes = np.array([len(x) for x in sets], np.int64)
    starts = np.cumsum(sizes) - sizes
    _, place = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
    label, a, b = np.arange(len(sets)), [], []
    own = np.zeros(place.max(initial=-1) + 1, bool)
    some = np.flatnonzero(sizes)  # reduceat() has no empty ranges
    for i in some:
        if (label[some] == label[i]).all():
            continue
        mine = place[starts[i] : starts[i] + sizes[i]]
        own[mine] = True
        shared = np.add.reduceat(own[place], starts[some], dtype=np.int64)
        own[mine] = False
        for j in some[((SHARED + UNION) * shared >= SHARED * (sizes[some] + sizes[i])) & (label[some] != label[i])]:
            if label[j] != label[i]:
                a.append(i)
                b.append(j)
                label[label == label[j]] = label[i]
    return np.array(a, np.int64), np.array(b, np.int64)


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cluster, tile, key, text), sorted: links that join the similar texts of each tile."""
    hashes = _Hashes()
    for part in whole_groups(batches, 2, 1024):
        part = part.combine_chunks()
        key, cuts = part.column(2).to_numpy(), _cuts(part)
        for at, end in zip(cuts, np.r_[cuts[1:], len(key)], strict=True):
            if end - at > 1:
                a, b = local_links([shingles(words_of(x), hashes) for x in each_text(part.column(3).chunk(0).slice(at, end - at))])
                yield _pairs(key[at + a], key[at + b])


def _marked_batches(bits: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (text, text_hash) whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(1).to_numpy() % (8 * len(bits))
            yield batch.filter(pa.array(bits[at >> 3] >> (at & 7) & 1 != 0))

    return run


def _marks(hashes: DataFrame, n: int) -> np.ndarray:
    """Bits, of which those of n hashes are set."""
    marks = min(MOST_MARKS, max(LEAST_MARKS, 1 << (MARKS * n).bit_length()))
    at = F.pmod(F.col("text_hash"), F.lit(marks)) + 1  # the functions count from one
    rows = hashes.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(marks // 8, np.uint8)
    for r in rows.collect():
        own = np.frombuffer(r["bits"], np.uint8)
        out[(r["bucket"] - 1) * len(own) : r["bucket"] * len(own)] = own
    return out


def near_duplicates(spark: SparkSession, documents: DataFrame, mark: str | None = None, block: int = BLOCK, weight: int = SHINGLES) -> DataFrame:
    """documents(doc_id, text, ...) to (doc_id, root long, component_id, mark long), a row for each row, as
    simhash.near_duplicates, with links between texts whose sets of 5-word shingles (words between white
    space, A-Z in lower case; fewer words are one shingle) have a Jaccard similarity of 0.8 or more.

    Texts of equal sets are one node. Nodes within RADIUS of BITS bits that meet in a bucket of one of the
    tables are close; of these pairs each bucket gives a spanning forest. What closeness joins is a
    cluster, of few texts mostly; in it, the sets of all texts are compared, so that no link is wrong,
    and a link is missed only where two texts are in no cluster together: they would have to be
    further apart in bits, or meet in no table, and no third text to join them. See RECALL and the
    README's figures. A bucket of more than block nodes, or a cluster of more than weight shingles, is
    cut into blocks, and each pair of blocks is a task that returns a spanning forest, never all pairs.

    Null and empty texts, and texts without words, are equal; texts of any length are hashed whole; rows
    of one doc_id are rows of one id, and a null one counts only where its component has no other. No
    rows: no rows. Other columns are ignored, whatever their names."""
    text_hash = F.xxhash64("text").alias("text_hash")
    docs = pick(documents, "text", "doc_id", *([mark] if mark else [])).toDF("text", "doc_id", *(["mark"] if mark else []))
    docs = docs.select("text", "doc_id", (F.col("mark") if mark else F.xxhash64("text")).cast("long").alias("mark"), text_hash)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, mark long, text_hash long, key long, n long, " + ", ".join(f"{f} long" for f in FP)
    rows, _ = written(spark, docs.mapInArrow(_print_batches, schema), "prints")
    nodes, _ = written(spark, rows.groupBy("key").agg(*[F.first(f).alias(f) for f in FP]), "nodes", rows.count())

    different = nodes.count()
    positions = tables(different)
    dealt = nodes.mapInArrow(_bucket_batches(positions), "bucket long, key long, " + ", ".join(f"{f} long" for f in FP))
    blocks = dealt.groupBy("bucket").agg(F.ceil(F.count("*") / block).alias("blocks")).where("blocks > 1")
    close = _met(_tiles(spark, dealt, "bucket", blocks, different * len(positions) // block), "bucket").mapInArrow(_forest_batches, "a long, b long").distinct()
    clusters, _ = written(spark, star_components(spark, close).select(F.col("root").alias("cluster"), F.col("node").alias("key")), "clusters", different)

    n = clusters.count()
    chosen = rows.join(sized(clusters, n), "key").groupBy("cluster", "key").agg(F.min("text_hash").alias("text_hash"), F.first("n").alias("n"))
    chosen, _ = written(spark, chosen, "chosen", n)
    texts = docs.select("text", "text_hash")
    if n > common.BROADCAST_ROWS:
        texts = texts.mapInArrow(_marked_batches(_marks(chosen, n)), texts.schema)
    texts = texts.join(sized(chosen.select("key", "text_hash"), n), "text_hash").groupBy("key").agg(F.first("text").alias("text"))
    blocks = chosen.groupBy("cluster").agg(F.ceil(F.sum("n") / weight).alias("blocks")).where("blocks > 1")
    placed = _tiles(spark, chosen.select("cluster", "key"), "cluster", blocks, n)
    links = _met(placed.join(texts, "key").select("cluster", "tile", "key", "text"), "cluster").mapInArrow(_link_batches, "a long, b long").distinct()
    roots, _ = written(spark, star_components(spark, links).select(F.col("node").alias("key"), "root"), "roots", n)

    least = rows.groupBy("key").agg(F.min("doc_id").alias("first")).join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    ids = least.groupBy("root").agg(F.min("first").alias("component_id"))
    member = least.select("key", "root").join(ids, "root")
    return rows.select("doc_id", "mark", "key").join(member, "key").select("doc_id", "root", "component_id", "mark")
