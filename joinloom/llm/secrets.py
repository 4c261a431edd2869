"""Secret scans: candidates in every text, told apart by how many owners share them."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joinloom.llm.common import LOWER_ASCII, pick, place_of, positional, raw_texts, written

KINDS = ("assign", "access", "hex", "live")
#: A value that as many distinct owners have, or as many distinct repositories, whosever they are, is a
#: widely copied example.
SHARED_OWNERS, SHARED_REPOSITORIES = 3, 20
#: Bits a character that a live-looking value has at least.
LEAST_BITS = 2.5
#: Words in values that people write as stand-ins. Fixed values.
STAND_INS = ("example", "changeme", "placeholder", "dummy", "sample", "xxxx", "1234567890", "abcdefgh", "password", "your")

ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")
#: What must be in a text, lower-cased, for ASSIGN to match.
KEYWORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
HEX_ONLY = bytes(104 if i in b"0123456789abcdef" else 32 for i in range(256))

SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("vstart", pa.int64()), ("vend", pa.int64()), ("value", pa.int64()), ("looks", pa.bool_())])
SPAN_SQL = "array<struct<kind: int, start: long, end: long, vstart: long, vend: long, value: long, looks: boolean>>"


def looks_live(value: bytes) -> bool:
    """Not a stand-in, and with characters as mixed as a generated key's."""
    low = value.translate(LOWER_ASCII).decode("latin-1")
    if len(value) < 12 or any(w in low for w in STAND_INS):
        return False
    n = len(value)
    return -sum(c / n * log2(c / n) for c in Counter(value).values()) >= LEAST_BITS


def byte_spans(raw: bytes) -> list[tuple[int, int, int, int, int]]:
    """(kind, start, end, value start, value end) in bytes: assign, access and hex by their rules."""
    out = []
    low = raw.translate(LOWER_ASCII)
    if any(k in low for k in KEYWORDS):
        out += [(0, *m.span(), *m.span(2)) for m in ASSIGN.finditer(raw) if len(m[2]) >= 12]
    if b"AKIA" in raw:
        out += [(1, *m.span(), *m.span()) for m in ACCESS.finditer(raw) if len(m[0]) >= 18]
    if b"h" * 16 in raw.translate(HEX_ONLY):
        out += [(2, *m.span(), *m.span()) for m in HEX.finditer(raw)]
    return sorted(out, key=lambda s: (s[1], s[0]))


def candidates(raw: bytes | None) -> list[dict]:
    """Spans in code points, end exclusive, with the hash of the value."""
    if not raw or not (found := byte_spans(raw)):
        return []
    at = sorted({x for s in found for x in s[1:]})
    points, seen, n = {}, 0, 0
    for x in at:  # one pass over the bytes up to the last span
        n += len(raw[seen:x].decode())
        seen = x
        points[x] = n
    return [
        {"kind": k, "start": points[s], "end": points[e], "vstart": points[a], "vend": points[b], "value": xxhash.xxh64_intdigest(raw[a:b]) - 2**63, "looks": looks_live(raw[a:b])}
        for k, s, e, a, b in found
    ]


def _scan(at: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [candidates(raw) for raw in raw_texts(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(batch.columns) if k != at), pa.array(found, pa.list_(SPAN))], names=[*(n for k, n in enumerate(batch.schema.names) if k != at), "found"])

    return scan


def ownership(found: DataFrame, owners: int = SHARED_OWNERS, repositories: int = SHARED_REPOSITORIES) -> DataFrame:
    """found(row, owner, repository, found) to (value, owners, repositories, copied): by value the
    numbers of distinct owners and repositories, and whether either makes it a widely copied example.
    Duplicates are merged before the shuffles, so a value in a third of all rows is no hot key. A
    repository is its owner's: of two owners, repositories of one name are two. Null owners are one
    owner, null repositories none."""
    each = found.select(F.explode("found").alias("c"), "owner", "repository").select("c.value", "owner", "repository")
    by_owner = each.distinct().groupBy("value", "owner").agg(F.count("repository").alias("n"))
    counts = by_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))
    return counts.withColumn("copied", (F.col("owners") >= owners) | (F.col("repositories") >= repositories))


JUDGED = "array<struct<start: long, end: long, owners: long, repositories: long, copied: boolean>>"


def judged(rows: DataFrame, owners: int, repositories: int) -> DataFrame:
    """rows(row, owner, repository, found), only those with candidates, to (row, judged): the distinct
    spans of values that look live, with what ownership() says of them. A value that very many rows have
    is a hot key of the join with its counts, which adaptive execution splits."""
    spans = rows.select("row", F.explode("found").alias("c")).where("c.looks").select("row", F.col("c.vstart").alias("start"), F.col("c.vend").alias("end"), "c.value")
    told = spans.join(ownership(rows, owners, repositories), "value")
    return told.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "end", "owners", "repositories", "copied"))).alias("judged"))


def _live(spans: Column) -> Column:
    """Of judged spans those that aren't copied."""
    return F.transform(F.filter(spans, lambda s: ~s["copied"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def scan(spark: SparkSession, documents: DataFrame, owner: str = "source", repository: str = "doc_id", owners: int = SHARED_OWNERS, repositories: int = SHARED_REPOSITORIES) -> DataFrame:
    """documents(doc_id, text, ...) to (doc_id, base, judged, live), a row for each row. base: array of
    (kind, start, end) by start, then kind: 0 assign, 1 access, 2 hex. judged: array of (start, end,
    owners, repositories, copied) of the values that look live, with the numbers of distinct owners and
    repositories that have the value over the whole table; a value of `owners` owners or more, or of
    `repositories` repositories or more, is taken for an example that all have copied. live: array of
    (start, end) of the others, which are specific to their owners.

    documents has no repository column, so a source counts as an owner and a document as a repository
    of it unless told otherwise. Null owners are one owner. Null and empty texts have no spans, texts of
    any length are scanned whole. Repeated rows are a row each. Offsets are code points of the text. No
    rows: no rows. Other columns are ignored."""
    docs = pick(documents, "text", "doc_id", owner, repository).toDF("text", "doc_id", "owner", "repository")
    kinds = {n: docs.schema[n].dataType.simpleString() for n in ("doc_id", "owner", "repository")}
    found = docs.mapInArrow(_scan(0), f"doc_id {kinds['doc_id']}, owner {kinds['owner']}, repository {kinds['repository']}, found {SPAN_SQL}")
    found, _ = written(spark, found.withColumn("row", F.monotonically_increasing_id()), "candidates")
    some = found.where(F.size("found") > 0)
    empty = F.array().cast(JUDGED)
    told = some.join(judged(some, owners, repositories), "row", "left").select("doc_id", "found", F.coalesce("judged", empty).alias("judged"))
    every = told.unionByName(found.where(F.size("found") == 0).select("doc_id", "found", empty.alias("judged")))
    base = F.transform("found", lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return every.select("doc_id", base.alias("base"), "judged", _live(F.col("judged")).alias("live"))


def masked(spark: SparkSession, documents: DataFrame, owner: str = "source", repository: str = "doc_id", owners: int = SHARED_OWNERS, repositories: int = SHARED_REPOSITORIES) -> DataFrame:
    """The documents, whole and with their columns as they were, with live values replaced by [SECRET],
    and n_chars, if there is such a column, counted anew where there is one. All documents stay: null
    and empty texts as they are, each of repeated rows. No rows: no rows. The first column of a name
    counts, in any case.

    Texts are scanned once, and written with what was found, apart from those without candidates, which
    pass straight through; only the others are joined with what their values are."""
    names = list(documents.columns)
    flat = positional(documents)
    text, own, repo = (place_of(documents, n) for n in ("text", owner, repository))
    schema = flat.withColumn("found", F.lit(None).cast(SPAN_SQL)).schema
    scanned = flat.withColumn("_text", F.col(f"_{text}")).mapInArrow(_scan(len(names)), schema)
    scanned = scanned.withColumns({"row": F.monotonically_increasing_id(), "some": F.size("found") > 0})
    scanned, _ = written(spark, scanned, "scanned", by="some")
    some = scanned.where("some").drop("some")
    live = judged(some.select("row", F.col(f"_{own}").alias("owner"), F.col(f"_{repo}").alias("repository"), "found"), owners, repositories)
    live = live.select("row", _live(F.col("judged")).alias("live")).where(F.size("live") > 0)

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            spans = batch.column(len(names)).to_pylist()
            for i, found in enumerate(spans):
                out, at = [], 0
                for s in found or []:
                    if s["start"] < at:  # values can overlap: one mask covers both
                        at = max(at, s["end"])
                        continue
                    out += [texts[i][at : s["start"]], "[SECRET]"]
                    at = s["end"]
                if out:
                    texts[i] = "".join([*out, texts[i][at:]])
            columns = list(batch.columns[: len(names)])
            columns[text] = pa.array(texts, batch.schema.field(text).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[: len(names)])

    joined = some.drop("found").join(live, "row", "left")
    changed = joined.where("live is not null").drop("row").select(*flat.columns, "live").mapInArrow(mask, flat.schema)
    if "n_chars" in [n.lower() for n in names]:
        count = f"_{place_of(documents, 'n_chars')}"
        changed = changed.withColumn(count, F.length(f"_{text}").cast(flat.schema[count].dataType))
    rest = joined.where("live is null").select(*flat.columns)
    plain = scanned.where("not some").select(*flat.columns)
    return plain.unionByName(rest).unionByName(changed).toDF(*names)
