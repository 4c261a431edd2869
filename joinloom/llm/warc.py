"""WARC archives: writing, normalising whole-file gzip, and reading by an offset index.

A monolithic archive is one gzip stream over all its records, so that no record can be read without
inflating what stands before it. The normaliser inflates such a file once, front to back, and writes
every record as a gzip member of its own beside an index of the members' offsets.

An archive NAME.warc.gz has its index in NAME.idx: for each member its offset and its length, each a
little-endian 64-bit number, so that any part of the index can be read without the rest."""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinloom.llm.common import file_system, fresh_path, pick, raw_texts, written

#: Payloads of fewer bytes are always stored, never referred to.
REVISIT_BYTES = 1000
CHUNK = 1 << 20
#: The monolithic file is a stopover; the normalised one stays.
RAW_LEVEL, LEVEL = 1, 4
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n"
DATE = b"1970-01-01T00:00:00Z"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = b"urn:page:"
#: Bytes of a member's entry in the index.
ENTRY = 16


def _uri(url: str | None) -> bytes:
    """A header value can't hold line ends or other controls: they are percent-encoded, as is %."""
    return b"".join(b"%%%02X" % c if c < 33 or c in (37, 127) else bytes([c]) for c in (url or "").encode())


def record(row_id: int, page_id: object, url: str | None, payload: bytes, refers_to: object, revisit: bool) -> Iterator[bytes]:
    """A response or revisit record, as pieces of bytes. Both carry the full payload's digest and
    length; a revisit has no payload."""
    digest = base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest())
    http = HTTP % len(payload)
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        b"WARC-Record-ID: <urn:row:%d>" % row_id,
        b"WARC-Date: " + DATE,
        b"WARC-Payload-Digest: sha1:" + digest,
        b"WARC-Payload-Length: %d" % len(payload),
        b"Content-Type: application/http;msgtype=response",
    ]
    if page_id is not None:
        head.append(b"WARC-Page-ID: %d" % page_id)
    if url is not None:
        head.append(b"WARC-Target-URI: " + _uri(url))
    if revisit:
        head += [b"WARC-Profile: " + PROFILE, b"WARC-Refers-To: <" + RECORD + b"%d>" % refers_to]
    length = len(http) + (0 if revisit else len(payload))
    yield b"\r\n".join([*head, b"Content-Length: %d" % length]) + b"\r\n\r\n" + http
    if not revisit:
        yield payload
    yield b"\r\n\r\n"


class Inflated:
    """Reads a gzip file's bytes front to back, whatever members it has, holding a chunk at a time."""

    def __init__(self, source: io.IOBase):
        self.source, self.held, self.z, self.begun = source, bytearray(), zlib.decompressobj(31), False

    def _more(self) -> bool:
        """Holds more bytes, if there are any; False at the end of the last member."""
        if self.z.eof:
            data = self.z.unused_data or self.source.read(CHUNK)
            if not data:
                return False
            self.z = zlib.decompressobj(31)
        else:
            data = self.z.unconsumed_tail or self.source.read(CHUNK)
        out = self.z.decompress(data, CHUNK)
        if not (data or out or self.z.eof):
            if not self.begun:
                return False
            raise EOFError("the archive ends inside a gzip member")
        self.begun = True
        self.held += out
        return True

    def line(self) -> bytes:
        """Up to a line end, which is taken off; empty at the end of the file."""
        at, seen = -1, 0
        while (at := self.held.find(b"\n", seen)) < 0:
            seen = len(self.held)
            if not self._more():
                if self.held:
                    raise EOFError("the archive ends inside a record")
                return b""
        out = bytes(self.held[: at + 1])
        del self.held[: at + 1]
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self._more():
                raise EOFError("the archive ends inside a record")
            part = bytes(self.held[: min(n, CHUNK)])
            del self.held[: len(part)]
            n -= len(part)
            if part:
                yield part


def records(source: Inflated) -> Iterator[tuple[dict[bytes, bytes], bytes, Iterator[bytes]]]:
    """Each record's headers, its head as it stands in the file, and its block, piece by piece. A
    block that isn't read to its end is skipped."""
    while line := source.line():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record here: {line[:40]!r}")
        head, headers = [line], {}
        while (line := source.line()).strip():
            head.append(line)
            name, _, value = line.partition(b":")
            headers[name.strip().lower()] = value.strip()
        head.append(b"\r\n")
        block = source.pieces(int(headers.get(b"content-length", b"0")))
        yield headers, b"".join(head), block
        for _ in block:
            pass


def normalise(source: io.IOBase, sink: io.IOBase, level: int = LEVEL) -> Iterator[tuple[int, int]]:
    """Inflates source once and writes every record to sink as a gzip member; yields each member's
    offset and length. A record passes through in pieces, however large it is."""
    offset = 0
    for _, head, block in records(Inflated(source)):
        z, length = zlib.compressobj(level, zlib.DEFLATED, 31), 0
        for part in _framed(head, block):
            data = z.compress(part)
            sink.write(data)
            length += len(data)
        data = z.flush()
        sink.write(data)
        length += len(data)
        yield offset, length
        offset += length


def _framed(head: bytes, block: Iterator[bytes]) -> Iterator[bytes]:
    yield head
    yield from block
    yield b"\r\n\r\n"


def read_member(data: bytes) -> dict:
    """What a record's member says, its payload's digest computed from the payload where it is there."""
    for headers, _, block in records(Inflated(io.BytesIO(data))):
        kind = headers[b"warc-type"].decode()
        stated = headers[b"warc-payload-digest"].removeprefix(b"sha1:")
        digest, size, rest = hashlib.sha1(usedforsecurity=False), 0, b""
        body = False
        for part in block:
            if not body:
                rest += part
                at = rest.find(b"\r\n\r\n")
                if at < 0:
                    continue
                part, body = rest[at + 4 :], True
            digest.update(part)
            size += len(part)
        if kind == "response" and (digest.digest() != base64.b32decode(stated) or size != int(headers[b"warc-payload-length"])):
            raise ValueError("a payload is not what its record's digest says")
        refers = headers.get(b"warc-refers-to")
        page = headers.get(b"warc-page-id")
        return {
            "page_id": None if page is None else int(page),
            "payload_bytes": int(headers[b"warc-payload-length"]),
            "payload_digest": base64.b32decode(stated).hex(),
            "record_type": kind,
            "refers_to": None if refers is None else int(refers[1:-1].removeprefix(RECORD)),
        }
    raise ValueError("a member without a record")


def _copied(fs: pafs.FileSystem, source: io.IOBase, tried: str, final: str) -> int:
    """Normalises one stream to final.warc.gz and final.idx, by way of files named tried; returns the number
    of records. Files appear under their final names only when they are whole, the index last."""
    records = 0
    try:
        with fs.open_output_stream(f"{tried}.warc.gz", compression=None) as out, fs.open_output_stream(f"{tried}.idx", compression=None) as side:
            for offset, length in normalise(source, out):
                side.write(struct.pack("<QQ", offset, length))
                records += 1
    except Exception:
        for name in (f"{tried}.warc.gz", f"{tried}.idx"):
            fs.delete_file(name)
        raise
    fs.move(f"{tried}.warc.gz", f"{final}.warc.gz")
    fs.move(f"{tried}.idx", f"{final}.idx")
    return records


def _write(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each partition's rows (row, page_id, url, html, refers_to, revisit) to one monolithic archive,
    which is then normalised. A task that runs again writes the same name. Yields (file, records)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, at = file_system(folder)
        fs.create_dir(at, recursive=True)
        part = TaskContext.get()
        name = f"part-{part.partitionId():06d}"
        tried = f"{at}/_{name}-{part.taskAttemptId()}"
        rows = 0
        with fs.open_output_stream(f"{tried}.raw", compression=None) as out:
            z = zlib.compressobj(RAW_LEVEL, zlib.DEFLATED, 31)
            for batch in batches:
                columns = [batch.column(k).to_pylist() for k in (0, 1, 2, 4, 5)]
                for row, page, url, refers, revisit, html in zip(*columns, raw_texts(batch.column(3)), strict=True):
                    rows += 1
                    for piece in record(row, page, url, html or b"", refers, revisit):
                        out.write(z.compress(piece))
            out.write(z.flush())
        if rows:
            with fs.open_input_stream(f"{tried}.raw", compression=None) as raw:
                found = _copied(fs, raw, tried, f"{at}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([found], pa.int64())], names=["file", "records"])
        fs.delete_file(f"{tried}.raw")

    return write


def _read(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows (file, first, last): the records that the sidecar lists from first to last, each read
    by its offset alone."""
    kinds = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = file_system(folder)
        for batch in batches:
            for want in batch.to_pylist():
                with fs.open_input_file(f"{at}/{want['file']}.warc.gz") as source:
                    found = [read_member(source.read_at(n, o)) for o, n in entries(fs, f"{at}/{want['file']}.idx", want["first"], want["last"])]
                yield pa.RecordBatch.from_pylist(found, schema=kinds)

    return read


def entries(fs: pafs.FileSystem, index: str, first: int, last: int) -> Iterator[tuple[int, int]]:
    """(offset, length) of the members from first to last, or to the end, of an index."""
    with fs.open_input_file(index) as side:
        part = side.read_at(ENTRY * (last - first), ENTRY * first)
    return struct.iter_unpack("<QQ", part)


def normalised(spark: SparkSession, files: DataFrame, folder: str | None = None) -> DataFrame:
    """Archives that are there already: files(path), each a gzip file of WARC records in as many members as
    it may have, to (path, file, records long, error), a row for each. They are normalised into a folder, by
    default a new one in the shared folder, which is column `folder`: file.warc.gz has each record as a
    member, file.idx their offsets and lengths. file is the path's name without its ending, and a hash of the
    path, so that files of one name in several folders don't meet.

    An archive is a task, since a gzip stream can only be inflated front to back; it passes through in
    pieces, however large it and its records are. Archives that are cut off or hold something else are not
    written: error says why, and the others are. An empty file has no records; a null path is an error of
    its row; a path that is listed again is done again, with the same result. No rows: no rows. Other
    columns are ignored."""
    folder = folder or fresh_path(spark, "warc")
    kinds = pa.schema([("path", pa.string()), ("folder", pa.string()), ("file", pa.string()), ("records", pa.int64()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, at = file_system(folder)
        fs.create_dir(at, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for path in batch.column(0).to_pylist():
                row = {"path": path, "folder": folder, "file": None, "records": None, "error": None}
                try:
                    if path is None:
                        raise ValueError("no path")
                    name = f"{path.rstrip('/').rpartition('/')[2].removesuffix('.gz').removesuffix('.warc')}-{hashlib.sha1(path.encode(), usedforsecurity=False).hexdigest()[:12]}"
                    tried = f"{at}/_{name}-{attempt}"
                    own, source = file_system(path if "://" in path or path.startswith("file:") else f"file://{path}")
                    if not (info := own.get_file_info(source)).is_file:
                        raise FileNotFoundError(path)
                    if info.size:
                        with own.open_input_stream(source, compression=None) as raw:
                            row["records"] = _copied(fs, raw, tried, f"{at}/{name}")
                    else:
                        row["records"] = _copied(fs, io.BytesIO(), tried, f"{at}/{name}")
                    row["file"] = name
                except (ValueError, EOFError, OSError, zlib.error) as e:
                    row["error"] = f"{type(e).__name__}: {e}"[:500]
                yield pa.RecordBatch.from_pylist([row], schema=kinds)

    paths = pick(files, "path").select(F.col("path").cast("string").alias("path"))
    tasks = max(1, paths.count())
    out = paths.repartition(tasks).mapInArrow(run, "path string, folder string, file string, records long, error string")
    return written(spark, out, "normalised")[0]


def archive(spark: SparkSession, pages: DataFrame, folder: str | None = None, least: int = REVISIT_BYTES) -> tuple[str, DataFrame]:
    """Writes a record for each pages row (page_id, url, html) to normalised archives in a folder, by
    default a new one in the shared folder; returns it and (file, records).

    Of records with equal payloads of at least `least` bytes that with the largest page_id is the
    response and the others revisit it; rows that repeat that page_id are responses, too. Smaller
    payloads are always responses. A null html is an empty payload; a null url leaves its header out;
    a null page_id counts as the smallest. No rows: no archives. Other columns are ignored."""
    folder = folder or fresh_path(spark, "warc")
    rows = pick(pages, "page_id", "url", "html").withColumn("page_id", F.col("page_id").cast("long"))
    body = F.coalesce("html", F.lit("")).cast("binary")
    alone = F.concat(F.lit("row "), F.xxhash64("page_id", "url").cast("string"))  # meets nothing
    keyed = rows.withColumn("size", F.length(body)).withColumn("digest", F.when(F.col("size") >= least, F.sha1(body)).otherwise(alone))
    last = keyed.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    last, _ = written(spark, last, "payloads")
    # A payload that very many pages share is a hot key, which the adaptive join splits.
    joined = keyed.join(last, ["digest", "size"], "left")
    revisit = F.coalesce(F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to")), F.lit(False))
    out = joined.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", "html", "refers_to", revisit.alias("revisit"))
    files, _ = written(spark, out.mapInArrow(_write(folder), "file string, records long"), "archives")
    return folder, files


def read_back(spark: SparkSession, folder: str, files: DataFrame, each: int = 4096) -> DataFrame:
    """files(file, records) in a folder to a row for each record, from `each` records of a file at a
    time: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    parts = files.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.col("records") - 1, F.lit(each).cast("long"))).alias("first"))
    wanted = parts.select("file", "first", (F.col("first") + each).alias("last"))
    # A row is a long read: one row, not so many bytes of rows, is the unit of a task.
    tasks = max(1, min(wanted.count(), 4 * spark.sparkContext.defaultParallelism))
    return wanted.repartition(tasks).mapInArrow(_read(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
