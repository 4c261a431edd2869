import gzip
import hashlib
import io
import os

import pytest
from pyspark.sql import functions as F

from joinloom.llm import queries, warc

SCHEMA = "page_id long, url string, html string"


def brute(rows):
    groups = {}
    for p, _, h in rows:
        groups.setdefault(h or "", []).append(p)
    out = []
    for p, _, h in rows:
        body = (h or "").encode()
        ids = [x for x in groups[h or ""] if x is not None]
        last = max(ids) if ids else None
        refers = last if len(body) >= 1000 and last is not None and p != last else None
        out.append((p, len(body), hashlib.sha1(body).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


def roundtrip(spark, df):
    return sorted(map(tuple, warc.read_back(spark, *warc.archive(spark, df)).collect()), key=repr)


def test_roundtrip(spark):
    big, wide = "<p>x</p>" * 200, "é日" * 250
    rows = [(1, "http://a/", big), (2, "http://b/ c\r\nX: y%", big), (9, None, big), (3, "u", "x" * 999), (4, "u", "x" * 999), (5, "u", "x" * 1000), (6, "u", "x" * 1000), (7, "u", None), (8, "u", ""), (10, "u", wide), (11, "u", wide + "!"), (12, "u", wide), (13, "u", "WARC/1.1\r\n\r\n" * 300), (None, "u", big), (14, "u", "y" * 5_000_000), (None, None, None)]
    assert roundtrip(spark, spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(rows)


def test_many_copies_and_repeated_rows(spark):
    rows = [(i, "u", "z" * 2000) for i in range(300)] + [(299, "v", "z" * 2000), (500, "u", "w" * 2000), (500, "u", "w" * 2000)]
    assert roundtrip(spark, spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_empty(spark):
    assert roundtrip(spark, spark.createDataFrame([], SCHEMA)) == []


def test_clashing_columns(spark):
    rows = [(1, "u", "q" * 1500), (2, "u", "q" * 1500)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"digest": F.lit("d"), "size": F.lit(1), "refers_to": F.lit(2), "row": F.lit(3)})
    assert roundtrip(spark, df) == brute(rows)


def test_whole_table(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, queries.QUERIES["op5_warc_normalise"](spark, data).collect()), key=repr) == brute(rows)


def blocks(n=5):
    payloads = [bytes([65 + i]) * (10 ** min(i, 6)) for i in range(n)]
    return payloads, b"".join(b"".join(warc.record(i, i, f"http://{i}/", p, None, False)) for i, p in enumerate(payloads))


@pytest.mark.parametrize("members", [1, 2, 7])
def test_normalise_any_gzip_layout(members):
    payloads, raw = blocks()
    step = -(-len(raw) // members)
    mono = b"".join(gzip.compress(raw[i : i + step]) for i in range(0, len(raw), step))
    sink = io.BytesIO()
    index = list(warc.normalise(io.BytesIO(mono), sink))
    data = sink.getvalue()
    assert gzip.decompress(data) == raw and index[-1][0] + index[-1][1] == len(data)
    for (offset, length), p in zip(index, payloads, strict=True):
        assert warc.read_member(data[offset : offset + length])["payload_digest"] == hashlib.sha1(p).hexdigest()


def test_cut_and_wrong_archives():
    _, raw = blocks(3)
    mono = gzip.compress(raw)
    with pytest.raises(EOFError):
        list(warc.normalise(io.BytesIO(mono[:-30]), io.BytesIO()))
    with pytest.raises(EOFError):
        list(warc.normalise(io.BytesIO(gzip.compress(raw[:-40])), io.BytesIO()))
    with pytest.raises(ValueError):
        list(warc.normalise(io.BytesIO(gzip.compress(b"nonsense\r\n")), io.BytesIO()))
    with pytest.raises(ValueError):
        warc.read_member(gzip.compress(raw.replace(b"CCC", b"CXC", 1)[len(b"".join(warc.record(0, 0, "http://0/", b"A", None, False))) :].replace(b"BBB", b"BXB", 1)))
    assert list(warc.normalise(io.BytesIO(b""), io.BytesIO())) == []


@pytest.mark.parametrize("most", [1, 3, 4096])
def test_parts_of_the_index_are_read_alone(spark, most):
    rows = [(i, "u", f"page {i} " * (i % 5 * 50)) for i in range(40)]
    folder, files = warc.archive(spark, spark.createDataFrame(rows, SCHEMA).coalesce(2))
    got = sorted(map(tuple, warc.read_back(spark, folder, files, most).collect()), key=repr)
    assert got == brute(rows)


def test_archives_that_are_there(spark, tmp_path):
    """Whole-file gzip, many members, an empty file, cut and wrong ones, a path twice, one name in two folders."""
    payloads, raw = blocks()
    ok = {"a/mono.warc.gz": gzip.compress(raw), "b/mono.warc.gz": b"".join(gzip.compress(raw[i : i + 999]) for i in range(0, len(raw), 999)), "a/empty.warc.gz": b"", "a/none.gz": gzip.compress(b"")}
    bad = {"a/cut.warc.gz": gzip.compress(raw)[:-50], "a/other.warc.gz": gzip.compress(b"nonsense\r\n"), "a/plain.warc.gz": b"no gzip at all"}
    for name, data in (ok | bad).items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    paths = [f"{tmp_path}/{n}" for n in (ok | bad)] + [f"file://{tmp_path}/a/mono.warc.gz", f"{tmp_path}/a/mono.warc.gz", f"{tmp_path}/missing.gz", None]
    got = warc.normalised(spark, spark.createDataFrame([(x, 1) for x in paths], "path string, file long")).collect()
    assert sorted(r.path or "" for r in got) == sorted(x or "" for x in paths)
    folder = got[0].folder.removeprefix("file://")
    for r in got:
        name = (r.path or "").removeprefix("file://").removeprefix(f"{tmp_path}/")
        if name not in ok:
            assert r.error and r.file is None and r.records is None
            continue
        assert r.error is None and r.records == (5 if "mono" in name else 0)
        with open(f"{folder}/{r.file}.warc.gz", "rb") as f:
            data = f.read()
        assert (gzip.decompress(data) if data else b"") == (raw if "mono" in name else b"")
        index = list(warc.entries(warc.file_system(r.folder)[0], f"{folder}/{r.file}.idx", 0, 100))
        assert [warc.read_member(data[o : o + n])["payload_digest"] for o, n in index] == [hashlib.sha1(p).hexdigest() for p in payloads][: len(index)] and len(index) == r.records
    assert not [n for n in os.listdir(folder) if any(x in n for x in ("cut", "other", "plain"))]
    assert warc.normalised(spark, spark.createDataFrame([], "path string")).collect() == []
