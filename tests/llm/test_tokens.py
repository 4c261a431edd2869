import base64
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from joinloom.llm import queries, tokens

SCHEMA = "doc_id long, text string"


def write(folder, name, ids, dtype="<u2"):
    (folder / name).write_bytes(np.array(ids, dtype).tobytes())


def scanned(spark, folder, **how):
    return sorted(map(tuple, tokens.scan(spark, f"file://{folder}", **how).collect()))


def brute(files, end):
    out = []
    for name, ids in files.items():
        start = n = 0
        for at, x in enumerate(ids):
            if x == end:
                out.append((name, n, start, at - start))
                start, n = at + 1, n + 1
        if start < len(ids):
            out.append((name, n, start, len(ids) - start))
    return sorted(out)


@pytest.mark.parametrize("block, scan_blocks", [(1, 1), (1, 3), (3, 2), (7, 1024), (1 << 20, 1024)])
def test_blocks_are_stitched(spark, tmp_path, block, scan_blocks):
    rng = np.random.default_rng(4)
    files = {f"{k}.tok": rng.choice([1, 2, 9], n, p=[0.5, 0.3, 0.2]).tolist() for k, n in enumerate([0, 1, 2, 5, 40, 90])}
    files |= {"ends.tok": [9, 9, 9], "none.tok": [1] * 30, "late.tok": [1] * 29 + [9]}
    for name, ids in files.items():
        write(tmp_path, name, ids)
    write(tmp_path, "_passed-over", [1, 9])
    assert scanned(spark, tmp_path, end=9, block=block, scan_blocks=scan_blocks) == brute(files, 9)


def test_wide_ids_and_bad_files(spark, tmp_path):
    write(tmp_path, "a", [70_000, 5, 70_000], "<u4")
    assert scanned(spark, tmp_path, end=70_000, dtype="<u4") == [("a", 0, 0, 0), ("a", 1, 1, 1)]
    (tmp_path / "b").write_bytes(b"abc")
    with pytest.raises(ValueError, match="ends inside"):
        scanned(spark, tmp_path)


def test_no_files(spark, tmp_path):
    assert scanned(spark, tmp_path) == []


def test_counts_are_those_of_the_tokenizer(spark, data):
    encode = tokens._encoding(tokens.vocabulary()).encode_ordinary
    got = queries.QUERIES["op3_token_counts"](spark, data).collect()
    want = [(r.doc_id, len(encode(r.text))) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("run", [" ", "\n", "\t ", "\u3000\xa0", "a", "7", "!", "é", "\x1f"])
@pytest.mark.parametrize("around", [("", ""), ("word", ""), ("", "word"), ("one 2", " two"), ("don't", "'s"), ("!", "!"), ("x ", " y" + " " * 30_000 + "z")])
def test_long_runs_are_cut_where_the_pattern_cuts(run, around, monkeypatch):
    """Against the tokenizer itself, at a length that it takes."""
    encoding = tokens._encoding(tokens.vocabulary())
    text = around[0] + run * (50_000 // len(run)) + around[1]
    assert tokens.encoded(encoding, text) == encoding.encode_ordinary(text)
    monkeypatch.setattr(tokens, "SPACES", re.compile(tokens.SPACES.pattern.replace("20000", "2")))
    for short in (text[-200:], f"{around[0]}{run * 3}{around[1]}{run}a  b \n\n c{run * 2}"):
        assert tokens.encoded(encoding, short) == encoding.encode_ordinary(short)


def test_runs_that_the_tokenizer_cannot_take(spark):
    """A million characters of one kind. Beyond what the tokenizer takes, n blanks and a word are the piece of
    n - 1 blanks, and the word with the last of them."""
    ranks = tokens.vocabulary()
    encoding = tokens._encoding(ranks)
    n = 1_000_000
    rows = [(1, " " * n), (2, " " * n + "word"), (3, "\n" * n), (4, "a" * n), (5, "7" * n), (6, "x" + "\t" * n)]
    got = dict(map(tuple, tokens.counted(spark, spark.createDataFrame(rows, SCHEMA).repartition(4), ranks).collect()))
    piece = lambda text: len(encoding._core_bpe.encode_single_piece(text.encode()))
    assert got == {1: piece(" " * n), 2: piece(" " * (n - 1)) + piece(" word"), 3: piece("\n" * n), 4: piece("a" * n), 5: piece("7" * n), 6: piece("x") + piece("\t" * n)}


def test_wide_vocabularies(spark):
    one = b"\n".join(base64.b64encode(bytes([k])) + b" %d" % k for k in range(256))
    assert tokens.width_of(one, 256) == "<u2"
    with pytest.raises(ValueError, match="end id"):
        tokens.width_of(one, 7)
    wide = one + b"\n" + base64.b64encode(b"ab") + b" 70000"
    assert tokens.width_of(wide, 256) == tokens.width_of(one, 70000) == "<u4"
    with pytest.raises(ValueError, match="four bytes"):
        tokens.width_of(one, 1 << 32)
    assert tokens.counted(spark, spark.createDataFrame([(1, "abc")], SCHEMA), wide, 256).first().n_tokens == 2


def test_odd_rows(spark):
    ranks = tokens.vocabulary()
    encode = tokens._encoding(ranks).encode_ordinary
    rows = [(1, None), (2, ""), (3, "<|endoftext|>"), (4, "é日本 \n\n  x"), (4, "é日本 \n\n  x"), (None, "null id"), (5, "word " * 50_000)]
    wide = spark.createDataFrame(rows, SCHEMA).withColumns({"file": F.lit(1), "ordinal": F.lit(2), "n_tokens": F.lit(3)})
    got = tokens.counted(spark, wide, ranks).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((d, len(encode(t or ""))) for d, t in rows), key=repr)
    assert tokens.counted(spark, spark.createDataFrame([], SCHEMA), ranks).collect() == []
