import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from joinloom.llm import decontaminate, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(docs, items):
    windows = {}
    for i, text in items:
        w = words(text)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    out = []
    for d, text in docs:
        w = words(text)
        hit, own = set(), set()
        for k in range(len(w)):
            for n in range(1, 11):
                if len(w) - k >= n and (found := windows.get(tuple(w[k : k + n]))):
                    hit.update(range(k, k + n))
                    own |= {str(x) for x in found if x is not None}
        out.append((d, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def op1(spark, docs, items, tmp_path):
    d = f"file://{tmp_path}"
    docs.write.parquet(f"{d}/documents.parquet")
    items.write.parquet(f"{d}/benchmark.parquet")
    return sorted(map(tuple, queries.QUERIES["op1_decontaminate"](spark, d).collect()), key=repr)


def cases():
    rng = random.Random(3)
    vocabulary = [*"abcdefgh", "Été", "ß", "x1", "日本語"]
    say = lambda n: rng.choice([" ", "-", ". ", "\t", "\x00"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.choice([1, 2, 9, 10, 11, 25]))) for i in range(5, 25)]
    items = [(i, t) for i, t in items if len(words(t)) > 2] + [(30, None), (31, ""), (32, "-- !"), (33, "Q Q Q"), (33, "other item same id r r r"), (None, "no id at all here"), (34, "q q q")]
    docs = [(i, say(rng.choice([0, 1, 5, 30, 80])) + " " + (rng.choice(items)[1] or "") + " " + say(rng.choice([0, 3]))) for i in range(120)]
    docs += [(500, None), (501, ""), (502, "Q-q q"), (502, "Q-q q"), (None, "NO id at all, here"), (503, "a " * 30_000 + "q q q"), (504, "q q q q q"), (505, "aq q q")]
    return docs, items


def test_query_against_brute_force(spark, tmp_path):
    docs, items = cases()
    got = op1(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), tmp_path)
    assert got == brute(docs, items)


@pytest.mark.parametrize("docs, items", [([], [(1, "a")]), ([(1, "a")], []), ([], [])])
def test_empty_tables(spark, tmp_path, docs, items):
    got = op1(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), tmp_path)
    assert got == brute(docs, items)


def test_many_automata_find_the_same(spark):
    """Windows of many times what one automaton may hold: as many automata, one scan in one process."""
    docs, items = cases()
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    _, parts = decontaminate.build(spark, items, nodes=200)
    assert len(parts) >= 10
    many = decontaminate.find(spark, docs, items, nodes=200, held_bytes=2000)
    once, often = (sorted(map(tuple, x.collect()), key=repr) for x in (decontaminate.find(spark, docs, items), many))
    assert once == often
    assert many._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    for least in (1, 10):
        kept = [sorted(r.doc_id for r in decontaminate.clean(spark, docs.where("doc_id is not null"), items, nodes=n, held_bytes=2000, least=least).collect()) for n in (10**9, 200)]
        assert kept[0] == kept[1] == sorted(r[0] for r in once if r[0] is not None and all(x["to"] - x["from"] < least for x in r[2]))


def test_short_items_take_no_documents_away(spark):
    item = "what is the name of the sea that lies between these two old lands"
    docs = spark.createDataFrame([(1, "she said yes of course and left"), (2, f"so {item} then"), (3, None), (4, "")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "yes of course"), (2, item)], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.clean(spark, docs, items).collect()) == [1, 3, 4]
    assert sorted(r.doc_id for r in decontaminate.find(spark, docs, items).where("size(runs) > 0").collect()) == [1, 2]


def test_a_window_of_very_many_items(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.range(5000).selectExpr("id as item_id", "'b c' as text")
    (row,) = decontaminate.find(spark, docs, items).collect()
    assert row["items"] == sorted(map(str, range(5000)))


def test_spans_are_offsets_in_the_text_as_it_was(spark):
    text = "Início: «The\tQUICK brown—fox» jumps!"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "the quick BROWN")], "item_id long, text string")
    row = decontaminate.find(spark, df, items).first()
    assert [text[s.start : s.end] for s in row.spans] == []  # a dash above 0x7F is part of a word
    row = decontaminate.find(spark, spark.createDataFrame([(1, text.replace("—", " - ").replace("«", " "))], "doc_id long, text string"), items).first()
    assert [text.replace("—", " - ").replace("«", " ")[s.start : s.end] for s in row.spans] == ["The\tQUICK brown"]


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c", 2), (2, "x", 3)], "doc_id long, text string, n long").select("doc_id", "text", F.col("n").alias("n_words"), F.col("n").alias("items"), F.col("n").alias("TEXT"))
    items = spark.createDataFrame([(1, "b c", 0)], "item_id long, text string, doc_id long")
    assert sorted((r.doc_id, len(r.runs)) for r in decontaminate.find(spark, df, items).collect()) == [(1, 1), (2, 0)]
    kept = decontaminate.clean(spark, df, items, least=2)
    assert kept.columns == df.columns and [r[0] for r in kept.collect()] == [2]
    upper = spark.createDataFrame([(1, 5, "a b c"), (2, 6, "x")], "doc_id long, Text_ long, TEXT string")
    assert [r[0] for r in decontaminate.clean(spark, upper, items, least=2).collect()] == [2]
