import os
from pathlib import Path

import pytest
import test_decontaminate
import test_mixing
import test_secrets
import test_similar
from pyspark.sql import Row
from pyspark.sql import functions as F

import corpus_pipeline
from joinloom.llm import langid, queries
from joinloom.llm.common import shared_dir, written

ORDER = ["language_id", "simhash_near_dedup", "decontamination", "secret_scan", "mixing"]


def docs_of(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def kept_languages(spark, rows, model):
    best, _, fits = langid.decide(model, [r.text for r in rows])
    return [r for r, k, fit in zip(rows, best, fits, strict=True) if k >= 0 and fit]


def one_of_each(rows):
    """By all pairs' sets of shingles."""
    found = dict(test_similar.brute_components([(r.doc_id, r.text) for r in rows]))
    return [r for r in rows if found[r.doc_id] == r.doc_id]


def without_benchmark(rows, items):
    """No run of ten words or more of windows of ten words."""
    windows = {tuple(w[k : k + 10]) for w in map(test_decontaminate.words, items) for k in range(max(1, len(w) - 9) if w else 0)}
    lengths, out = {len(w) for w in windows}, []
    for r in rows:
        w = test_decontaminate.words(r.text)
        hit = "".join("x" if any(tuple(w[k : k + n]) in windows for n in lengths for k in range(max(0, i - n + 1), i + 1) if len(w) - k >= n) else " " for i in range(len(w)))
        if all(len(run) < 10 for run in hit.split()):
            out.append(r)
    return out


def without_secrets(rows):
    """Live values by test_secrets' sets of owners and repositories, masked from the last to the first."""
    by, out = {r.doc_id: r.text for r in rows}, {}
    for d, spans, _, _ in test_secrets.brute_spans([(r.doc_id, r.text, r.source) for r in rows]):
        text = by[d]
        for a, b in sorted({tuple(map(int, x.split(":")[1:])) for x in spans.split(",") if x.startswith("live")}, reverse=True):
            text = f"{text[:a]}[SECRET]{text[b:]}"
        out[d] = text
    return [Row(**(r.asDict() | {"text": out[r.doc_id]})) for r in rows]


def test_run_against_brute_force(spark, data):
    """The stages one by one and as a whole, each by other means on what the one before left."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ORDER
    docs, items = docs_of(spark, data), [r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    columns, stages, rows = docs.columns, dict(corpus_pipeline.STAGES), docs.collect()
    model = langid.learn(langid.learned_rows(docs))
    by = {"language_id": lambda r: kept_languages(spark, r, model), "simhash_near_dedup": one_of_each, "decontamination": lambda r: without_benchmark(r, items), "secret_scan": without_secrets}
    for name, brute in by.items():
        kept, _ = written(spark, stages[name](spark, docs, data), "t")
        before, rows, docs = rows, brute(rows), kept
        got = kept.collect()
        assert kept.columns == columns and sorted((r.doc_id, r.text, r.lang, r.source) for r in got) == sorted((r.doc_id, r.text, r.lang, r.source) for r in rows), name
        assert len(rows) > 100 and (rows != before or name == "language_id"), name
    want, _ = test_mixing.brute_queue([(r.doc_id, r.text, r.source) for r in rows])
    got = corpus_pipeline.run(spark, data)
    assert sorted((r.doc_id, r.taken) for r in got.collect()) == sorted((r.doc_id, k) for r, k in zip(rows, want, strict=True))
    assert corpus_pipeline.ORACLE_SQL is None


def test_a_corpus_without_labels_passes_language_id(spark, data):
    docs = docs_of(spark, data).withColumn("lang", F.lit(None).cast("string"))
    assert sorted(map(tuple, corpus_pipeline.language_id(spark, docs, data).collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)


def test_run_leaves_its_result_alone(spark, data):
    """Of the tables written on the way none stays."""
    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = set(os.listdir(folder))
    got = corpus_pipeline.run(spark, data)
    assert got.count() and len(set(os.listdir(folder)) - before) == 1


@pytest.mark.parametrize("rows", [0, 40])
def test_odd_tables(spark, data, tmp_path, rows):
    """No rows; nulls in every column, repeated rows and more columns."""
    docs = docs_of(spark, data).limit(rows)
    odd = [(None, None, None, None, None), (1, None, "en", None, 0), (1, None, "en", None, 0), (None, "That of the", None, "s", 3), (7, "", None, None, None)]
    if rows:
        docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    docs = docs.withColumns({"size": F.lit(1), "found": F.lit("x"), "row": F.lit(2)})
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs, _ = written(spark, stage(spark, docs, data), name)
        if name != "mixing":
            assert docs.columns == names
    assert docs.count() >= rows // 2


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert set(queries.QUERIES) <= set(names) and set(queries.ORACLES) <= set(entry.oracle_sql())
