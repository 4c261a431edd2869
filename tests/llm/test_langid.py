import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from joinloom.llm import langid, queries

SCHEMA = "doc_id long, text string, lang string, source string"
TEXTS = {"aa": ["the cat sat on the mat", "the mat", "a cat!"], "bb": ["le chat est la", "la table, le chat", "ça"], "cc": ["xyxyx yxy"]}


def stream(texts, order):
    return [c for t in texts for c in [32] * (order - 1) + langid.normal(t).tolist()]


def brute(lang, text, order):
    """Interpolated Kneser-Ney by its recursive definition."""
    own = stream(TEXTS[lang], order)
    alphabet = len({c for t in TEXTS.values() for c in stream(t, order)[order - 1 :]}) + 1
    grams = {n: [tuple(own[i - n + 1 : i + 1]) for i in range(order - 1, len(own))] for n in range(1, order + 1)}
    counts = {n: Counter(grams[n]) if n == order else Counter(g[1:] for g in set(grams[n + 1])) for n in grams}

    def p(gram):
        n = len(gram)
        if not n:
            return 1 / alphabet
        ones, twos = (sum(v == k for v in counts[n].values()) for k in (1, 2))
        cut = min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.05
        after = {g: v for g, v in counts[n].items() if g[:-1] == gram[:-1]}
        if not after:
            return p(gram[1:])
        total = sum(after.values())
        return max(after.get(gram, 0) - cut, 0) / total + cut * len(after) / total * p(gram[1:])

    points = [32] * (order - 1) + langid.normal(text).tolist()
    return -np.mean([math.log(p(tuple(points[i - order + 1 : i + 1]))) for i in range(order - 1, len(points))])


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_models_are_kneser_ney(order):
    model = langid.train(TEXTS, order)
    for h in model.hashes:
        assert (h[1:] > h[:-1]).all()
    for text in ("the chat", "zq le mat", "ñ", "x", "the cat sat on the mat " * 3):
        nats, _ = langid.entropies(model, [text])
        assert nats[0] == pytest.approx([brute(lang, text, order) for lang in model.languages], abs=1e-5)


@pytest.mark.parametrize("order", [2, 5])
def test_probabilities_sum_to_one(order):
    model = langid.train(TEXTS, order)
    alphabet = sorted({c for t in TEXTS.values() for c in stream(t, order)[order - 1 :]}) + [0x4E00]
    context = ([32] * order + langid.normal("the c").tolist()[:-1])[-order + 1 :]
    points = np.array([c for x in alphabet for c in [*context, x]], np.uint32)
    logs = langid._logs(model, langid.gram_hashes(points, order), np.arange(order - 1, len(points), order))
    assert np.exp(logs).sum(axis=0) == pytest.approx(1, abs=1e-5)


def test_long_texts_are_scored_whole(monkeypatch):
    model = langid.train(TEXTS, 3)
    texts = ["the cat sat on the mat le chat " * 50 + "xyx", "the", "la table " * 20]
    whole, n = langid.entropies(model, texts)
    monkeypatch.setattr(langid, "SLAB", 7)
    cut, m = langid.entropies(model, texts)
    assert n.tolist() == m.tolist() and cut == pytest.approx(whole, abs=1e-6)


def test_normal():
    assert langid.normal("  Été--2 ß\n").tobytes() == np.array([32, *map(ord, "été"), 32, ord("ß"), 32], "<u4").tobytes()
    assert langid.normal("123 !").tolist() == [32] and langid.normal("İx").tolist() == [32, ord("İ"), ord("x"), 32]


def test_query_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = queries.QUERIES["op8_language_id"](spark, d).collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(0 <= r.score <= 1 and r.lang_pred in set(docs.values()) | {"und"} for r in got)
    held = [r for r in got if r.held_out]
    assert sum(docs[r.doc_id] == r.lang_pred for r in held) >= 0.98 * len(held)
    assert sum(r.accepted for r in got) >= 0.995 * len(got)


def learned(spark):
    rows = [(i, t * 5, lang, "s") for i, (lang, ts) in enumerate(TEXTS.items()) for t in ts for _ in range(4)]
    rows = [(i, t, lang, s) for i, (_, t, lang, s) in enumerate(rows * 4)]
    return rows, langid.learn(langid.learned_rows(spark.createDataFrame(rows, SCHEMA)))


def test_odd_rows(spark):
    _, model = learned(spark)
    rows = [(1, None, "aa", "s"), (2, "", None, None), (3, "123 !?", "aa", "s"), (4, "the cat", None, None), (4, "the cat", None, None), (None, "le chat", "zz", "s"), (5, "the mat " * 100_000, "bb", "s")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"score": F.lit(1), "lang_pred": F.lit("q"), "TEXT_": F.lit(2)})
    got = {r.doc_id: r for r in langid.predict(spark, df, model).collect()}
    assert {d: r.lang_pred for d, r in got.items()} == {1: "und", 2: "und", 3: "und", 4: "aa", None: "bb", 5: "aa"}
    assert all(got[d].score == 0 and not got[d].accepted for d in (1, 2, 3)) and got[5].accepted
    kept = langid.accepted(spark, df, model)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["4", "4", "5", "None"]


def test_gibberish_is_rejected(spark):
    _, model = learned(spark)
    df = spark.createDataFrame([(1, "qzkvw jjxzq wpqk vvzzk " * 20, None, None), (2, "Привет мир " * 20, None, None)], SCHEMA)
    assert not any(r.accepted for r in langid.predict(spark, df, model).collect())


@pytest.mark.parametrize("unlearned", ["de", "en", "es", "fr"])
def test_unlearned_languages_are_rejected(spark, unlearned):
    """Texts of the learned languages stay, those of a real one that was left out don't."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learn(langid.learned_rows(docs.where(F.col("lang") != unlearned)))
    judged = langid.predict(spark, docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    foreign = [r.accepted for r in judged if r.lang == unlearned]
    own = [r.accepted for r in judged if r.lang != unlearned]
    assert len(foreign) > 50 and sum(foreign) <= 0.05 * len(foreign) and sum(own) >= 0.99 * len(own)


def test_ties_go_to_the_first_by_name(spark):
    texts = ["one and the same text", "another text of both"]
    rows = [(i, t, lang, "s") for i, (lang, t) in enumerate([(lang, t) for lang in ("zz", "mm", "aa") for t in texts] * 4)]
    model = langid.learn(spark.createDataFrame(rows, SCHEMA), rows=10**6)
    assert model.languages == ["aa", "mm", "zz"]
    got = langid.predict(spark, spark.createDataFrame(rows, SCHEMA), langid.train({lang: texts for lang in ("zz", "mm", "aa")})).collect()
    assert {r.lang_pred for r in got} == {"aa"}


def test_hundreds_of_languages(spark, monkeypatch):
    """Each has letters of its own; entries are as many as the languages' own n-grams."""
    monkeypatch.setattr(langid, "ACROSS", 7)
    rng = np.random.default_rng(1)
    own = {f"l{k:03}": "".join(map(chr, 0x4E00 + 20 * k + rng.integers(0, 20, 6))) for k in range(600)}
    rows = [(i, " ".join(rng.permutation(list(a)).tolist()) + a, lang, "s") for i, (lang, a) in enumerate([x for x in own.items() for _ in range(3)])]
    df = spark.createDataFrame(rows, SCHEMA)
    model = langid.learn(df)
    assert model.languages == sorted(own)
    assert sum(map(len, model.lang)) < 600 * 5 * 80
    got = {r.doc_id: r.lang_pred for r in langid.predict(spark, df, model).collect()}
    assert sum(got[i] == lang for i, _, lang, _ in rows) > 0.99 * len(rows)


def test_languages_of_few_or_long_texts_are_learned(spark):
    rows = [(1, "xyxyx yxy", "cc", "s"), (2, "le chat est la " * 20_000, "bb", "s")] + [(3 + i, f"the cat sat on the mat {i}", "aa", "s") for i in range(200)]
    model = langid.learn(spark.createDataFrame(rows, SCHEMA))
    assert model.languages == ["aa", "bb", "cc"]


@pytest.mark.parametrize("rows", [[], [(1, "abc", None, "s")], [(1, None, "aa", "s")], [(1, "123", "aa", "s")]])
def test_nothing_to_learn_from(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    model = langid.learn(df)
    assert [r.lang_pred for r in langid.predict(spark, df, model).collect()] == ["und"] * len(rows)
    assert langid.accepted(spark, df, model).count() == len(rows)  # nothing can be told foreign


def test_predictions_depend_on_text_alone(spark):
    rows, model = learned(spark)
    some = [(i, t, lang, s) for i, t, lang, s in rows[:9]]
    other = [(999 - i, t, None, "other") for i, t, lang, s in some]
    a, b = ([r.lang_pred for r in langid.predict(spark, spark.createDataFrame(x, SCHEMA).coalesce(1), model).collect()] for x in (some, other))
    assert a == b
