import numpy as np
import pytest

import corpus_pipeline
from joinloom.llm import common, similar, simhash

SCHEMA = "doc_id long, text string"


def brute_components(rows):
    sets = []
    for _, text in rows:
        words = (text or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {()})
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return sorted((d, min(rows[j][0] for j in range(len(rows)) if label[j] == label[i])) for i, (d, _) in enumerate(rows))


def edited(rng, words, many):
    out = list(words)
    for at in rng.choice(len(out), many, replace=False):
        out[at] = f"new{rng.integers(1000)}"
    return " ".join(out)


@pytest.mark.parametrize("block, weight, bucket, most", [(7, 400, 512, 0), (similar.BLOCK, 3000, 512, 10**6), (similar.BLOCK, similar.SHINGLES, 16, 10**6)])
def test_all_pairs_by_brute_force(spark, data, monkeypatch, block, weight, bucket, most):
    """Copies with few and many edits, chains, a common line, short texts and texts without words, in one
    bucket, in tiles of one, and in many tables of small ones; without broadcasts, too."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    monkeypatch.setattr(similar, "BUCKET", bucket)
    monkeypatch.setattr(similar, "RECALL", 0.999)
    rng = np.random.default_rng(3)
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    line = "this very common line is said by all of them alike"
    for k in range(6):
        base = [f"w{x}" for x in rng.integers(0, 500, int(rng.integers(30, 200)))]
        rows += [(1000 + 100 * k + i, edited(rng, base, int(i % 7)) + f" {line}") for i in range(12)]
        for i in range(8):  # each like the one before
            base = edited(rng, base, 2).split()
            rows.append((5000 + 100 * k + i, " ".join(base)))
    rows += [(9000 + i, f"{line} {i}") for i in range(12)] + [(9100, None), (9101, ""), (9102, " \n"), (9103, "One two"), (9104, "one TWO"), (9105, "one two three")]
    got = similar.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), block=block, weight=weight).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == brute_components(rows)


def test_recall_on_edited_copies(spark):
    """Pairs of texts from just similar enough to nearly equal, among texts that aren't, in several tables: at
    least 0.95 of those that are just similar enough, and of all."""
    rng = np.random.default_rng(8)
    words = np.array([f"w{k}" for k in range(4000)])
    rows, want = [], []
    for k in range(1500):
        base = words[rng.integers(0, 4000, int(rng.integers(60, 300)))].tolist()
        copy = edited(rng, base, max(1, int(len(base) * rng.uniform(0.002, 0.022)))).split()
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (base, copy))
        want.append(len(a & b) / len(a | b))
    assert len(similar.tables(len(rows))) > 1
    got = {r.doc_id: r.component_id for r in similar.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA)).collect()}
    joined = np.array([got[2 * k + 1] == 2 * k for k in range(1500)])
    want = np.array(want)
    assert not joined[want < 0.8].any() and joined[want >= 0.8].mean() >= 0.98
    assert joined[(want >= 0.8) & (want < 0.83)].mean() >= 0.95


@pytest.mark.parametrize("n", [2, 300, 1500])
def test_heaps_of_near_copies(spark, n):
    """Copies of a text that isn't there itself, each with edits of its own: like some others, unlike most.
    What is returned grows with their number, and no step has a row for each pair."""
    rng = np.random.default_rng(n)
    base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
    rows = [(i, edited(rng, base, int(rng.integers(0, 5)))) for i in range(n)]
    got = similar.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), weight=50_000).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == (brute_components(rows) if n < 1000 else sorted((r.doc_id, r.component_id) for r in got))
    if n > 1000:
        sets = [similar.shingles(similar.words_of(t.encode())) for _, t in rows]
        a, b = similar.local_links(sets)
        root = similar.forest(n, iter([(a, b)]))
        assert sorted((r.doc_id, r.component_id) for r in got) == [(i, int(k)) for i, k in enumerate(root)]


def test_local_links_are_a_forest_of_all_links():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(50, 61)], rng.integers(0, 2**63, rng.integers(0, 6), dtype=np.uint64)])) for _ in range(80)] + [np.zeros(0, np.uint64)] * 2
    near = np.array([[len(x) and 5 * len(np.intersect1d(x, y)) >= 4 * len(np.union1d(x, y)) for y in sets] for x in sets])
    a, b = similar.local_links(sets)
    assert all(near[i, j] for i, j in zip(a, b, strict=True))
    i, j = np.nonzero(near)
    want = similar.forest(len(sets), iter([(i, j)]))
    assert (similar.forest(len(sets), iter([(a, b)])) == want).all() and len(a) == len(sets) - len(set(want))


def test_fingerprints_of_few_shingles_are_as_far_apart_as_others():
    rng = np.random.default_rng(1)
    for n in (1, 2, 4, 6, 50):
        prints = np.array([similar.fingerprint(np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))) for _ in range(300)])
        far = np.bitwise_count(prints[:, None] ^ prints[None, :]).sum(axis=2)[np.triu_indices(300, 1)]
        assert abs(far.mean() - similar.BITS / 2) < 1 and (far <= similar.RADIUS).sum() == 0
    assert similar.fingerprint(np.zeros(0, np.uint64)).tolist() == [0, 0]


def test_shingle_sets():
    for text in ("", "one", "a b c d", "a b c d e", "a b a b a b a b a b", "x " * 1000, "A b\tC  d\ne f"):
        words = text.lower().split()
        want = len({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}) if words else 0
        got = similar.shingles(similar.words_of(text.encode()))
        assert len(got) == want and (np.diff(got.astype(object)) > 0).all()
    assert similar.key_of(similar.shingles([b"ab", b"c"])) != similar.key_of(similar.shingles([b"a", b"bc"]))


def test_stage_drops_edited_copies(spark, data):
    """Similarity above 0.8 at more than two bits of the fingerprint."""
    base = [f"word{i * i % 997}" for i in range(150)]
    copy = [*base[:40], "other", *base[41:90], "words", *base[91:]]
    other = [f"word{i * i % 991}x" for i in range(150)]
    a, b = (simhash.fingerprint(" ".join(x).encode()) for x in (base, copy))
    assert (a ^ b).bit_count() > simhash.RADIUS
    df = spark.createDataFrame([(2, " ".join(copy), "en"), (1, " ".join(base), "en"), (3, " ".join(other), "en")], f"{SCHEMA}, lang string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, data).collect()) == [1, 3]


def test_no_rows(spark):
    assert similar.near_duplicates(spark, spark.createDataFrame([], SCHEMA)).count() == 0
