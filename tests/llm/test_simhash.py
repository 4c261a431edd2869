import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from joinloom.llm import common, simhash
from joinloom.llm.components import star_components

SCHEMA = "doc_id long, text string"


def brute_print(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    ids = list(range(len(rows)))

    def find(i):
        while ids[i] != i:
            i = ids[i]
        return i

    prints = [brute_print(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                ids[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, p, least.get(find(i))) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True))), key=repr)


def found(spark, rows):
    got = simhash.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA)).collect()
    return sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=repr)


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "Two WORDS", "a b c", "a b c d", "x" * 5000, "é Ü ß   nbsp em words", "w " * 40_000, " ".join(map(str, range(50_000)))])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == brute_print(text)


def test_close_pairs_in_groups_of_all_sizes():
    rng = np.random.default_rng(5)
    prints = []
    for b in rng.integers(0, 2**63, 40, dtype=np.uint64):
        for _ in range(rng.integers(1, 100)):
            x = int(b)
            for _ in range(rng.integers(0, 4)):
                x ^= 1 << int(rng.integers(0, 64))
            prints.append(x)
    prints = np.unique(np.array(prints, np.uint64))
    rng.shuffle(prints)
    for groups in (1, 3, 400):
        group = np.sort(rng.integers(0, groups, len(prints)))
        for radius in (1, 2, 3, 5):
            near = (np.bitwise_count(prints[:, None] ^ prints[None, :]) <= radius) & (group[:, None] == group[None, :])
            want = set(zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1))), strict=True))
            for slab in (64, 1 << 14):
                got = [(a, b) for x, y in simhash.close_pairs(prints, group, radius, slab) for a, b in zip(x.tolist(), y.tolist(), strict=True)]
                assert len(got) == len(set(got)) and set(got) == want


def test_close_pairs_of_wide_fingerprints():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, (20, 2), dtype=np.uint64)
    prints = base[rng.integers(0, 20, 300)]
    for _ in range(25):
        at, bit = rng.integers(0, 128, 300), np.uint64(1)
        prints[np.arange(300), at // 64] ^= bit << (at % 64).astype(np.uint64) * (rng.random(300) < 0.8)
    group = np.sort(rng.integers(0, 3, 300))
    for radius in (0, 7, 26, 32, 63):
        far = np.bitwise_count(prints[:, None] ^ prints[None, :]).sum(axis=2)
        want = set(zip(*(x.tolist() for x in np.nonzero(np.triu((far <= radius) & (group[:, None] == group[None, :]), 1))), strict=True))
        got = [(a, b) for x, y in simhash.close_pairs(prints, group, radius, 64) for a, b in zip(x.tolist(), y.tolist(), strict=True)]
        assert len(got) == len(set(got)) and set(got) == want


def test_heaps_are_passed_over():
    """Pairs of different heaps are found, and of one heap none from words of it alone."""
    rng = np.random.default_rng(9)
    prints = rng.integers(0, 4, (700, 2), dtype=np.uint64)
    group = np.sort(rng.integers(0, 2, 700))
    heap = np.concatenate([np.sort(rng.integers(0, 3, np.count_nonzero(group == g))) + 10 * g for g in (0, 1)])
    far = np.bitwise_count(prints[:, None] ^ prints[None, :]).sum(axis=2)
    near = np.triu((far <= 1) & (group[:, None] == group[None, :]), 1)
    want = set(zip(*(x.tolist() for x in np.nonzero(near & (heap[:, None] != heap[None, :]))), strict=True))
    every = set(zip(*(x.tolist() for x in np.nonzero(near)), strict=True))
    got = {(a, b) for x, y in simhash.close_pairs(prints, group, 1, heap=heap) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    assert want <= got < every


def test_no_prints():
    assert not list(simhash.close_pairs(np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    assert not list(simhash.close_pairs(np.zeros((0, 2), np.uint64), np.zeros(0, np.int64)))


def test_table_against_brute_force(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    base = "the quick brown fox jumps over the lazy dog again and again until all words are used up in the end"
    rows += [(10_000 + i, f"{base} {i}") for i in range(30)] + [(20_000, None), (20_001, ""), (20_002, " "), (None, base), (None, "lonely words"), (7, rows[0][1]), (20_003, base), (20_003, base)]
    assert found(spark, rows) == brute_components(rows)


def test_small_blocks_lose_no_link(spark):
    rng = np.random.default_rng(2)
    start = int(rng.integers(0, 2**62))
    prints = {start}
    while len(prints) < 120:  # a chain of steps within the radius, in few buckets
        x = max(prints) if len(prints) % 2 else min(prints)
        prints.add(x ^ (1 << int(rng.integers(0, 16))) ^ (1 << int(rng.integers(0, 16))))
    prints = sorted(prints)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    v = np.array(prints, np.uint64)
    a, b = np.nonzero(np.triu(np.bitwise_count(v[:, None] ^ v[None, :]) <= 2, 1))
    want = simhash.forest(len(v), iter([(a, b)]))
    for block in (8, 50, 4096):
        got = {r.node: r.root for r in star_components(spark, simhash.links(df, block)).collect()}
        assert [got.get(p, p) for p in prints] == [prints[r] for r in want]


def test_components_of_paths_stars_and_circles(spark):
    rng = np.random.default_rng(0)
    names = rng.permutation(2000).tolist()
    path = [(names[i], names[i + 1]) for i in range(300)]
    star = [(names[500], names[500 + i]) for i in range(1, 200)]
    circle = [(names[1000 + i], names[1000 + (i + 1) % 50]) for i in range(50)]
    got = {r.node: r.root for r in star_components(spark, spark.createDataFrame(path + star + circle + [(5000, 5000)], "a long, b long")).collect()}
    want = {}
    for part in (names[:301], names[500:700], names[1000:1050]):
        want |= dict.fromkeys(part, min(part))
    assert got == want


def test_empty_table(spark):
    assert found(spark, []) == []
    assert simhash.one_of_each(spark, spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_one_of_each_keeps_columns_and_one_row_a_group(spark):
    text = "some words that are said here more than once by somebody who likes to say them " * 3
    rows = [(3, text, 1), (1, text, 2), (1, text, 2), (2, "quite another text altogether with other words in it", 3), (None, None, 4), (None, "", 5), (9, None, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long").toDF("doc_id", "text", "n")
    both = df.select("doc_id", "text", "n", F.lit("x").alias("Text_"), F.lit(7).alias("fp"), F.lit(8).alias("root"), F.lit(9).alias("N"))
    got = simhash.one_of_each(spark, both)
    assert got.columns == both.columns
    assert sorted(r[0] for r in got.collect()) == [1, 2, 9]


@pytest.mark.parametrize("most", [10**6, 0])
def test_one_of_each_of_rows_that_are_equal_in_part(spark, monkeypatch, most):
    """Rows of one doc_id and text, of which one stays whatever its other columns; broadcast and not."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    rows = [(1, "a text of some words", "a", {"k": 1}), (1, "a text of some words", "b", {"k": 1}), (1, "a text of some words", "a", {"k": 1}), (None, "x y z", "a", None), (None, "x y z", "a", None), (None, "x y z", "c", {}), (4, "unlike all of the rest", None, None), (4, "of another kind altogether", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, TEXT string, source string, tags map<string, int>")
    got = simhash.one_of_each(spark, df).collect()
    assert sorted((r.doc_id or 0, r.TEXT) for r in got) == [(0, "x y z"), (1, "a text of some words"), (4, "of another kind altogether"), (4, "unlike all of the rest")]
    again = simhash.one_of_each(spark, df.repartition(5)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_texts_are_not_shuffled(spark):
    df = spark.createDataFrame([(1, "a b c", "x"), (2, "a b c", "y"), (3, "q r s t", "z")], "doc_id long, text string, source string")
    plan = simhash.one_of_each(spark, df)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
