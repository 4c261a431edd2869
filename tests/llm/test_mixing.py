import hashlib
import heapq
import random
from fractions import Fraction

import pytest

from joinloom.llm import mixing

SCHEMA = "doc_id long, text string, source string"
WEIGHTS, PIECE = (3, 1, 2), mixing.PIECE


def size(text):
    return len((text or "").encode().split())  # on bytes: ASCII white space alone


def places(rows):
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    return {s: i for i, s in enumerate(names)}


def brute_targets(sizes, weights=WEIGHTS, share=Fraction(3, 2)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * sizes[s] <= level * weight[s]}
        if not full:
            break
        for s in full:
            target[s] = Fraction(2 * sizes[s])
            left -= target[s]
        open_ -= full
    return {s: target.get(s, level * weight[s] if s in open_ else None) for s in names}


def brute_queue(rows, weights=WEIGHTS, share=Fraction(3, 2), epochs=2, piece=PIECE):
    """One queue a source, served a piece at a time by a heap of exact virtual finish times."""
    place, waiting = places(rows), {}
    for n, (d, t, s) in enumerate(rows):
        dealt = int(hashlib.md5(f"{mixing.SEED}/{'' if d is None else d}/{t or ''}".encode()).hexdigest()[:15], 16)
        waiting.setdefault(s, []).append((dealt, d is not None, d or 0, size(t), n))
    heap, queues = [], {}
    for s, own in waiting.items():
        pieces = [(n, at, min(piece, z - at)) for e in range(epochs) for _, _, _, z, n in sorted(own) for at in range(0, z, piece)]
        queues[s] = iter(pieces)

    def push(s, served):
        if found := next(queues[s], None):
            heapq.heappush(heap, (Fraction(served + found[2], weights[place[s] % len(weights)]), place[s], served + found[2], found, s))

    for s in queues:
        push(s, 0)
    budget, taken, sequence = int(share * sum(size(t) for _, t, _ in rows)), [0] * len(rows), []
    while heap and budget > 0:
        finish, _, served, (n, at, words), s = heapq.heappop(heap)
        words = min(words, budget)
        budget -= words
        taken[n] += words
        sequence.append((finish, n, at, words))
        push(s, served)
    return taken, sequence


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mixed(spark, df).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want, (taken, _) = brute_targets(sizes), brute_queue(rows)
    assert sorted(((r.doc_id, r.source, r.size, r.taken) for r in got), key=repr) == sorted(((d, s, size(t), k) for (d, t, s), k in zip(rows, taken, strict=True)), key=repr)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(float(want[s])) for r in mine)
        assert all(0 <= r.taken <= 2 * r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - float(want[s])) <= PIECE
    assert sum(r.taken for r in got) == 3 * sum(sizes.values()) // 2
    again = mixing.mixed(spark, df.repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    return got


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.choice([0, 1, 3, 40, 400, 700]))), rng.choice(["a", "b", "b", "b", "Z", "é", None, ""])) for i in range(300)]
    check(spark, rows)


def test_one_source_with_most_rows(spark):
    """The small sources are used up, with ties in finish time; the hot one goes on."""
    got = check(spark, [(i, "x y z " * (i % 7), "hot" if i % 3 else f"s{i % 20:02}") for i in range(400)])
    assert any(r.taken == 2 * r.size for r in got if r.source != "hot") and any(0 < r.taken < 2 * r.size for r in got)


def test_the_queue_decides(spark):
    """Neither a prefix of each source's target nor whole documents by target: pieces by finish time."""
    rows = [(i, "w " * (100 + 37 * i % 900), f"s{i % 4}") for i in range(60)]
    taken, _ = brute_queue(rows)
    sizes = {s: sum(size(t) for _, t, x in rows if x == s) for s in {r[2] for r in rows}}
    floors = {s: int(t) for s, t in brute_targets(sizes).items()}
    assert any(sum(k for k, r in zip(taken, rows, strict=True) if r[2] == s) != floors[s] for s in sizes)
    check(spark, rows)


def test_edges(spark):
    check(spark, [(1, None, "a"), (2, "", "a"), (3, "w " * 70_000, "b"), (3, "one", "b"), (None, "two words", None), (None, "two words", None), (4, "\x0b\x0c a b \x1f", "c")])
    check(spark, [(1, None, None)])
    check(spark, [(1, "a b c", "only")])
    assert mixing.mixed(spark, spark.createDataFrame([], SCHEMA)).collect() == []


def test_other_parameters(spark):
    rows = [(i, "w " * (i % 23), f"s{i % 3}") for i in range(150)]
    for weights, share, epochs, piece in (((5, 7), Fraction(1, 3), 1, 4), ((1, 1, 4), Fraction(5, 2), 3, 1000)):
        got = mixing.mixed(spark, spark.createDataFrame(rows, SCHEMA), weights=weights, share=share, epochs=epochs, piece=piece).collect()
        want, _ = brute_queue(rows, weights, share, epochs, piece)
        assert sorted((r.doc_id, r.taken) for r in got) == [(i, k) for i, k in enumerate(want)]


def test_too_many_words(spark):
    rows = [(1, "a b", "s"), (2, "a", "t")]
    with pytest.raises(ValueError, match="beyond a long"):
        mixing.mixed(spark, spark.createDataFrame(rows, SCHEMA), weights=(2**61 - 1, 2**61))


def test_sequence_is_the_mix_in_order(spark):
    rows = [(i, "w " * (i % 9 + 1) * (200 if i % 50 == 3 else 1), f"s{i % 4}") for i in range(200)]
    _, sequence = mixing.mix(spark, spark.createDataFrame(rows, SCHEMA))
    got = sorted(sequence.collect(), key=lambda r: r.position)
    at = 0
    for r in got:
        assert r.position == at and r.words > 0
        at += r.words
    assert at == 3 * sum(size(t) for _, t, _ in rows) // 2
    _, want = brute_queue(rows)
    assert [(r.finish, r.start, r.words) for r in got] == [(finish * 6, start, words) for finish, _, start, words in want]


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", "s", 5, 6), (2, "c", "t", 5, 6)], "doc_id long, text string, source string, size long, target long")
    got = mixing.mixed(spark, df.toDF("doc_id", "text", "source", "size", "TEXT"))
    assert sorted((r.doc_id, r.size) for r in got.collect()) == [(1, 2), (2, 1)]
