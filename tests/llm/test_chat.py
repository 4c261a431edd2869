import json
import random

import pytest
from pyspark.sql import functions as F

from joinloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, call_id string, tool string, arguments string, result_of string, after array<string>"
TOOLS = {"f": {"type": "object", "properties": {"x": {"type": "integer", "maximum": 5}}, "required": ["x"]}}


def linked(spark, rows):
    got = chat.linked(spark, spark.createDataFrame(rows, SCHEMA), TOOLS).collect()
    return sorted(got, key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.ready, r.depth, r.turn or 0))


def call(conv, turn, name, after=None, arguments='{"x":1}', tool="f"):
    return (conv, turn, "assistant", None, name, tool, arguments, None, after)


def result(conv, turn, name, text="r"):
    return (conv, turn, "tool", text, None, None, None, name, None)


def test_order_keeps_turns_where_it_can(spark):
    got = linked(spark, [(1, 0, "user", "hi", *[None] * 5), call(1, 1, "a"), result(1, 2, "a"), call(1, 3, "b", ["a"]), result(1, 4, "b")])
    assert [r.turn for r in got] == [0, 1, 2, 3, 4] and all(r.depth == 0 and r.ready == r.turn for r in got)
    assert [r.status for r in got] == ["plain", "linked", "linked", "linked", "linked"]


def test_late_calls_move_what_waits_for_them(spark):
    rows = [result(1, 1, "a"), call(1, 2, "b", ["a"]), result(1, 3, "b"), call(1, 9, "a"), (1, 5, "user", "between", *[None] * 5)]
    got = linked(spark, rows)
    assert [(r.turn, r.call_id or r.result_of) for r in got] == [(5, None), (9, "a"), (1, "a"), (2, "b"), (3, "b")]


def test_long_chains_backwards(spark):
    n = 20  # each call waits for one that is said later
    got = linked(spark, [call(1, i, f"c{i}", [f"c{i + 1}"]) for i in range(n)])
    assert [r.call_id for r in got] == [f"c{i}" for i in reversed(range(n))] and {r.status for r in got} == {"open"}


def test_circles(spark):
    got = linked(spark, [call(1, 0, "p", ["q"]), call(1, 1, "q", ["p"]), call(1, 2, "s", ["s"]), call(2, 0, "p"), result(2, 1, "p"), call(1, 3, "t")])
    assert {(r.conv_id, r.call_id or r.result_of): r.status for r in got} == {(1, "p"): "circular", (1, "q"): "circular", (1, "s"): "circular", (1, "t"): "open", (2, "p"): "linked"}
    assert [r.turn for r in got if r.conv_id == 1] == [0, 1, 2, 3]


def test_orphans_duplicates_and_identifiers_of_other_conversations(spark):
    got = linked(spark, [call(1, 0, "a"), call(1, 1, "a"), call(2, 0, "b", ["nothing"]), result(1, 2, "b"), result(1, 3, "a"), result(1, 4, "a")])
    assert [(r.conv_id, r.turn, r.status) for r in got] == [(1, 0, "linked"), (1, 1, "duplicate"), (1, 2, "orphan"), (1, 3, "linked"), (1, 4, "linked"), (2, 0, "open")]


def test_nulls_repeats_and_nothing(spark):
    got = linked(spark, [(*[None] * 9,), (*[None] * 9,), call(None, None, "a"), result(None, 4, "a", None), call(3, 1, "z", [None], None, None)])
    assert [r.status for r in got] == ["plain", "plain", "linked", "linked", "open"] or sorted(r.status for r in got) == ["linked", "linked", "open", "plain", "plain"]
    assert linked(spark, []) == []


def test_one_conversation_with_most_rows(spark):
    rows = [x for i in range(0, 600, 2) for x in (call(7, i, f"c{i}", [f"c{i - 2}"]), result(7, i + 1, f"c{i}"))]
    got = linked(spark, rows)
    assert [r.turn for r in got] == list(range(600)) and {r.status for r in got} == {"linked"}


@pytest.mark.parametrize(
    "arguments, tool, wrong",
    [
        ('{"x": 1}', "f", []),
        ('{"x": 1.0}', "f", []),
        ('{"x": 1.5}', "f", ["$.x: not integer"]),
        ('{"x": true}', "f", ["$.x: not integer"]),
        ('{"x": 6}', "f", ["$.x: above maximum"]),
        ("{}", "f", ["$.x: missing"]),
        ("[]", "f", ["$: not object"]),
        ("{", "f", ["arguments are no JSON"]),
        ('{"x": NaN}', "f", ["arguments are no JSON"]),
        (None, "f", ["arguments are no JSON"]),
        ("[" * 500_000, "f", ["arguments nest too deep"]),
        ("[" * 1200 + "]" * 1200, "f", ["arguments nest too deep"]),
        ('{"x":' * 1200 + "1" + "}" * 1200, "g", ["arguments nest too deep"]),
        ("[" * 201 + "]" * 201, "g", ["arguments nest too deep"]),
        ("[" * 200 + "1" + "]" * 200, "f", ["$: not object"]),
        ('{"x":' + '{"y":' * 199 + "1" + "}" * 200, "f", ["$.x: not integer"]),
        ('{"x": 1e400}', "f", ["arguments hold a number beyond a double"]),
        ('{"y": -1e400, "x": 1}', "f", ["arguments hold a number beyond a double"]),
        ("[1e400]", "f", ["arguments hold a number beyond a double"]),
        ('{"x": 1' + "0" * 400 + "}", "f", ["arguments hold a number beyond a double"]),
        ("9" * 100_000, "f", ["arguments hold a number beyond a double"]),
        ('{"x": -1' + "0" * 300 + "}", "f", []),
        ('{"x": 1e-400}', "f", []),
        ("{}", "g", ["no such tool"]),
        ("{}", None, ["no such tool"]),
    ],
)
def test_validation(spark, arguments, tool, wrong):
    got = linked(spark, [call(1, 0, "a", None, arguments, tool)])
    assert got[0].faults == wrong
    json.loads(got[0].json)


def brute(rows):
    """(ready, depth, circular) by the definitions: closures of who waits for whom, and longest ways."""
    n = len(rows)
    heads, results = {}, {}
    for i, (kind, name, _, t) in enumerate(rows):
        if kind == "call" and (name not in heads or (rows[heads[name]][3], heads[name]) > (t, i)):
            heads[name] = i
        elif kind == "result":
            results.setdefault(name, []).append(i)
    needs = [set() for _ in rows]
    for i, (kind, name, after, _) in enumerate(rows):
        if kind == "result" and name in heads:
            needs[i] = {heads[name]}
        elif kind == "call" and heads[name] == i:
            needs[i] = {y for x in after for y in [*([heads[x]] if x in heads else []), *results.get(x, [])]}

    def closed(edges):
        reach = [set(x) for x in edges]
        for k in range(n):
            for x in reach:
                if k in x:
                    x |= reach[k]
        return reach

    at = [r[3] for r in rows]
    moved = [any(at[y] >= at[x] for y in own) for x, own in enumerate(closed(needs))]
    ways = closed([{y for y in own if moved[y]} if moved[x] else set() for x, own in enumerate(needs)])
    stuck = [x in ways[x] or any(y in ways[y] for y in ways[x]) for x in range(n)]
    place = [(t, 0) for t in at]
    for _ in range(n):
        for x in range(n):
            if not stuck[x]:
                place[x] = max([place[x], *((place[y][0], place[y][1] + 1) for y in needs[x] if not stuck[y])])
    return [(*p, z) for p, z in zip(place, stuck, strict=True)]


@pytest.mark.parametrize("seed", range(2))
def test_orders_of_any_size_against_brute_force(spark, seed):
    """In one task, and by rounds of joins."""
    rng = random.Random(seed)
    many, out = {}, []
    for conv in range(12):
        names, rows = [f"c{k}" for k in range(rng.choice([2, 4, 9]))], []
        for _ in range(rng.choice([3, 8, 25])):
            kind = rng.choice(["call", "call", "result"])
            rows.append((kind, rng.choice(names), [rng.choice([*names, "none"]) for _ in range(rng.choice([0, 1, 1, 2]))], len(rows) // rng.choice([1, 1, 2])))
        many[conv] = rows
        out += [call(conv, t, name, after) if kind == "call" else result(conv, t, name) for kind, name, after, t in rows]
    df = spark.createDataFrame(out, SCHEMA).coalesce(1)  # rows of one turn come as they are listed
    want = sorted((conv, r[3], r[1], *b[:2], b[2]) for conv, rows in many.items() for r, b in zip(rows, brute(rows), strict=True))
    assert any(x[5] for x in want) and any(x[4] for x in want)
    for local in (10**6, 5, 0):
        got = chat.linked(spark, df, TOOLS, local).collect()
        assert sorted((r.conv_id, r.turn, r.call_id or r.result_of, r.ready, r.depth, r.status == "circular") for r in got) == want


def test_a_long_chain_of_late_calls(spark):
    n = 20_000
    got = linked(spark, [call(1, i, f"c{i}", [f"c{i + 1}"]) for i in range(n)])
    assert [r.turn for r in got] == list(reversed(range(n))) and [r.depth for r in got] == list(range(n))


def test_schema_words():
    s = {"type": ["array", "null"], "minItems": 1, "maxItems": 2, "items": {"type": "string", "minLength": 2, "maxLength": 3, "enum": ["ab", "abc", "x"]}}
    assert chat.faults(None, s) == [] and chat.faults(["ab"], s) == []
    assert chat.faults([], s) == ["$: minItems"] and chat.faults(["ab"] * 3, s) == ["$: maxItems"]
    assert chat.faults(["x", "abcd"], s) == ["$[0]: minLength", "$[1]: not in enum", "$[1]: maxLength"]
    o = {"properties": {"a": {"const": 1}}, "additionalProperties": {"type": "boolean"}}
    assert chat.faults({"a": 1.0, "b": True}, o) == [] and chat.faults({"a": 2, "b": 0}, o) == ["$.a: not the constant", "$.b: not boolean"]
    assert chat.faults(3, {"type": "number", "minimum": 4}) == ["$: below minimum"]


@pytest.mark.parametrize("value, text", [(1.0, "1"), (-0.0, "0"), (1e21, "1e+21"), (1e-7, "1e-7"), (1.5e-5, "0.000015"), (0.1, "0.1"), ({"b": [1, None, True], "a": "é\n\u2028"}, '{"a":"é\\n\u2028","b":[1,null,true]}'), ({"\U0001f600": 1, "\ufb33": 2}, '{"\U0001f600":1,"\ufb33":2}'), ("\ud800", '"\\ud800"')])
def test_canonical(value, text):
    assert chat.canonical(value) == text


def test_clashing_columns(spark):
    df = spark.createDataFrame([call(1, 0, "a"), result(1, 1, "a")], SCHEMA).withColumns({"row": F.lit(1), "ready": F.lit(2), "json": F.lit("x"), "status": F.lit("y")})
    assert sorted(r.status for r in chat.linked(spark, df, TOOLS).collect()) == ["linked", "linked"]
