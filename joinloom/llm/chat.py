"""Chat formatting: tool calls linked to results, ordered, validated and written as canonical JSON."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinloom.llm.common import dropped, pick, sized, written

#: Levels of arrays and objects that arguments may have.
MOST_DEPTH = 200
#: Rows of a conversation's calls and results that are ordered in one task; longer conversations are
#: ordered by rounds of joins.
LOCAL_ROWS = 200_000
TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value: object) -> str:
    """JSON with keys by UTF-16 code units, no spaces, and numbers in their shortest form."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{_text(k)}:{canonical(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, float):
        return _number(value)
    return _text(value) if isinstance(value, str) else json.dumps(value)


def _text(s: str) -> str:
    # A lone surrogate, which JSON can escape, has no UTF-8 of its own.
    return json.dumps(s, ensure_ascii=any(0xD800 <= ord(c) < 0xE000 for c in s))


def _number(x: float) -> str:
    if not math.isfinite(x):
        raise ValueError("JSON has no such number")
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    digits, _, power = repr(x).partition("e")
    if not power:
        return digits
    if -7 < int(power) < 0:
        return f"{x:.{len(digits.replace('.', '').lstrip('-')) - 1 - int(power)}f}"
    return f"{digits.removesuffix('.0')}e{int(power):+d}"


def faults(value: object, schema: dict, at: str = "$") -> list[str]:
    """What of a JSON schema the value breaks: type, enum, const, required, properties,
    additionalProperties, items, minimum, maximum, minLength, maxLength, minItems, maxItems."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and not any(canonical(value) == canonical(x) for x in schema["enum"]):
        out.append(f"{at}: not in enum")
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        out.append(f"{at}: not the constant")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{at}: below minimum"] * (value < schema.get("minimum", value)) + [f"{at}: above maximum"] * (value > schema.get("maximum", value))
    for kind, least, most in ((str, "minLength", "maxLength"), (list, "minItems", "maxItems")):
        if isinstance(value, kind):
            out += [f"{at}: {least}"] * (len(value) < schema.get(least, 0)) + [f"{at}: {most}"] * (len(value) > schema.get(most, len(value)))
    if isinstance(value, list) and "items" in schema:
        out += [f for k, x in enumerate(value) for f in faults(x, schema["items"], f"{at}[{k}]")]
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        extra = schema.get("additionalProperties", True)
        for k in sorted(value):
            if k in known:
                out += faults(value[k], known[k], f"{at}.{k}")
            elif extra is False:
                out.append(f"{at}.{k}: not allowed")
            elif isinstance(extra, dict):
                out += faults(value[k], extra, f"{at}.{k}")
    return out


def _is(value: object, kind: str) -> bool:
    if kind in ("number", "integer"):
        return isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or value == int(value))
    return isinstance(value, TYPES[kind])


class Unfit(ValueError):
    """What JSON can say and canonical JSON can't."""


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def _finite(digits: str) -> float:
    if math.isinf(x := float(digits)):
        raise Unfit("arguments hold a number beyond a double")
    return x


def _whole(digits: str) -> int:
    _finite(digits)  # more digits than a double has may be an error to int()
    return int(digits)


def _deep(value: object) -> bool:
    level = [value] if isinstance(value, (dict, list)) else []
    for _ in range(MOST_DEPTH):
        level = [y for x in level for y in (x.values() if isinstance(x, dict) else x) if isinstance(y, (dict, list))]
    return bool(level)


def parsed(arguments: str | None) -> object:
    """The JSON value; raises ValueError, with what is wrong."""
    try:
        value = json.loads(arguments or "", parse_constant=_refuse, parse_float=_finite, parse_int=_whole)
    except Unfit:
        raise
    except RecursionError:
        raise Unfit("arguments nest too deep") from None
    except ValueError:
        raise ValueError("arguments are no JSON") from None
    if _deep(value):
        raise Unfit("arguments nest too deep")
    return value


def _render(tools: dict[str, dict]):
    """Adds faults and json to rows, and takes text and arguments away."""

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said, lines = [], []
            for r in batch.select(["role", "text", "call_id", "tool", "arguments", "result_of"]).to_pylist():
                wrong: list[str] = []
                if r["call_id"] is not None:
                    try:
                        given = parsed(r["arguments"])
                        wrong = faults(given, tools[r["tool"]]) if r["tool"] in tools else ["no such tool"]
                    except ValueError as e:
                        given, wrong = r["arguments"], [str(e)]
                    line = {"arguments": given, "id": r["call_id"], "name": r["tool"], "role": r["role"], "type": "tool_call"}
                elif r["result_of"] is not None:
                    line = {"call_id": r["result_of"], "content": r["text"], "role": r["role"], "type": "tool_result"}
                else:
                    line = {"content": r["text"], "role": r["role"], "type": "message"}
                said.append(wrong)
                lines.append(canonical(line))
            kept = [n for n in batch.schema.names if n not in ("text", "arguments")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(said, pa.list_(pa.string())), pa.array(lines, pa.string())], names=[*kept, "faults", "json"])

    return render


CONV = ["no_conv", "conv"]
IDS = [*CONV, "id"]
NODE = ["row", *IDS, "calls", "answers", "after", "at"]


def linked(spark: SparkSession, messages: DataFrame, tools: dict[str, dict], local_rows: int = LOCAL_ROWS) -> DataFrame:
    """messages(conv_id long, turn long, role, text, call_id, tool, arguments, result_of, after): a
    message with a call_id calls a tool with JSON arguments, one with a result_of alone is the result
    of the call of that identifier in its conversation; after, an array, names calls whose results a
    call needs.

    Returns a row for each: conv_id, turn, role, call_id, result_of, kind (call, result, message),
    status, faults, json, ready long, depth long. status: linked or open for calls, with and without a
    result; duplicate for all calls of an identifier but the first by turn; linked or orphan for
    results; plain for messages; circular, see below. faults: what the arguments break of the tool's
    schema, or that they are no JSON, hold a number beyond a double, or nest more than MOST_DEPTH
    levels; such arguments stand as a string. json: canonical.

    (ready, depth, turn) is a topological order of the conversation that keeps to turns where it can:
    ready is the latest turn among a row and all that it waits for, depth the steps that it waits
    there. A result waits for its call, a call for the calls and results of the identifiers it comes
    after; identifiers that nothing has are not waited for, and duplicates neither wait nor are waited
    for. Rows that something of their turn or a later one is waited for by, at any number of steps,
    have to move. Of these, the rows on a circle and those that wait for such rows keep their turn,
    have status circular, and are not waited for.

    Calls, results and what they wait for are joined by identifier, and that is all where nothing is
    late. The calls and results of a conversation in which something is late are ordered in a task, up
    to local_rows of them, and else by rounds of joins, as many as the longest chain of moved rows is.
    So a conversation may hold most of all rows. Null conv_ids are one conversation; a null turn counts
    as 0 in the order; null texts are null in the JSON; texts may have any length; repeated rows
    are a row each. No rows: no rows. Other columns are ignored."""
    names = ["conv_id", "turn", "role", "text", "call_id", "tool", "arguments", "result_of", "after"]
    rows = pick(messages, *names).withColumn("row", F.monotonically_increasing_id()).withColumn("at", F.coalesce(F.col("turn").cast("long"), F.lit(0)))
    kept = rows.withColumn("faults", F.array().cast("array<string>")).withColumn("json", F.lit(None).cast("string")).drop("text", "arguments")
    rows, _ = written(spark, rows.mapInArrow(_render(tools), kept.schema), "messages")

    named = F.coalesce("call_id", "result_of")
    nodes = rows.where(named.isNotNull()).select("row", F.col("conv_id").isNull().alias("no_conv"), F.coalesce("conv_id", F.lit(0)).alias("conv"), named.alias("id"), F.col("call_id").isNotNull().alias("calls"), "after", "at")
    answers = ~F.col("calls")
    known = nodes.groupBy(*IDS).agg(F.min(F.when(F.col("calls"), F.struct("at", "row"))).alias("head"), F.count(F.when(answers, 1)).alias("results"), F.max(F.when(answers, F.col("at"))).alias("last"))
    first = F.coalesce(F.col("head.row") == F.col("row"), F.lit(False))
    told = nodes.join(known, IDS).select("row", *IDS, "head", "results", F.col("calls").alias("is_call"), (F.col("calls") & first).alias("calls"), (answers & F.col("head").isNotNull()).alias("linked"), answers.alias("answers"), F.array_distinct("after").alias("after"), "at")
    told, _ = written(spark, told, "linked")

    late = told.where(F.col("linked") & (F.col("head.at") >= F.col("at"))).select(*CONV)
    waiting = told.where("calls").select(*CONV, "at", F.explode("after").alias("id")).join(known.select(*IDS, F.greatest("head.at", "last").alias("done")), IDS)
    late, _ = written(spark, late.unionByName(waiting.where("done >= at").select(*CONV)).distinct(), "late")
    moved = ordered(spark, told.select(*NODE).join(sized(late, late.count()), CONV, "left_semi"), local_rows) if late.limit(1).count() else None

    links = told.select("row", "is_call", "calls", "linked", "results")
    if moved is None:
        links = links.withColumns({"ready": F.lit(None).cast("long"), "depth": F.lit(None).cast("long"), "stuck": F.lit(False)})
    else:
        links = links.join(moved, "row", "left")
    call = F.when(~F.col("calls"), "duplicate").when(F.col("results") > 0, "linked").otherwise("open")
    result = F.when(F.col("linked"), "linked").otherwise("orphan")
    links = links.select("row", F.when(F.col("is_call"), "call").otherwise("result").alias("kind"), F.when(F.col("stuck"), "circular").when(F.col("is_call"), call).otherwise(result).alias("status"), "ready", "depth")
    found = rows.where(named.isNotNull()).join(links, "row")
    plain = rows.where(named.isNull()).withColumns({"kind": F.lit("message"), "status": F.lit("plain"), "ready": F.col("at"), "depth": F.lit(0).cast("long")})
    out = ["conv_id", "turn", "role", "call_id", "result_of", "kind", "status", "faults", "json", F.coalesce("ready", "at").alias("ready"), F.coalesce("depth", F.lit(0).cast("long")).alias("depth")]
    return found.select(*out).unionByName(plain.select(*out))


def ordered(spark: SparkSession, nodes: DataFrame, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """(row, ready, depth, stuck) of the nodes of conversations with something late, written."""
    nodes, _ = written(spark, nodes, "nodes")
    sizes = nodes.groupBy(*CONV).agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > local_rows).select(*CONV)
    large, _ = written(spark, large, "large")
    some = large.count()
    small = nodes.join(sized(large, some), CONV, "left_anti") if some else nodes
    out = small.groupBy(*CONV).applyInArrow(_solver, "row long, ready long, depth long, stuck boolean")
    if some:
        out = out.unionByName(by_rounds(spark, nodes.join(sized(large, some), CONV, "left_semi")))
    return written(spark, out, "order")[0]


def _solver(group: pa.Table) -> pa.Table:
    row, ids, calls, answers, after, at = (group.column(n).to_pylist() for n in ("row", "id", "calls", "answers", "after", "at"))
    ready, depth, stuck = places(ids, calls, answers, after, at)
    return pa.table({"row": row, "ready": pa.array(ready, pa.int64()), "depth": pa.array(depth, pa.int64()), "stuck": pa.array(stuck, pa.bool_())})


def places(ids: list[str], calls: list[bool], answers: list[bool], after: list[list[str] | None], at: list[int]) -> tuple[list[int], list[int], list[bool]]:
    """ready, depth and stuck of one conversation's rows, in time and memory that are in proportion to
    them: between a call and all that it comes after stands a node for each identifier."""
    n = len(ids)
    number = {x: n + k for k, x in enumerate(dict.fromkeys(ids))}
    heads = {ids[i]: i for i in range(n) if calls[i]}
    needs: list[list[int]] = [[] for _ in range(n + len(number))]
    for i in range(n):
        if calls[i]:
            needs[i] = [number[x] for x in after[i] or [] if x in number]
        elif answers[i] and ids[i] in heads:
            needs[i] = [heads[ids[i]]]
        if calls[i] or answers[i]:
            needs[number[ids[i]]].append(i)
    needed: list[list[int]] = [[] for _ in needs]
    for x, own in enumerate(needs):
        for y in own:
            needed[y].append(x)

    # What is waited for at any number of steps, the latest first: who is met first by it waits longest.
    reach: list[int | None] = [None] * len(needs)
    for y in sorted(range(n), key=lambda i: -at[i]):
        todo = [] if reach[y] is not None and reach[y] >= at[y] else [y]
        while todo:
            for x in needed[todo.pop()]:
                if reach[x] is None:
                    reach[x] = at[y]
                    todo.append(x)
    moved = [i < n and reach[i] is not None and reach[i] >= at[i] or i >= n for i in range(len(needs))]

    left = [sum(moved[y] for y in own) if moved[x] else 0 for x, own in enumerate(needs)]
    free = [x for x in range(len(needs)) if moved[x] and not left[x]]
    for x in free:
        for z in needed[x]:
            if moved[z]:
                left[z] -= 1
                if not left[z]:
                    free.append(z)
    stuck = [moved[x] and left[x] > 0 for x in range(n)]

    # Those who are free wait, among the moved, for the free alone, and these come first.
    place: list[tuple[int, int]] = [(t, 0) for t in at] + [(-(2**63), 0)] * len(number)
    for x in free:
        for y in needs[x]:
            place[x] = max(place[x], place[y] if x >= n else (place[y][0], place[y][1] + 1))
    return [place[i][0] if not stuck[i] else at[i] for i in range(n)], [place[i][1] if not stuck[i] else 0 for i in range(n)], stuck


def _steps(nodes: DataFrame) -> DataFrame:
    """(row, at, whole, no_conv, conv, id): a result waits for the head of its identifier, a call for the
    whole of each identifier it comes after."""
    answers = nodes.where("answers").select("row", "at", F.lit(False).alias("whole"), *IDS)
    return answers.unionByName(nodes.where("calls").select("row", "at", F.lit(True).alias("whole"), *CONV, F.explode("after").alias("id")))


def _given(steps: DataFrame, nodes: DataFrame, value: str) -> DataFrame:
    """(row, at, value): the greatest that rows get from the nodes that they wait for."""
    by_id = nodes.where("calls or answers").groupBy(*IDS).agg(F.max(F.when(F.col("calls"), F.col(value))).alias("head"), F.max(value).alias("whole_id"))
    got = steps.join(by_id, IDS).select("row", "at", F.when(F.col("whole"), F.col("whole_id")).otherwise(F.col("head")).alias(value))
    return got.where(F.col(value).isNotNull()).groupBy("row", "at").agg(F.max(value).alias(value))


def _spread(spark: SparkSession, nodes: DataFrame, steps: DataFrame, start: DataFrame, value: str, step, above) -> DataFrame | None:
    """(row, at, value) of the rows that what they wait for gives more than they have, after as many
    rounds as it takes; each round goes on from what changed in the last. start: nodes with a value."""
    found, now, old = None, start, []
    while True:
        got = _given(steps, now, value).withColumn(value, step(F.col(value))).where(above)
        if found is not None:
            had = found.select("row", F.col(value).alias("had"))
            got = got.join(had, "row", "left").where(F.col("had").isNull() | (F.col(value) > F.col("had"))).drop("had")
        changed, path = written(spark, got, "changed")
        if not changed.limit(1).count():
            return found
        if found is not None:
            changed_or_not = found.join(changed.select("row"), "row", "left_anti").unionByName(changed)
            found, new = written(spark, changed_or_not, "found")
            for p in old:
                dropped(spark, p)
            old = [path, new]
        else:
            found, old = changed, [path]
        now = nodes.join(changed.select("row", value), "row")


def by_rounds(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """What places() finds, for conversations of any size."""
    steps, _ = written(spark, _steps(nodes), "steps")
    reach = _spread(spark, nodes, steps, nodes.withColumn("top", F.col("at")), "top", lambda x: x, F.col("top") >= F.col("at"))
    none = {"ready": F.col("at"), "depth": F.lit(0).cast("long"), "stuck": F.lit(False)}
    if reach is None:
        return nodes.withColumns(none).select("row", "ready", "depth", "stuck")
    moved, _ = written(spark, nodes.join(reach.select("row"), "row", "left_semi"), "moved")
    stuck = _circular(spark, moved).withColumn("stuck", F.lit(True))
    free = nodes.join(stuck, "row", "left_anti")
    steps, _ = written(spark, steps.join(moved.select("row"), "row", "left_semi").join(stuck, "row", "left_anti"), "steps")
    place = F.struct(F.col("at").alias("ready"), F.lit(0).cast("long").alias("depth"))
    found = _spread(spark, free, steps, free.withColumn("place", place), "place", lambda x: F.struct(x["ready"].alias("ready"), (x["depth"] + 1).alias("depth")), F.col("place") > place)
    out = nodes.select("row", "at").join(stuck, "row", "left")
    if found is None:
        out = out.withColumn("place", F.lit(None).cast("struct<ready: long, depth: long>"))
    else:
        out = out.join(found.select("row", "place"), "row", "left")
    return out.select("row", F.coalesce("place.ready", "at").alias("ready"), F.coalesce("place.depth", F.lit(0).cast("long")).alias("depth"), F.coalesce("stuck", F.lit(False)).alias("stuck"))


def _waiting(rows: DataFrame, among: DataFrame) -> DataFrame:
    """(row) of those rows that wait for one of the rows among."""
    heads = among.where("calls").select(*IDS).distinct()
    done = among.where("calls or answers").select(*IDS).distinct()
    steps = _steps(rows)
    return steps.where("not whole").join(heads, IDS, "left_semi").unionByName(steps.where("whole").join(done, IDS, "left_semi")).select("row").distinct()


def _circular(spark: SparkSession, moved: DataFrame) -> DataFrame:
    """(row) of the moved rows that are on a circle or behind one: what is left when rows that need none of
    the rest are taken away, again and again."""
    rest, path = written(spark, moved, "circle")
    n = rest.count()
    while True:
        less, new = written(spark, rest.join(_waiting(rest, rest), "row", "left_semi"), "circle")
        dropped(spark, path)
        rest, path, before, n = less, new, n, less.count()
        if n == before:
            return rest.select("row")
