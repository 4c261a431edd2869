"""Inner equi-joins on one key, by four strategies that give the same rows.

Two questions, four answers: are the sides sorted and merged or hashed, and does the payload travel
with its key or do row ids travel and the payload is fetched afterwards?

               payload travels   payload is fetched
  sort-merge   SMJ               SMJI
  hashed       SHJ               PHJ

Joins are bags: every pair of rows with equal keys comes out. Null keys meet nothing. The result is the
key, the left payload and the right payload, in this order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinloom.storage import written


@dataclass(frozen=True)
class Strategy:
    name: str
    hint: str | None
    fetches: bool


#: AUTO leaves the algorithm to the optimizer, which broadcasts a side whose size it knows to be small.
STRATEGIES = {s.name: s for s in (Strategy("SMJ", "MERGE", False), Strategy("SMJI", "MERGE", True), Strategy("SHJ", "SHUFFLE_HASH", False), Strategy("PHJ", "SHUFFLE_HASH", True), Strategy("AUTO", None, False))}


def strategy_of(name: str, left_payload: int, right_payload: int) -> Strategy:
    """By name, in either case. SMJI with one payload column a side is SMJ: there is nothing to gain
    from fetching a column that is as narrow as a row id."""
    found = STRATEGIES.get(name.upper())
    if not found:
        raise ValueError(f"no strategy {name!r}; there are {', '.join(STRATEGIES)}")
    return STRATEGIES["SMJ"] if found.name == "SMJI" and left_payload == right_payload == 1 else found


def equi_join(left: DataFrame, right: DataFrame, key: str | tuple[str, str], strategy: str = "AUTO", left_payload: list[str] | None = None, right_payload: list[str] | None = None) -> DataFrame:
    """left and right joined on a key: one name, or the left's and the right's (the left's stays). A hint goes
    to the left side, which is built where sides are hashed: a task then holds one partition of it in
    memory, whatever its size, so a left side with keys of very many rows wants a merging strategy,
    which spills. Payload: all other columns, if not given; none is fine. Equal payload names on both
    sides are an error."""
    left_key, right_key = (key, key) if isinstance(key, str) else key
    left_payload = [c for c in left.columns if c != left_key] if left_payload is None else left_payload
    right_payload = [c for c in right.columns if c != right_key] if right_payload is None else right_payload
    names = [left_key, *left_payload, *right_payload]
    if len({n.lower() for n in names}) < len(names):
        raise ValueError(f"column names repeat: {', '.join(names)}")
    how = strategy_of(strategy, len(left_payload), len(right_payload))
    left = left.select(left_key, *left_payload)
    right = right.select(F.col(right_key).alias(left_key), *right_payload)
    if how.fetches:
        return _fetching(left, right, left_key, how)
    return _hinted(left, how).join(right, left_key)


def _hinted(df: DataFrame, how: Strategy) -> DataFrame:
    return df.hint(how.hint) if how.hint else df


def _fetching(left: DataFrame, right: DataFrame, key: str, how: Strategy) -> DataFrame:
    """Keys and row ids meet first; each side's payload is then fetched by row id. The sides with their
    ids are written, as an id must name the same row when it is read again."""
    spark = left.sparkSession
    left, right = (_with_ids(spark, df, rid) for df, rid in ((left, "_lid"), (right, "_rid")))
    met = _hinted(left.select(key, "_lid"), how).join(right.select(key, "_rid"), key)
    for df, rid in ((left, "_lid"), (right, "_rid")):
        if len(df.columns) > 2:
            met = _hinted(df.drop(key), how).join(met, rid)
    return met.select(key, *[c for c in left.columns if c not in (key, "_lid")], *[c for c in right.columns if c not in (key, "_rid")])


def _with_ids(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    return written(spark, df.withColumn(name, F.monotonically_increasing_id()), "rows")[0]


def cardinality(joined: DataFrame) -> DataFrame:
    return joined.agg(F.count("*").alias("n"))


def checksum(joined: DataFrame, key: str) -> DataFrame:
    """The join's rows and the sum of their keys."""
    return joined.agg(F.count("*").alias("n"), F.sum(key).alias("key_sum"))


def match_ratio(joined: DataFrame, n_right: int) -> DataFrame:
    """The share of the right side's rows that the join gives."""
    return joined.agg((F.count("*").cast("double") / n_right).alias("ratio"))


def plan_of(df: DataFrame) -> str:
    """The physical plan, as it is before any of it ran."""
    return df._jdf.queryExecution().executedPlan().toString()
