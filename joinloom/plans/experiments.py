"""A grid of join configurations, chosen from with SQL, and a runner for what is chosen."""

from __future__ import annotations

import itertools
import json
import time
from collections.abc import Iterable
from dataclasses import asdict, dataclass, fields
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinloom.operators.joins import checksum, equi_join, strategy_of
from joinloom.plans.queries import star_join
from joinloom.profile import append_csv, profiled
from joinloom.sources.workloads import cyclic_keys, missed, primary_keys, uniform_keys, with_payload, zipf_keys

#: What each parameter can be; the grid is their product, but for what makes no sense. Fixed values.
LISTS = {
    "nr": range(20, 29),
    "ratio": range(8),
    "pr": range(1, 7),
    "ps": range(1, 7),
    "dist": ("uniform", "zipf"),
    "unique_keys": range(21, 30),
    "zipf_factor": [0.25 * k for k in range(9)],
    "selectivity": (1, 2, 4, 8, 16),
    "algo": ("smj", "phj", "shj", "smji"),
    "q": (6, 7),
}


def grid(spark: SparkSession) -> DataFrame:
    """Every configuration that makes sense. nr and unique_keys are powers of two, and nr + ratio that of
    the foreign keys' number. Skew is for zipf alone, misses for uniform keys alone; second-level bits
    vary for hashed strategies alone."""

    # What filters look at is read off a row's number, digit by digit; the rest multiplies what is
    # left. There is no join and no shuffle.
    step, columns = 1, {}
    for name in ("nr", "ratio", "dist", "zipf_factor", "selectivity", "algo", "q"):
        values = LISTS[name]
        columns[name] = F.element_at(F.array(*map(F.lit, values)), F.expr(f"cast(id div {step} % {len(values)} + 1 as int)"))
        step *= len(values)
    rows = spark.range(step).select(*[c.alias(n) for n, c in columns.items()])
    rows = rows.where("nr + ratio < 31 and (dist = 'zipf' or zipf_factor = 0) and (dist = 'uniform' or selectivity = 1)").where(f"algo not like 'smj%' or q = {LISTS['q'][0]}")
    for name in ("unique_keys", "pr", "ps"):
        rows = rows.withColumn(name, F.explode(F.array(*map(F.lit, LISTS[name]))))
    longs = {n: F.col(n).cast("long") for n in ("nr", "ratio", "pr", "ps", "unique_keys")}
    return rows.withColumns(longs).select("nr", "ratio", "pr", "ps", "dist", F.lit("pkfk").alias("join_type"), "unique_keys", "zipf_factor", "selectivity", "algo", F.lit(9).alias("p"), "q")


_BITS = "(algo like 'smj%' or p = 9 and (nr < 28 and q = 6 or nr >= 28 and q = 7))"
_PAIR = "pr = ps and unique_keys = nr"
_PLAIN = f"{_PAIR} and dist = 'uniform' and zipf_factor = 0"

#: What each experiment asks of the grid. Fixed values.
CHOICES = {
    "vanilla": f"nr in (25, 26, 27) and ratio in (0, 1, 2) and nr + ratio < 30 and pr in (1, 2) and {_PLAIN} and selectivity = 1",
    "skew": f"nr in (25, 26, 27) and ratio = 0 and pr in (1, 2) and {_PAIR} and dist = 'zipf' and selectivity = 1",
    "matchrate": f"nr in (25, 26, 27) and ratio = 0 and pr = 2 and {_PLAIN} and selectivity in (1, 2, 4, 8, 16)",
    "ratio": f"nr + ratio = 27 and ratio in (0, 1, 2, 3, 4) and pr in (1, 2) and {_PLAIN} and selectivity = 1",
    "morecols": f"nr = 27 and ratio = 0 and 1 <= pr and pr <= 6 and {_PLAIN} and selectivity = 1",
    "8b8b": f"nr in (25, 26, 27) and ratio in (0, 1) and pr = 2 and {_PLAIN} and selectivity = 1",
    "4b8b": f"nr in (25, 26, 27) and ratio in (0, 1) and pr = 2 and {_PLAIN} and selectivity = 1",
}
#: What the runs of an experiment are ordered by; the others by BY. Fixed values.
BY = "algo, nr, ratio, pr, ps"
ORDERS = {"skew": "algo, nr, ratio, pr, ps, zipf_factor", "matchrate": "algo, nr, pr, ps, selectivity"}
#: Key and payload types by experiment; the others have int keys and int payloads.
WIDTHS = {"8b8b": ("bigint", "bigint"), "4b8b": ("int", "bigint")}


def chosen(spark: SparkSession, df: DataFrame, sql: str) -> DataFrame:
    """Any SQL over the grid, which it names {df}, or df."""
    if "{df}" in sql:
        return spark.sql(sql, df=df)
    df.createOrReplaceTempView("df")
    return spark.sql(sql)


def choice(spark: SparkSession, name: str, df: DataFrame | None = None) -> DataFrame:
    """An experiment's configurations, of the whole grid or of one that was saved."""
    df = grid(spark) if df is None else df
    return chosen(spark, df, f"select * from (select distinct * from {{df}} where {CHOICES[name]} and {_BITS}) order by {ORDERS.get(name, BY)}")


def save_grid(df: DataFrame, folder: str) -> None:
    """Configurations as CSV files with a header."""
    df.write.mode("overwrite").csv(folder, header=True)


def saved_grid(spark: SparkSession, folder: str) -> DataFrame:
    """What save_grid() wrote, with the grid's types."""
    return spark.read.csv(folder, header=True, schema=grid(spark).schema)


@dataclass(frozen=True)
class Experiment:
    """query: SQL over the grid. output: what its folder of results is called. key and payload: types."""

    name: str
    query: str
    output: str = ""
    key: str = "int"
    payload: str = "int"


def experiments(spark: SparkSession, path: str) -> list[Experiment]:
    """Those that a file lists: JSON, or YAML where its parser is installed, with a list `experiments` of
    name, query and, if need be, output, key and payload. Other entries are passed over."""
    text = spark.read.text(path, wholetext=True).first()["value"]
    if path.endswith((".yaml", ".yml")):
        import yaml

        listed = yaml.safe_load(text)
    else:
        listed = json.loads(text)
    known = {f.name for f in fields(Experiment)}
    return [Experiment(**{k: v for k, v in e.items() if k in known}) for e in listed["experiments"]]


@dataclass(frozen=True)
class Config:
    nr: int
    ratio: int
    pr: int
    ps: int
    dist: str = "uniform"
    join_type: str = "pkfk"
    unique_keys: int = 0
    zipf_factor: float = 0.0
    selectivity: int = 1
    algo: str = "smj"
    p: int = 9
    q: int = 6


def workload(spark: SparkSession, c: Config, widths: tuple[str, str] = ("int", "int"), smaller: int = 0) -> tuple[DataFrame, DataFrame]:
    """Both sides of a configuration; smaller: powers of two to take off all sizes."""
    n_r, n_s, unique = 2 ** (c.nr - smaller), 2 ** (c.nr + c.ratio - smaller), 2 ** max(0, c.unique_keys - smaller)
    key, payload = widths
    if c.join_type == "fkfk":
        r, s = cyclic_keys(spark, n_r, unique, key), cyclic_keys(spark, n_s, unique, key)
    else:
        r = primary_keys(spark, n_r, key)
        s = uniform_keys(spark, n_s, n_r, key)
        if c.dist == "zipf":
            ranks = zipf_keys(spark, n_s, n_r, c.zipf_factor, "long")
            s = ranks.withColumn("k", (F.col("k") - 1).cast(key))  # ranks are positions of primary keys
    if c.selectivity > 1:
        r = missed(r, c.selectivity)
    return with_payload(r, [f"r{i + 1}" for i in range(c.pr)], payload), with_payload(s, [f"s{i + 1}" for i in range(c.ps)], payload)


def run(spark: SparkSession, configs: Iterable[Config], sink: str | None = None, widths: tuple[str, str] = ("int", "int"), smaller: int = 0, repeats: int = 5) -> list[dict]:
    """Runs each configuration `repeats` times, one of the rounds of all after the other; a row for each
    run, with seconds, rows and key sum, or the error, which doesn't stop the rest. sink: a folder to
    which the rows are appended as CSV."""
    rows = []
    for turn, c in itertools.product(range(repeats), list(configs)):
        row = {"utc": datetime.now(timezone.utc).isoformat(), **asdict(c), "turn": turn, "strategy": "", "seconds": None, "rows": None, "key_sum": None, "error": ""}
        try:
            row["strategy"] = strategy_of(c.algo, c.pr, c.ps).name
            began = time.perf_counter()
            got = checksum(equi_join(*workload(spark, c, widths, smaller), "k", c.algo), "k").first()
            row |= {"seconds": time.perf_counter() - began, "rows": got["n"], "key_sum": got["key_sum"]}
        except Exception as e:
            row["error"] = f"{type(e).__name__}: {e}"[:500]
        rows.append(row)
    if sink:
        append_csv(spark, rows, sink)
    return rows


def configs(df: DataFrame) -> list[Config]:
    """All configurations of a choice, in its order; they come to the driver a partition at a time."""
    return [Config(**r.asDict()) for r in df.toLocalIterator()]


def star_steps(fact: DataFrame, dim: DataFrame, strategy: str = "AUTO", sink: str | None = None) -> list[dict]:
    """A row for each prefix of a star join's joins, with jid, the last join's number, and the seconds
    that the joins up to it take together."""
    keys = [c for c in fact.columns if c != "tid"]
    return [profiled(star_join(fact.select("tid", *keys[: j + 1]), dim, strategy), sink, jid=j, strategy=strategy) for j in range(len(keys))]
