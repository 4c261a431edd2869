"""python -m joinloom plan q7 --data DIR --strategy SMJ; also: join, star, grid, query. See --help."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from joinloom.operators.joins import STRATEGIES
from joinloom.plans import experiments
from joinloom.plans import queries as plans
from joinloom.profile import profiled
from joinloom.session import session

PLANS = {"q7": plans.q7, "q18": plans.q18, "q19": plans.q19, "q64": plans.q64, "q95": plans.q95}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("joinloom", description="Joins, timed.")
    out.add_argument("--master", help="such as local[8]; a launcher's own unless given")
    out.add_argument("--sink", help="a folder that a CSV row is appended to for each run")
    what = out.add_subparsers(dest="what", required=True)

    def strategy(p: argparse.ArgumentParser) -> None:
        p.add_argument("--strategy", default="AUTO", type=str.upper, choices=list(STRATEGIES))

    plan = what.add_parser("plan", help="a TPC-style join plan")
    plan.add_argument("name", choices=list(PLANS))
    plan.add_argument("--data", required=True, help="folder of the tables")
    strategy(plan)

    star = what.add_parser("star", help="a fact table joined eight times with a dimension")
    star.add_argument("--fact", type=int, default=1 << 20)
    star.add_argument("--dim", type=int, default=1 << 16)
    strategy(star)

    join = what.add_parser("join", help="one join of generated sides; sizes are powers of two")
    for name, default in (("nr", 20), ("ratio", 0), ("pr", 1), ("ps", 1), ("unique-keys", 20), ("selectivity", 1)):
        join.add_argument(f"--{name}", type=int, default=default)
    join.add_argument("--dist", choices=experiments.LISTS["dist"], default="uniform")
    join.add_argument("--zipf-factor", type=float, default=0.0)
    join.add_argument("--join-type", choices=("pkfk", "fkfk"), default="pkfk")
    join.add_argument("--algo", default="smj")
    join.add_argument("--key", choices=("int", "bigint"), default="int")
    join.add_argument("--payload", choices=("int", "bigint"), default="int")
    join.add_argument("--repeats", type=int, default=5)

    grid = what.add_parser("grid", help="an experiment: all its configurations, in rounds")
    grid.add_argument("names", nargs="*", help=f"of {', '.join(experiments.CHOICES)}, or of the file's")
    grid.add_argument("--experiments", help="a JSON or YAML file of experiments")
    grid.add_argument("--save", help="a folder to save the whole grid in, as CSV")
    grid.add_argument("--configs", help="a folder with a saved grid to choose from")
    grid.add_argument("--smaller", type=int, default=0, help="powers of two to take off all sizes")
    grid.add_argument("--repeats", type=int, default=5)

    query = what.add_parser("query", help="a registered query, shown")
    query.add_argument("name")
    query.add_argument("--data", required=True)
    query.add_argument("--rows", type=int, default=20)
    return out


def grid(spark: SparkSession, a: argparse.Namespace) -> list[dict]:
    if a.save:
        experiments.save_grid(experiments.grid(spark), a.save)
    df = experiments.saved_grid(spark, a.configs) if a.configs else experiments.grid(spark)
    listed = {e.name: e for e in experiments.experiments(spark, a.experiments)} if a.experiments else {}
    known, rows = listed or experiments.CHOICES, []
    for name in a.names:
        if name not in known:
            raise SystemExit(f"no experiment {name!r}; there are {', '.join(known)}")
        e = listed.get(name)
        found = experiments.chosen(spark, df, e.query) if e else experiments.choice(spark, name, df)
        widths = (e.key, e.payload) if e else experiments.WIDTHS.get(name, ("int", "int"))
        sink = a.sink and (f"{a.sink.rstrip('/')}/{e.output}" if e and e.output else a.sink)
        rows += experiments.run(spark, experiments.configs(found), sink, widths, a.smaller, a.repeats)
    return rows


def main(arguments: list[str] | None = None) -> list[dict]:
    a = parser().parse_args(arguments)
    spark = session(master=a.master)
    if a.what == "plan":
        rows = [profiled(PLANS[a.name](spark, a.data, a.strategy), a.sink, plan=a.name, strategy=a.strategy)]
    elif a.what == "star":
        rows = [profiled(plans.star_join_8(spark, a.fact, a.dim, a.strategy), a.sink, fact=a.fact, dim=a.dim, strategy=a.strategy)]
    elif a.what == "join":
        config = experiments.Config(a.nr, a.ratio, a.pr, a.ps, a.dist, a.join_type, a.unique_keys, a.zipf_factor, a.selectivity, a.algo)
        rows = experiments.run(spark, [config], a.sink, (a.key, a.payload), repeats=a.repeats)
    elif a.what == "grid":
        rows = grid(spark, a)
    else:
        from joinloom.registry import QUERIES

        QUERIES[a.name](spark, a.data).show(a.rows, truncate=False)
        rows = []
    for row in rows:
        print(json.dumps(row))
    return rows


if __name__ == "__main__":
    main()
