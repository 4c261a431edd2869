"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: the tables, /root/testdata/sf0.1 unless set. BENCH_CPUS: threads, all unless set.
BENCH_REPEATS: timed rounds, 5 unless set. Every query runs once before any is timed; then rounds of
all queries follow each other, so that no query has a warmer machine than another. A query's seconds
are the median, into a sink that computes every row and keeps none. Names that end in _shuffled are
the same plans where nothing may be broadcast, as tables of a hundred times the size would have it."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(ROOT), os.environ.get("PYTHONPATH")]))

from joinloom.operators.relational import materialised  # noqa: E402
from joinloom.plans import queries as plans  # noqa: E402
from joinloom.registry import QUERIES, orders_lines  # noqa: E402
from joinloom.session import session  # noqa: E402

STRATEGIES = ("SMJ", "SMJI", "SHJ", "PHJ")
HEADLINES = ("scan_lineitem", "filter_date_range", "q7_shape", "q18_shape", "q19_shape", "q64_shape", "q95_shape", "join_checksum", "radix_histogram", "radix_partition_offsets", "star_join_8", "grid_skew")


SHUFFLED = ("q7_shape", "q18_shape", "q19_shape", "q64_shape", "star_join_8")
THRESHOLD = "spark.sql.autoBroadcastJoinThreshold"


def headline_queries() -> dict:
    found = {name: QUERIES[name] for name in HEADLINES}
    found |= {f"{name}_shuffled": QUERIES[name] for name in SHUFFLED}
    for s in STRATEGIES:  # the same join by each strategy, and one more for a star of a million rows
        found[f"join_{s.lower()}"] = lambda spark, d, s=s: orders_lines(spark, d, s)
    found["star_1m"] = lambda spark, d: plans.star_join_8(spark, 1_000_000, 65_536)
    return found


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    repeats = int(os.environ.get("BENCH_REPEATS", "5"))
    n = os.cpu_count() or 8 if cpus == "*" else int(cpus)
    spark = session("bench", f"local[{cpus}]", n, **{"spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": str(n)})
    spark.sparkContext.setLogLevel("ERROR")
    queries, usual = headline_queries(), spark.conf.get(THRESHOLD)

    def run(name: str) -> None:
        spark.conf.set(THRESHOLD, "-1" if name.endswith("_shuffled") else usual)
        materialised(queries[name](spark, d))

    for name in queries:
        run(name)
    took: dict[str, list[float]] = {name: [] for name in queries}
    for _ in range(repeats):
        for name in queries:
            began = time.perf_counter()
            run(name)
            took[name].append(time.perf_counter() - began)
    seconds = {name: round(median(t), 4) for name, t in took.items()}
    print(json.dumps({"metric": "total of median query seconds", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds, "sf": Path(d).name.removeprefix("sf"), "cpus": n, "repeats": repeats}))
    spark.stop()


if __name__ == "__main__":
    main()
