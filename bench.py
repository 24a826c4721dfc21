"""Times the registered queries; prints one JSON line.

``BENCH_SF_DIR`` is the directory of the tables, ``BENCH_CPUS`` the number of local cores,
``BENCH_QUERIES`` an optional comma-separated choice. Every query is executed in full, once, into Spark's
no-op sink; building its plan counts. A few queries on the smallest tables warm the session up first.
"""

from __future__ import annotations

import json
import os
import sys
import time

from fieldtally.session import build_session

WARM_UP = ("records_total_by_park", "observer_curve", "park_points", "watch_all_lists", "period_mean_se")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "fieldtally-bench",
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=str(max(8, int(cpus))),
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "12g"),
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    from fieldtally.plans.catalog import QUERIES

    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else list(QUERIES)
    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")

    def run(name: str, directory: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    if os.path.isdir(warm_dir):
        for name in WARM_UP:
            run(name, warm_dir)
    timings: dict[str, float] = {}
    for name in names:
        timings[name] = round(run(name, sf_dir), 4)
        print(f"{name}: {timings[name]:.3f}s", file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "total seconds over all registered queries",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
