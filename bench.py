"""Seconds per query at one scale; prints one JSON line.

`landing` builds the staging, dimension and fact tables from the raw input, which the other
queries share; `weekly_source` and `stage_source` read the raw input on every run. Everything is
timed on its second run, the first one warms the session; `landing_cold` is the first build,
session start-up included, and no part of the total.
"""

from __future__ import annotations

import json
import os
import sys
import time

from farebox.plans import landing
from farebox.plans.catalog import QUERIES
from farebox.session import build_session


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or list(QUERIES)
    spark = build_session(f"local[{cpus}]", "bench", spark__sql__shuffle__partitions=cpus,
                          spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def run(name: str, job) -> None:
        start = time.perf_counter()
        job()
        seconds[name] = round(time.perf_counter() - start, 3)

    run("landing", lambda: landing.warehouse(spark, folder))
    cold = seconds["landing"]
    run("landing", lambda: landing.warehouse(spark, folder, refresh=True))
    for name in names:
        for _ in range(2):
            run(name, lambda: QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save())
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "landing_cold": cold,
                      "sf": float(scale) if scale.replace(".", "").isdigit() else scale}))
    spark.stop()


if __name__ == "__main__":
    main()
