"""Benchmark: run every registered query on one scale and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is built and fully executed into Spark's ``noop`` sink (all
rows computed, nothing collected to the driver).  One warm-up query runs
first so JVM start-up and code loading are not charged to the first query.
The business table (the star join over lineitem, orders, customer, nation,
region, part) is prepared once per session, as the reference loads its
table once; that step is timed as ``prepare_sales`` and is part of the
total.
``BENCH_QUERIES`` (comma separated) limits the set; ``BENCH_REPEAT`` runs
each query several times and reports the median.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def calibrate() -> float:
    """Seconds for a fixed single-core Python workload: lets runs on a host
    whose speed varies be compared (not part of the total)."""
    t0 = time.perf_counter()
    acc = 0
    for i in range(3_000_000):
        acc += (i * i) % 7
    return round(time.perf_counter() - t0, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]

    from tessera.plans.catalog import QUERIES
    from tessera.session import build_session

    cal = calibrate()
    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus, app_name="tessera-bench")
    names = only or sorted(QUERIES)

    def run(name: str) -> float:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    run("metadata")  # warm-up (does not touch the business table)
    from tessera.sources.tables import prepared_sales
    t0 = time.perf_counter()
    prepared_sales(spark, sf_dir, refresh=True)   # always built inside the timed run
    times, failed = {"prepare_sales": round(time.perf_counter() - t0, 3)}, []
    for n in names:
        try:
            times[n] = round(statistics.median(run(n) for _ in range(repeat)), 3)
        except Exception as e:  # keep going; report the failure
            failed.append(n)
            print(f"# {n} failed: {type(e).__name__}: {str(e)[:200]}", file=sys.stderr)
    sf = os.path.basename(sf_dir).replace("sf", "")
    out = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
           "cpus": cpus, "n_queries": len(times), "failed": failed, "repeat": repeat, "calibration_sec": cal,
           "spark": spark.version}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
