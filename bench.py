"""Benchmark: run the headline queries on $BENCH_SF_DIR (default /root/testdata/sf0.1)
on local[$BENCH_CPUS] and print one JSON line.

Each query is fully materialised through the ``noop`` sink (every row computed, nothing
collected); a tiny warm-up query runs first so JVM start-up is not charged to a query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "profile", "clean_table", "ks_test", "correlation_matrix", "evaluation_report", "copula_sample",
    "summary_numeric", "missing_table", "sample_stratified", "bootstrap", "distribution_comparison",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]

    from tabsynth.session import local_session
    from tabsynth.plans import catalog, kernels

    spark = local_session(cpus=cpus, shuffle_partitions=max(8, int(cpus) * 2), app="tabsynth-bench")
    spark.read.parquet(f"{sf_dir}/region.parquet").count()  # warm-up

    timings: dict[str, float] = {}
    for name in names:
        fn = catalog.QUERIES[name]
        t0 = time.perf_counter()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - t0, 3)
        kernels.release()
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "headline_total_sec",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
