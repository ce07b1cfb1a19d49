"""Headline queries on the scene; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pointstrata.queries import QUERIES  # noqa: E402
from pointstrata.session import local_session  # noqa: E402

HEADLINE = {
    "T00_slice": "T00_slice", "T00_fast": "T00_fast_preset", "M01": "M01_statistical_noise", "M02b": "M02b_J05_voxel_noise",
    "M02c": "M02c_cell_density_noise", "A05": "A05_cell_statistics", "M04": "M04_height_above_ground", "D37": "D37_clashes",
    "T03": "T03_running_class_counts",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) * 2 if cpus.isdigit() else 16)
    n = spark.read.parquet(f"{sf_dir}/orders.parquet").count() * 4
    QUERIES["A01_class_histogram"](spark, sf_dir).collect()  # start JVM and Python workers
    times = {}
    for name, key in HEADLINE.items():
        start = time.perf_counter()
        QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "points": n, "points_per_sec": {k: int(n / v) for k, v in times.items()}, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", "")}))
    spark.stop()


if __name__ == "__main__":
    main()
