"""Time the named analyses and print one JSON line.

Every query runs once to warm up and then BENCH_RUNS times (default 3); its median counts. All
result rows are computed and dropped, none go to the driver.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from cartsight.plans import QUERIES
from cartsight.session import sized_settings


def session(cpus: str, folder: str) -> SparkSession:
    stored = sum(entry.stat().st_size for entry in os.scandir(folder) if entry.is_file())
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("cartsight-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in sized_settings(stored, int(cpus)).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(spark: SparkSession, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = session(cpus, folder)
    seconds = {}
    for name in QUERIES:
        run(spark, name, folder)
        seconds[name] = round(statistics.median(run(spark, name, folder) for _ in range(runs)), 4)
    spark.stop()
    result = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 4),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")),
        "cpus": int(cpus),
        "runs": runs,
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
