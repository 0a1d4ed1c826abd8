"""Time the composite jobs: one JSON line with seconds per job.

``BENCH_SF_DIR`` names the folder of tables, ``BENCH_CPUS`` the number of threads.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from checks.registry import QUERIES  # noqa: E402
from weekpanel.session import configure  # noqa: E402

JOBS = (
    "clean_messages",
    "clean_messages_raw",
    "activity_panel_stats",
    "activity_panel",
    "assign_batches",
    "incremental_batches",
    "mean_embedding_user_week",
    "weighted_mean_embedding",
    "score_user_weeks",
    "fused_score_arrow",
    "county_week_scores",
    "county_feature_table",
)
RUNS = 3


def seconds(spark: SparkSession, folder: str, name: str) -> float:
    begun = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begun


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count() or 1)
    builder = configure(SparkSession.builder.master(f"local[{cpus}]").appName("weekpanel-bench"))
    spark = (
        builder.config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in JOBS:
        seconds(spark, folder, name)  # warm-up
        times[name] = round(statistics.median(seconds(spark, folder, name) for _ in range(RUNS)), 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of the composite jobs, median of three runs after one warm-up",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": folder.rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
