"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "w03_chainage",
    "j01_gps_interpolation",
    "w01_closest_approach",
    "a03_union_area",
    "c04_dedup_tracks",
    "w04_segments",
    "f10_priority",
    "t01_queue_order",
    "t02_budget_selection",
    "j06_coverage",
    "j08_greedy_match",
    "a06_detection_scores",
    "a13_pairwise_kappa",
    "a14_threshold_search",
    "a16_dataset_audit",
    "w06_grouped_split",
    "t04_nearest_cross_split",
    "c02_hash_groups",
    "c03_suppression",
    "s01_gps_csv",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("roadloom-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from roadloom.plans.catalogue import QUERIES

    spark.range(1000).selectExpr("sum(id)").collect()
    # intermediates are shared between queries, as in one application; the first user pays
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr)
    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cores": cpus,
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
