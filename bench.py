"""Times the headline reports on a warm session and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

#: Reports timed, those with a published counterpart first.
HEADLINE = (
    "size_group_counts", "same_size_bands", "same_size_page", "largest_files", "parent_pass_labels", "hash_groups", "sample_digests", "directory_sizes",
    "scope_identity_reduction", "latest_observation", "changed_since_last", "revisit_schedule", "daily_quota", "metadata_ledger", "reconcile_absent",
)
ROUNDS = 3


def main() -> None:
    from pyspark.sql import SparkSession

    from cairn import catalogue

    cpus = os.environ.get("BENCH_CPUS", "8")
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(ROUNDS + 1):
            began = time.perf_counter()
            catalogue.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times[1:]), 4)  # the first run compiles
    print(json.dumps({"metric": "headline reports, sum of medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
