"""Times the headline queries once warm and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from echofold import plans

QUERIES = [
    "coactivity_bins", "pair_bin_cooccurrence", "burst_sessions", "fleet_components", "nearest_bracket", "guard_blocks", "interval_overlap_join", "band_join_counts",
    "nearest_match", "reconcile_full_outer", "first_wins_persist", "bucket_digests", "nearest_index_percentiles", "aggregate_compare_k_anon", "logodds_fusion", "associate_events", "burst_tau", "pair_census",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.sql.session.timeZone": "UTC"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in QUERIES:
        for _ in range(2):
            began = time.perf_counter()
            plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - began, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
