"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line with the seconds of each."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "k4_factor_selection",
    "k1_factor_pipeline",
    "labels_forward",
    "a13_j13_event_study",
    "j3_asof_backward",
    "j12_next_session_entry",
    "r6_account_feature_view",
    "r7_long_form_ranks",
    "w2_rolling_windows",
    "a10_daily_ic",
    "a15_a18_account_performance",
    "a17_fifo_round_trips",
    "t2_t6_recursive_indicators",
    "d2_d3_fingerprint_dedupe",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from panelforge.plans import catalog

    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        began = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
