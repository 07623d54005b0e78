"""Time the headline queries on one machine and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "doc_chunks", "pq_status", "cite_task_evidence", "gap_validate", "role_match", "dep_cycles", "critical_path",
    "gr_task_score", "gr_retrieve_topk", "val_business_rules", "val_report",
    "art_engineer_story", "card_body", "checklist_diff", "drift_reconcile", "view_structure", "ev_coverage",
    "doc_section_pages", "drift_notify_batch", "sink_replace_by_project", "stream_drift",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(2 * int(cores)))
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from planloom.plans.queries import QUERIES
    from planloom.plans.registry import forget_stages

    spark.read.parquet(f"{folder}/region.parquet").count()  # start the executor before the clock
    seconds = {}
    for name in HEADLINE:
        # Every query pays for its own stages, also those another one has run.
        forget_stages()
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cores": int(cores),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
