"""Time the headline queries at one scale and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and parallelism.  Each
query is planned and run to a no-op sink, so every output row and column is computed but none is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from larder.queries import QUERIES  # noqa: E402
from larder.session import build_session  # noqa: E402

HEADLINE = [
    "reorder_plan",
    "clean_inventory",
    "clean_export",
    "dq_report",
    "daily_item_sales",
    "sales_revenue",
    "dedupe_keep_last",
    "m5_tidy",
    "forecast_items",
    "forecast_with_history",
    "forecast_turning",
    "inventory_insights",
    "reorder_priority",
    "feature_table",
    "forecast_recursive_28",
    "wrmsse_bottom",
    "recent_messages",
    "intent_flags",
    "shelf_gap_local",
    "gap_batch",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    # One small job first, so that no query pays for starting the JVM's worker threads.
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(os.path.normpath(folder)).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": float(scale)}))


if __name__ == "__main__":
    main()
