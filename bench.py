"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (data folder), BENCH_CPUS (local cores),
BENCH_RUNS (timed runs per query, median reported), BENCH_QUERIES (names).
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from saleswell.plans.catalog import REGISTRY
from saleswell.sources.sample import Feeds

HEADLINE = (
    "storefront_bucket new_vs_returning marketplace_bucket web_traffic settlement_orders cogs_bucket channel_week channel_day "
    "pl_monthly kpi_totals yoy_tolerance sales_by_sku top_categories top_sku_compare top_wholesale_customers sku_report "
    "buy_forecast cost_asof margin_enrich settlement_unpivot economics_flatten invoice_parse drift_checks window_reload "
    "balances running_balance ledger_replay queue_replay hydrate_events item_match parity_stats validate_lines"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One untimed run warms the JVM and the file cache.
    REGISTRY["storefront_bucket"].build(Feeds(spark, folder)).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            REGISTRY[name].build(Feeds(spark, folder)).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 3)
    spark.stop()
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
    }))


if __name__ == "__main__":
    main()
