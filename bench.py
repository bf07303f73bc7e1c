"""Times of the headline queries: prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tracelake import queries as engine

HEADLINE = (
    "logs_search", "logs_volume_by", "logs_matches", "metrics_range_avg", "metrics_rate_counter", "metrics_catalog", "histogram_quantile_merged", "trace_search", "trace_summaries",
    "span_red_metrics", "promql_sum_of_selector", "promql_rate", "logql_count_over_time", "traceql_select", "traceql_child", "attribute_key_values", "sql_pricing_summary", "sql_join_inner", "join_as_of",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    every, times = engine.queries(), {}
    for name in HEADLINE:
        best = None
        for _ in range(2):  # the first run compiles
            start = time.perf_counter()
            every[name](spark, folder).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.perf_counter() - start)
        times[name] = round(best, 3)
    print(json.dumps({"metric": "headline_queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
