"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from panelcast.queries import QUERIES

HEADLINE = [
    "p03_outlier_filter",
    "a02_daily_panel",
    "a03_dense_grouping",
    "j01_calendar_join",
    "w05_rolling_full",
    "w07_ewm",
    "w16_interpolate",
    "c03_holiday_flags",
    "c16_all_features",
    "a10_correlation",
    "a11_mutual_information",
    "m02_additive_holdout",
    "m10_grid_search",
    "p07_date_discovery",
    "p21_label_encode",
    "a21_wide_ratio",
    "m07_autoregression",
    "m13_rolling_origin",
    "m14_rolling_backtest",
    "m15_holdout_evaluation",
    "m16_model_comparison",
    "q02_data_quality",
    "q03_history_pattern",
    "q06_overall_performance",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("panelcast-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # start the JVM's execution path once, outside the timings
    spark.read.parquet(f"{folder}/region.parquet").groupBy("r_name").count().collect()
    times = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
