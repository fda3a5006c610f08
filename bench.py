"""Warm run time of the headline queries; prints one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` set data and cores.  Every query runs once
to warm up and then ``BENCH_RUNS`` times; the median is reported.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from dayloom.catalog import QUERIES  # noqa: E402
from dayloom.session import scratch  # noqa: E402

HEADLINE = (
    "daily_coverage", "subject_coverage", "qualifying_days", "daily_stress", "activity_daily", "master_daily", "quality_score",
    "weekly_aggregates", "weekly_delta", "weekday_profile", "weekend_effect", "hourly_profile", "hour_weekday",
    "period_of_day", "quantile_bins", "best_range", "corr_pairs", "feature_stats", "outliers_3iqr", "completeness",
    "iqr_filter_one_pass", "placeholder_clean", "duration_minutes", "impute_median", "ffill", "rolling_7_30", "ewm_decay",
    "display_names", "activity_calendar", "standardize", "robust_scale", "trend_line", "table_audit",
    "master_daily_subject", "quality_score_subject", "exact_quantiles", "spearman", "iqr_filter", "corr_matrix", "isolation_forest",
    "mahalanobis", "kmeans", "weekly_report", "stream_daily_stress", "stream_coverage",
    "choose_k", "gaussian_mixture", "linear_models", "mahalanobis_vectors", "zoned_coverage", "bucketed_join",
)
#: Dear ones, run once after the warm-up.
ONCE = ("lof", "dbscan")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in (*HEADLINE, *ONCE):
        samples = []
        for i in range((1 if name in ONCE else runs) + 1):
            start = time.perf_counter()
            with scratch(spark):
                QUERIES[name].frame(spark, sf_dir).write.format("noop").mode("overwrite").save()
                took = time.perf_counter() - start
            if i:
                samples.append(took)
        times[name] = round(statistics.median(samples), 4)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
