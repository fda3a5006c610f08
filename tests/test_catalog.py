"""Registered queries: contract of the driver and agreement with their SQL."""

import datetime as dt

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as driver
from conftest import SF_SMALL
from dayloom.catalog import QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
QUICK = ("daily_coverage", "subject_coverage", "coverage_filter", "daily_stress", "hourly_profile", "weekday_profile",
         "weekly_aggregates", "quantile_bins", "best_range", "activity_calendar", "display_names", "outliers_3iqr",
         "corr_pairs", "impute_median", "iqr_filter", "duration_minutes", "schema_drift", "mahalanobis",
         "master_daily_subject", "quality_score_subject", "activity_detail_clashing_ids", "latest_week", "weekly_report",
         "modeling_recommendations", "rates_of_given_labels", "csv_round_trip", "stored_quality", "bundle", "pca2",
         "stream_hourly_large_mean", "trend_summary_correlations", "table_audit", "kmeans", "gaussian_mixture", "mahalanobis_vectors",
         "zoned_coverage", "exported_master", "mapping_file", "repaired_days", "looked_back", "intensity_fallbacks", "spearman")


def test_entry_and_keys(spark):
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries()) and set(QUERIES) <= set(driver.queries())


def plain(v):
    if v is None or v is pd.NA or v != v or str(v) in ("NaT", "<NA>"):
        return "null"
    if isinstance(v, dt.date) or hasattr(v, "isoformat"):
        return str(v)[:10] if not hasattr(v, "hour") or (v.hour, v.minute, v.second) == (0, 0, 0) else str(v)
    return str(round(float(v), 5) + 0.0) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", QUICK)
def test_query_agrees_with_sql(spark, con, name):
    got = QUERIES[name].frame(spark, SF_SMALL)
    want = con.execute(QUERIES[name].oracle()).df()
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    mine = sorted(tuple(plain(r[c]) for c in names) for r in got.collect())
    theirs = sorted(tuple(plain(v) for v in r) for r in want[names].astype(object).itertuples(index=False, name=None))
    assert mine == theirs
