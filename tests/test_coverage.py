"""Coverage against a brute-force pass over sorted samples, and the known fixtures."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dayloom.operators import coverage as cov

DAY = dt.datetime(2024, 3, 10)


def minutes(*ranges, day=DAY):
    return [day + dt.timedelta(minutes=m) for a, b in ranges for m in range(a, b)]


def frame(spark, stamps, subject=None):
    rows = [(subject or "p", t, 60.0) for t in stamps]
    return spark.createDataFrame(rows, "subject string, ts timestamp_ntz, heart_rate double")


def brute(stamps, gap, edge):
    out = {}
    for day, group in pd.Series(sorted(stamps)).groupby(pd.Series(sorted(stamps)).dt.date):
        t = group.to_numpy()
        gaps = np.diff(t) / np.timedelta64(1, "us")
        limit = gap * 60e6
        start = np.datetime64(day, "us")
        late = max(0, (t[0] - start) / np.timedelta64(1, "us") - edge * 60e6)
        early = max(0, (start + np.timedelta64(1, "D") - t[-1]) / np.timedelta64(1, "us") - edge * 60e6)
        out[day] = ((t[-1] - t[0]) / np.timedelta64(1, "us") / 3.6e9, int((gaps > limit).sum()),
                    (np.maximum(gaps - limit, 0).sum() + late + early) / 60e6,
                    bool(late == 0 and early == 0 and not (gaps > limit).any()))
    return out


@pytest.mark.parametrize("gap,edge", [(2, 2), (7, 0), (90, 30), (0.5, 1)])
def test_random_samples_match_brute_force(spark, gap, edge):
    rng = np.random.default_rng(3)
    stamps = [DAY + dt.timedelta(microseconds=int(x)) for x in rng.integers(0, 4 * 86_400_000_000, 3000)]
    stamps += [DAY] * 5 + [DAY + dt.timedelta(minutes=2 * i) for i in range(50)]
    got = cov.daily_coverage(frame(spark, stamps), max_gap_minutes=gap, edge_minutes=edge).collect()
    want = brute(stamps, gap, edge)
    assert {r["day"] for r in got} == set(want)
    for r in got:
        hours, gaps, missing, full = want[r["day"]]
        assert r["coverage_hours"] == pytest.approx(hours)
        assert r["gap_count"] == gaps
        assert r["total_missing_minutes"] == pytest.approx(missing)
        assert r["has_24h_coverage"] is full
        assert r["first_sample"].date() == r["day"] == r["last_sample"].date()


@pytest.mark.parametrize("ranges,allowance,ok", [
    ([(0, 1440)], 0, True),
    ([(0, 720), (730, 1440)], 0, False),
    ([(0, 720), (735, 1440)], 15, True),
    ([(0, 720), (780, 1440)], 0, False),
    ([(0, 480), (510, 1440)], 30, True),
    ([(10, 1430)], 20, True),
    ([(10, 1430)], 0, False),
    ([(720, 721)], 300, False),
])
def test_known_days(spark, ranges, allowance, ok):
    days = cov.qualifying_days(frame(spark, minutes(*ranges)), allowance_minutes=allowance)
    assert (days.count() == 1) is ok


def test_single_sample_day(spark):
    r = cov.daily_coverage(frame(spark, [DAY + dt.timedelta(hours=12)])).first()
    assert r["coverage_hours"] == 0 and r["gap_count"] == 0 and not r["has_24h_coverage"]
    assert r["total_missing_minutes"] == pytest.approx(1440 - 4)
    assert r["first_sample"] == r["last_sample"] == DAY + dt.timedelta(hours=12)


def test_extents_are_bounded_by_the_calendar(spark):
    hot = spark.range(200_000).select(
        F.lit("p").alias("subject"),
        (F.lit(DAY).cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("id") % 86_400).cast("decimal(18,6)"))).alias("ts"))
    assert cov.sample_extents(hot, subject_cols=["subject"]).count() == 720


def daily(spark, n=3, subject="p"):
    rows = [(subject, (DAY + dt.timedelta(days=i)).date(), float(i)) for i in range(n)]
    return spark.createDataFrame(rows, "subject string, day date, steps double")


def test_filter_keeps_full_days_per_subject(spark):
    samples = frame(spark, minutes((0, 1440)), "p").unionByName(frame(spark, minutes((0, 700)), "q"))
    both = daily(spark).unionByName(daily(spark, subject="q"))
    kept = cov.filter_by_coverage(both, samples, subject_cols=["subject"]).collect()
    assert [(r["subject"], r["day"]) for r in kept] == [("p", DAY.date())]


def test_filter_without_any_qualifying_day(spark):
    samples = frame(spark, minutes((0, 10)))
    assert cov.filter_by_coverage(daily(spark), samples).count() == 3
    assert cov.filter_by_coverage(daily(spark), samples, on_empty="empty").count() == 0
    assert cov.filter_by_coverage(daily(spark), samples.limit(0)).count() == 3
    with pytest.raises(ValueError):
        cov.filter_by_coverage(daily(spark), samples, on_empty="drop")


def test_invalid_heart_rate_does_not_count(spark):
    full = frame(spark, minutes((0, 1440)))
    dead = full.withColumn("heart_rate", F.when(F.hour("ts") == 5, 0.0).otherwise(F.col("heart_rate")))
    assert cov.filter_by_coverage(daily(spark), full).count() == 1
    assert cov.filter_by_coverage(daily(spark), dead, on_empty="empty").count() == 0
    assert cov.filter_by_coverage(daily(spark), dead, heart_rate=None).count() == 1


def test_argument_clamps():
    assert cov.clamp_coverage_args(1000, 0, -1) == (300, 2, 2)
    assert cov.clamp_coverage_args(None, None, None) == (0, 2, 2)
    assert cov.clamp_coverage_args(-5, 7, 0) == (0, 7, 0)


def test_plan_reduces_before_the_first_shuffle(spark):
    df = cov.daily_coverage(spark.read.parquet("/root/testdata/sf0.001/events.parquet").where(F.col("value").between(20, 250)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(value), GreaterThanOrEqual(value,20" in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,value:double>" in plan
    assert "partial_min" in plan


def test_worn_and_totals(spark):
    table = spark.createDataFrame([(95.0, True), (79.0, False), (None, None)], "coverage_pct double, has_24h_coverage boolean")
    labels = [r[0] for r in table.select(cov.worn_label(["coverage_pct"])).collect()]
    assert labels == ["worn", "not_worn", "not_worn"]
    total = cov.coverage_totals(table).first()
    assert (total["valid_days"], total["days_24h"], total["pct_24h"]) == (2, 1, 50.0)
