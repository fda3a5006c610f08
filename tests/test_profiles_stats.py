import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dayloom.operators import profiles, ranges, stats, weekly

MONDAY = dt.date(2024, 7, 1)


def days(n, start=MONDAY):
    return [start + dt.timedelta(days=i) for i in range(n)]


@pytest.fixture(scope="module")
def two_weeks(spark):
    rows = [(d, 70.0 if i < 7 else 80.0, 60.0 if i < 7 else 55.0, 200 if i < 7 else 300) for i, d in enumerate(days(14))]
    return spark.createDataFrame(rows, "day date, score double, resting_heart_rate double, stress_duration long")


def test_weekly_aggregates(two_weeks):
    rows = weekly.weekly_aggregates(two_weeks).orderBy("iso_week").collect()
    assert [(r["iso_year"], r["iso_week"], r["sleep_score_avg"], r["rhr_avg"], r["stress_minutes_total"]) for r in rows] == [
        (2024, 27, 70.0, 60.0, 1400.0), (2024, 28, 80.0, 55.0, 2100.0)]
    assert rows[0]["week_start"] == MONDAY and rows[1]["week_end"] == days(14)[-1]
    assert weekly.weekly_aggregates(two_weeks, 1).count() == 1


def test_weekly_delta(two_weeks):
    weeks = weekly.weekly_aggregates(two_weeks)
    d = weekly.weekly_delta(weeks, "rhr_avg", "rhr_count", lower_is_better=True).orderBy("iso_week").collect()
    assert (d[0]["delta"], d[1]["delta"], d[1]["trend"]) == (None, -5.0, "+")
    s = weekly.weekly_delta(weeks, "stress_minutes_total", "stress_minutes_count", lower_is_better=True, whole=True)
    assert s.orderBy("iso_week").collect()[1]["trend"] == "-"


def test_short_week_resets_comparison(spark):
    d = days(21)
    rows = [(x, float(i)) for i, x in enumerate(d) if not (9 <= i <= 13)]
    weeks = weekly.weekly_aggregates(spark.createDataFrame(rows, "day date, score double"))
    got = weekly.weekly_delta(weeks, "sleep_score_avg", "sleep_score_count").orderBy("iso_week").collect()
    assert [r["value"] is None for r in got] == [False, True, False] and all(r["delta"] is None for r in got)
    assert weekly.latest_week_summary(weeks).first()["sleep_score_change"] is None


def test_resting_hr_falls_back(spark):
    df = spark.createDataFrame([(d, None, 50.0) for d in days(7)], "day date, resting_heart_rate double, rhr double")
    assert weekly.weekly_aggregates(df).first()["rhr_avg"] == 50.0


@pytest.mark.parametrize("mode", ["bounded", "exact"])
def test_weekday_profile_matches_pandas(spark, mode):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"day": days(70), "score": rng.normal(70, 9, 70), "bb_max": rng.integers(0, 100, 70).astype(float)})
    pdf.loc[::5, "score"] = np.nan
    rows = [(d, None if math.isnan(s) else s, b) for d, s, b in pdf.itertuples(index=False)]
    got = profiles.weekday_profile(spark.createDataFrame(rows, "day date, score double, bb_max double"), mode=mode).toPandas()
    assert len(got) == 14 and set(got["metric"]) == {"sleep_score", "body_battery_max"}
    pdf["name"] = pd.to_datetime(pdf["day"]).dt.day_name()
    want = pdf.groupby("name")["score"].agg(["mean", "median", "std", "count"])
    mine = got[got["metric"] == "sleep_score"].set_index("day_of_week")
    for c in want.columns:
        np.testing.assert_allclose(mine[c].astype(float).sort_index(), want[c].sort_index())
    assert mine.loc["Sunday", "day_of_week_num"] == 0
    insight = {r["metric"]: r for r in profiles.weekday_insight(spark.createDataFrame(got)).collect()}
    assert insight["sleep_score"]["best_day"] == want["mean"].idxmax()
    flat = spark.createDataFrame(got.assign(mean=5.0))
    assert {r["normalized"] for r in profiles.weekday_minmax(flat).collect()} == {50.0}


@pytest.mark.parametrize("mode", ["bounded", "exact"])
def test_hourly_profile(spark, mode):
    rows = [(dt.datetime(2024, 1, 1, 5), 1.0), (dt.datetime(2024, 1, 2, 5), 3.0), (dt.datetime(2024, 1, 1, 6), 9.0),
            (dt.datetime(2024, 1, 1, 7), None)]
    got = {r["hour"]: r for r in profiles.hourly_profile(
        spark.createDataFrame(rows, "ts timestamp_ntz, stress double"), mode=mode).collect()}
    assert (got[5]["mean"], got[5]["median"], got[5]["count"]) == (2.0, 2.0, 2)
    assert got[5]["ci_upper"] == pytest.approx(2 + 1.96 * math.sqrt(2) / math.sqrt(2))
    assert got[6]["std"] is None and got[6]["ci_lower"] == got[6]["ci_upper"] == 9.0
    assert got[7]["count"] == 0 and got[7]["median"] is None


def pandas_bins(v, s, n):
    edges = np.unique(np.percentile(v, np.linspace(0, 100, n + 1)))
    codes = np.maximum(np.searchsorted(edges, v, side="left"), 1)
    return pd.DataFrame({"bin": codes, "s": s}).groupby("bin")["s"].agg(["mean", "count", "std"]), edges


@pytest.mark.parametrize("mode", ["bounded", "exact"])
def test_quantile_bins(spark, mode):
    rng = np.random.default_rng(5)
    v, s = np.round(rng.gamma(2, 3000, 60), -2), rng.normal(70, 5, 60)
    want, edges = pandas_bins(v, s, 5)
    df = spark.createDataFrame(pd.DataFrame({"steps": v, "score": s}))
    got = ranges.quantile_bins(df, "steps", mode=mode).orderBy("bin").toPandas()
    np.testing.assert_allclose(got["mean"], want["mean"])
    np.testing.assert_array_equal(got["count"], want["count"])
    np.testing.assert_allclose(got["bin_low"], edges[:-1])
    best = ranges.best_range(spark.createDataFrame(got)).first()
    assert best["low"] == pytest.approx(edges[want["mean"].argmax()])


def test_quantile_bins_collapse_and_minimum(spark):
    constant = spark.createDataFrame([(5.0, 1.0)] * 10, "steps double, score double")
    assert ranges.quantile_bins(constant, "steps").count() == 0
    assert ranges.quantile_bins(constant.limit(2), "steps").count() == 0
    heavy = spark.createDataFrame([(0.0, 1.0)] * 30 + [(float(i), 2.0) for i in range(1, 11)], "steps double, score double")
    assert [r["count"] for r in ranges.quantile_bins(heavy, "steps").orderBy("bin").collect()] == [32, 8]


def test_optimal_ranges_message(spark):
    df = spark.createDataFrame([(float(1000 * i), float(i), 60.0 + (i == 5) * 20) for i in range(20)],
                               "steps double, intensity_time double, score double")
    rows = {r["habit"]: r for r in ranges.optimal_ranges(df).collect()}
    assert rows["steps"]["message"] == "Your best sleep occurs when steps are between 3,800–7,600"
    assert rows["intensity"]["message"] == "Your best sleep occurs when intensity minutes are between 4–8"
    with pytest.raises(ValueError):
        ranges.optimal_ranges(df.select("score"))


def test_quartile_spread_needs_distinct_values(spark):
    df = spark.createDataFrame([(float(i), float(i * i)) for i in range(40)], "v double, t double")
    rows = {r["group"]: r for r in ranges.quartile_spread(df, "v", "t").collect()}
    assert set(rows) == {"Q1", "Q2", "Q3", "Q4"} and rows["Q1"]["minimum"] == 0 and rows["Q4"]["maximum"] == 39 ** 2
    same = spark.createDataFrame([(float(i % 2), 1.0) for i in range(40)], "v double, t double")
    assert ranges.quartile_spread(same, "v", "t").count() == 0


def test_correlations_match_pandas(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame(rng.normal(size=(200, 3)), columns=list("abc"))
    pdf["d"] = pdf["a"] * 2 + rng.normal(size=200) * 0.1
    pdf["flat"] = 1.0
    pdf.loc[::7, "b"] = np.nan
    sdf = spark.createDataFrame([tuple(None if isinstance(x, float) and math.isnan(x) else float(x) for x in r)
                                 for r in pdf.itertuples(index=False)], "a double, b double, c double, d double, flat double")
    want = pdf.corr()
    for r in stats.correlation_pairs(sdf).collect():
        if "flat" in (r["a"], r["b"]):
            assert r["r"] is None
        else:
            assert r["r"] == pytest.approx(want.loc[r["a"], r["b"]])
    top = stats.top_correlations(stats.correlation_pairs(sdf), threshold=0.9).collect()
    assert [(r["a"], r["b"]) for r in top] == [("a", "d")]
    rank = pdf.dropna()[list("abc")].rank().corr()
    for r in stats.spearman_pairs(sdf, list("abc")).collect():
        assert r["r"] == pytest.approx(rank.loc[r["a"], r["b"]])


@pytest.mark.parametrize("alpha", [0.95, 0.3, 0.001, 1.0])
def test_decayed_mean_over_long_history(spark, alpha):
    rng = np.random.default_rng(2)
    d = sorted(set(rng.integers(0, 3000, 250).tolist()))
    x = rng.normal(60, 5, len(d))
    df = spark.createDataFrame([(MONDAY + dt.timedelta(days=i), float(v)) for i, v in zip(d, x)], "day date, hr double")
    got = [r["smoothed_hr"] for r in stats.decayed_mean(df, ["hr"], alpha).orderBy("day").collect()]
    if alpha == 1.0:
        np.testing.assert_allclose(got, x.mean())
        return
    want = []
    for i, day in enumerate(d):
        w = alpha ** (day - np.array(d[:i + 1], dtype=float))
        want.append((w * x[:i + 1]).sum() / w.sum())
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_splits(spark):
    df = spark.createDataFrame([(d,) for d in days(23)], "day date")
    assert stats.chronological_split(df).where("is_train").count() == 18
    folds = {r["fold"]: r["n"] for r in stats.expanding_folds(df, 5).groupBy("fold").agg(F.count("*").alias("n")).collect()}
    assert folds == {0: 8, 1: 3, 2: 3, 3: 3, 4: 3, 5: 3}
    last = stats.expanding_folds(df, 5).where("fold = 5").agg(F.min("day"), F.max("day")).first()
    assert last[0] == days(23)[20] and last[1] == days(23)[22]


def test_trend_line_and_importance(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(10)], "x double, y double")
    r = stats.linear_trend(df, "x", "y").first()
    assert (r["slope"], r["intercept"], r["r"]) == (pytest.approx(2), pytest.approx(1), pytest.approx(1))
    imp = spark.createDataFrame([("rhr", 2.0), ("steps", 1.0), ("stress_avg", 1.0)], "feature string, importance double")
    assert {r["category"]: r["share"] for r in stats.importance_by_category(imp).collect()} == {
        "heart_rate": 0.5, "activity": 0.25, "other": 0.25}


def test_correlations_far_from_zero_constant_and_missing(spark):
    rows = [(1e9 + i, 1e9 + 2.0 * i, 0.1, float("nan") if i % 2 else float(i), None) for i in range(40)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(5)
    got = {(r["a"], r["b"]): (r["n"], r["r"]) for r in stats.correlation_pairs(df).collect()}
    assert len(got) == 10 and got["a", "b"][0] == 40 and abs(got["a", "b"][1] - 1) < 1e-9
    assert got["a", "c"] == (40, None) and got["a", "e"] == (0, None)
    assert got["a", "d"][0] == 20 and abs(got["a", "d"][1] - 1) < 1e-9
    assert stats.correlation_pairs(df.select("a")).count() == 0
    assert {r["r"] for r in stats.correlation_pairs(df.limit(0)).collect()} == {None}


def test_latest_week_reports_numbers(two_weeks):
    row = weekly.latest_week_summary(weekly.weekly_aggregates(two_weeks)).first()
    assert (row["sleep_score_change"], row["sleep_score_sign"], row["rhr_sign"], row["stress_sign"]) == (10.0, 1, -1, 1)
