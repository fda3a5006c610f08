import datetime as dt

import pytest
from pyspark.sql import functions as F

from dayloom.operators import impute as im
from dayloom.operators import prep, quality

D0 = dt.date(2024, 1, 1)


def test_score_combines_coverage_and_completeness(spark):
    df = spark.createDataFrame([(D0, 5000.0, None, 80.0), (D0, None, None, None), (D0, 1.0, 2.0, 150.0)],
                               "day date, steps double, score double, coverage_pct double")
    rows = [r[1:] for r in quality.quality_score(df).collect()]
    assert rows == [(65.0, 80.0, 50.0, 1, 2), (0.0, 0.0, 0.0, 0, 2), (100.0, 100.0, 100.0, 2, 2)]


def test_score_without_coverage_is_neutral_and_flag_counts(spark):
    df = spark.createDataFrame([(D0, 1.0)], "day date, steps double")
    assert quality.quality_score(df).first()["coverage_score"] == 50.0
    flagged = df.withColumn("has_24h_coverage", F.lit(False))
    assert quality.quality_score(flagged).first()["data_quality_score"] == 50.0
    assert quality.quality_score(df.drop("steps")).first()["completeness_score"] == 0.0
    weighted = quality.quality_score(flagged, coverage_weight=1, completeness_weight=3).first()
    assert weighted["data_quality_score"] == 75.0


def test_scores_round_half_to_even(spark):
    df = spark.createDataFrame([(D0, 62.25)], "day date, coverage_pct double")
    assert quality.quality_score(df, completeness_weight=0).first()["coverage_score"] == 62.2


def test_completeness_levels(spark):
    df = spark.range(100).select(
        "id", *[F.when(F.col("id") < n, 1.0).alias(f"c{n}") for n in (0, 10, 30, 50, 70, 90)],
        F.when(F.col("id") < 40, 1.0).otherwise(float("nan")).alias("with_nan"))
    rows = {r["column"]: r for r in quality.completeness(df).collect()}
    levels = [rows[f"c{n}"]["completeness_level"].split(" (")[0] for n in (0, 10, 30, 50, 70, 90)]
    assert levels == ["Critical", "Very Poor", "Poor", "Fair", "Good", "Excellent"]
    assert rows["with_nan"]["non_null_count"] == 40
    assert rows["c50"]["sufficient_for_modeling"] and not rows["c30"]["sufficient_for_modeling"]
    assert not rows["c0"]["adequate_for_analysis"] and rows["c10"]["adequate_for_analysis"]


def test_domains_by_first_keyword(spark):
    df = spark.createDataFrame([(1,) * 6], "hr_max int, total_sleep int, steps int, weight int, foo int, stress_duration int")
    got = {r["column"]: r["domain"] for r in quality.column_domains(df).collect()}
    assert got == {"hr_max": "heart_rate", "total_sleep": "sleep", "steps": "activity", "weight": "body", "foo": "other",
                   "stress_duration": "stress"}


def test_outliers_need_values_and_spread(spark):
    df = spark.createDataFrame([(float(i % 5), 1.0, float(i)) for i in range(50)] + [(1000.0, 1.0, 7.0), (-1000.0, 1.0, 7.0)],
                               "a double, b double, c double")
    rows = quality.extreme_outliers(df).collect()
    assert [(r["column"], r["outlier_count"], r["outlier_min"], r["outlier_max"]) for r in rows] == [("a", 2, -1000.0, 1000.0)]
    assert quality.extreme_outliers(df.limit(10)).count() == 0


def test_duplicate_columns_see_nulls(spark):
    df = spark.createDataFrame([(1, 1.0, None, None, 2), (2, 2.0, 3.0, 3.0, 1)], "a int, b double, c double, d double, e int")
    assert {tuple(r) for r in quality.duplicate_columns(df).collect()} == {("a", "b"), ("c", "d")}


def test_text_issues(spark):
    df = spark.createDataFrame([("1:00", "5", "a"), ("x", "y", "b")], "t string, m string, p string")
    rows = {r["column"]: (r["has_time_strings"], r["mixed_types"]) for r in quality.text_issues(df).collect()}
    assert rows == {"t": (True, False), "m": (False, True), "p": (False, False)}


def test_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([(0.0,), (4.9,), (5.0,), (100.0,), (101.0,)], "s double")
    assert {r["bin"]: r["n"] for r in quality.score_histogram(df, "s").collect()} == {0: 2, 1: 1, 19: 1}


def test_clean_placeholders_types_names(spark):
    df = spark.createDataFrame([("NA", -1, "1.5", 2.0), ("x", 3, "", 4.0), ("null", 5, "None", float("nan"))],
                               "` Some Name ` string, n int, t string, w double")
    out = prep.clean(df)
    assert out.columns == ["some_name", "n", "t", "w"]
    assert dict(out.dtypes) == {"some_name": "string", "n": "bigint", "t": "double", "w": "bigint"}
    assert [tuple(r) for r in out.collect()] == [(None, None, 1.5, 2), ("x", 3, None, 4), (None, 5, None, None)]
    kept = prep.blank_placeholders(df, ["t"])
    assert kept.where("n = -1").count() == 1


def test_iqr_filter_is_sequential_unless_one_pass(spark):
    rows = [(float(i), float(i % 7)) for i in range(40)] + [(500.0, 3.0), (20.0, 300.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    import pandas as pd
    pdf = pd.DataFrame(rows, columns=["a", "b"])
    for c in ("a", "b"):
        q1, q3 = pdf[c].quantile([0.25, 0.75])
        pdf = pdf[pdf[c].between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)) | pdf[c].isna()]
    for mode in ("bounded", "exact"):
        assert prep.iqr_filter(df, mode=mode).count() == len(pdf) == 41
    assert prep.iqr_filter(df, one_pass=True).count() == 41


def test_modeling_set(spark):
    df = spark.createDataFrame(
        [(1, 80.0, 20.0, None, True, True), (2, None, 30.0, None, False, True), (3, 70.0, 25.0, 1.0, False, False)],
        "id int, score double, stress_avg double, mostly_nan double, missing_score boolean, has_24h_coverage boolean"
    ).withColumn("Unnamed: 0", F.lit(1))
    out = prep.modeling_set(df, ["score", "stress_avg", "nope"], max_missing_share=0.5)
    assert out.count() == 2 and set(out.columns) == {"id", "score", "stress_avg", "has_24h_coverage"}
    assert prep.modeling_set(df, ["score"], require_24h=True).count() == 1


def test_date_filters(spark):
    df = spark.createDataFrame([(D0 + dt.timedelta(days=i),) for i in range(60)], "day date")
    assert prep.filter_by_date(df, start="2024-01-10", end="2024-01-12").count() == 3
    assert prep.filter_by_date(df, days_back=5, now="2024-02-29 00:00:00").count() == 6
    assert prep.filter_by_date(df, days_back=5, now="2024-02-29 12:00:00").count() == 5
    assert prep.filter_by_date(df, days_back=5, weeks_back=4, now="2024-02-29").count() == 6
    assert prep.filter_by_date(df, months_back=1, now="2024-02-29").count() == 32
    assert prep.last_days(df, 10).count() == 11
    assert prep.last_full_month(df).count() == 31


def test_required_columns_missing_leaves_input(spark):
    df = spark.createDataFrame([(1, None), (2, 3)], "a int, b int")
    assert prep.require_columns(df, ["a", "zz"]).count() == 2
    assert prep.require_columns(df, ["b"]).count() == 1


def test_column_choices(spark):
    df = spark.createDataFrame([(None, 5.0, "0:30:00", "1:00:00")], "resting_heart_rate double, rhr double, moderate_activity_time string, vigorous_activity_time string")
    assert prep.first_with_values(df, ("resting_heart_rate", "rhr")) == "rhr"
    assert df.select(prep.intensity_minutes(df)).first()[0] == 90.0
    assert prep.intensity_minutes(df.select("rhr")) is None
    out = prep.coalesce_columns(df, "hr", "resting_heart_rate", "rhr", "nope")
    assert out.first()["hr"] == 5.0 and "rhr" not in out.columns


def test_feature_and_target_choice(spark):
    df = spark.range(100).select("id", F.col("id").cast("double").alias("a"), F.when(F.col("id") < 30, 1.0).alias("b"),
                                 F.lit(1.0).alias("start_x"), F.when(F.col("id") < 10, 1.0).alias("score"))
    assert prep.select_features(df, min_values=50) == ["id", "a", "start_x"]
    assert prep.select_features(df, ["b"], min_values=50, fallback=2) == ["id", "a"]
    assert prep.select_features(df, min_values=20, skip_time_names=True, exclude=["id"]) == ["a", "b"]
    assert prep.resolve_target(df, "score", exclude=("id",)) == "a"
    assert prep.resolve_target(df, "b") == "b"
    with pytest.raises(ValueError):
        prep.resolve_target(df.select("score"), "score")


def test_first_element(spark):
    df = spark.createDataFrame([([1.5, 2.0],), ([],), (None,)], "v array<double>")
    assert [r[0] for r in prep.first_element(df, "v").collect()] == [1.5]
    text = spark.createDataFrame([("3",), ("x",)], "v string")
    assert [r[0] for r in prep.first_element(text, "v").collect()] == [3.0]


@pytest.fixture(scope="module")
def gaps(spark):
    return spark.createDataFrame([(D0 + dt.timedelta(days=i), a, b) for i, (a, b) in enumerate(
        [(1.0, 10.0), (None, 20.0), (3.0, None), (4.0, 40.0), (5.0, 50.0)])], "day date, a double, b double")


@pytest.mark.parametrize("strategy,a,b", [
    ("median", [1, 3.5, 3, 4, 5], [10, 20, 30, 40, 50]),
    ("mean", [1, 3.25, 3, 4, 5], [10, 20, 30, 40, 50]),
    ("forward_fill", [1, 1, 3, 4, 5], [10, 20, 20, 40, 50]),
    ("backward_fill", [1, 3, 3, 4, 5], [10, 20, 40, 40, 50]),
    ("drop", [1, 4, 5], [10, 40, 50]),
    ("none", [1, None, 3, 4, 5], [10, 20, None, 40, 50]),
])
def test_impute(gaps, strategy, a, b):
    rows = im.impute(gaps, ["a", "b"], strategy).orderBy("day").collect()
    assert [r["a"] for r in rows] == a and [r["b"] for r in rows] == b


def test_impute_errors_and_empty_column(spark, gaps):
    for args in (([], "median"), (["zz"], "median"), (["a"], "guess")):
        with pytest.raises(ValueError):
            im.impute(gaps, *args)
    empty = gaps.withColumn("e", F.lit(None).cast("double"))
    assert im.impute(empty, ["e", "a"], "median").where("e is null").count() == 5


def test_impute_from_training_rows(gaps):
    train = gaps.where("day <= '2024-01-03'")
    assert im.impute(gaps, ["a"], "median", fitted_on=train).where("a = 2.0").count() == 1


def test_imputation_advice(spark):
    df = spark.createDataFrame([(float(i), float(i % 3), None) for i in range(20)] + [(5000.0, 1.0, None)], "a double, b double, c double")
    got = {r["column"]: (r["strategy"], r["has_outliers"]) for r in im.recommend_imputation(df, ["a", "b", "c", "zz"]).collect()}
    assert got == {"a": ("median", True), "b": ("mean", False), "c": ("drop", False)}


def test_sample_skewness_is_bias_corrected(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    assert df.agg(im.sample_skewness("x")).first()[0] == pytest.approx(1.763632614803888)


def test_scalers(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (10.0, 5.0), (None, 5.0)], "x double, c double")
    rows = im.standardize(df, ["x", "c"]).agg(F.avg("x"), F.stddev_pop("x"), F.max("c"), F.count("*")).first()
    assert rows[0] == pytest.approx(0) and rows[1] == pytest.approx(1) and rows[2] == 0 and rows[3] == 4
    robust = im.robust_scale(df, ["x", "c"]).orderBy("x").collect()
    assert [r["x"] for r in robust] == [None, -0.5, pytest.approx(-1 / 6), pytest.approx(1 / 6), pytest.approx(7.5 / 3)][0:1] + [
        pytest.approx((v - 2.5) / 3.0) for v in (1, 2, 3, 10)]
