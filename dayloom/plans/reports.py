"""Report tables and the rules that turn results into recommendations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.operators import quality, stats, weekly
from dayloom.operators.anomaly import isolation_forest
from dayloom.operators.coverage import filter_by_coverage, qualifying_days
from dayloom.operators.impute import impute
from dayloom.operators.prep import last_full_month
from dayloom.operators.ranges import optimal_ranges

def _rules(row: DataFrame, rules: Sequence[tuple[str, str, str, Column]]) -> DataFrame:
    """``rule``, ``priority``, ``value`` of the rules that the one row of numbers breaks or meets.

    A rule is (name, priority, column of its number, condition).
    """
    entries = F.array(*[F.struct(F.coalesce(holds, F.lit(False)).alias("_ok"), F.lit(name).alias("rule"),
                                 F.lit(priority).alias("priority"), F.col(number).cast("double").alias("value"))
                        for name, priority, number, holds in rules])
    return row.select(F.inline(entries)).where("_ok").drop("_ok")


def weekly_report(daily: DataFrame, num_weeks: int = 4, *, subject_cols: Sequence[str] = ()) -> dict[str, DataFrame]:
    weeks = weekly.weekly_aggregates(daily, num_weeks, subject_cols=subject_cols)
    out = {"weeks": weeks, "summary": weekly.latest_week_summary(weeks, subject_cols=subject_cols)}
    sections = (("sleep_score", "sleep_score_avg", "sleep_score_count", False, False),
                ("resting_hr", "rhr_avg", "rhr_count", True, False),
                ("stress_minutes", "stress_minutes_total", "stress_minutes_count", True, True))
    for name, value, count, lower, whole in sections:
        if value in weeks.columns:
            out[name] = weekly.weekly_delta(weeks, value, count, lower_is_better=lower, whole=whole,
                                            subject_cols=subject_cols)
    return out


def trend_summary(daily: DataFrame, columns: Sequence[str] | None = None, *, threshold: float = 0.5,
                  max_pairs: int = 20) -> dict[str, DataFrame]:
    """Top correlations, most volatile columns and columns with most missing values."""
    pairs = stats.correlation_pairs(daily, columns)
    missing = quality.missing_summary(daily, columns).where(F.col("missing_pct") > 0).limit(10)
    return {"correlations": stats.top_correlations(pairs, threshold=threshold, limit=max_pairs),
            "volatility": stats.volatility(daily, columns), "missing": missing}


def full_report(
    daily: DataFrame, *, samples: DataFrame | None = None, monthly: bool = False, features: Sequence[str] = (),
    subject_cols: Sequence[str] = (), day: str = "day", **coverage,
) -> dict[str, DataFrame]:
    """Month filter, coverage filter, trend summary, anomalies and best ranges of one table.

    Best ranges are per subject; trends describe all rows together.
    """
    frame = last_full_month(daily, day=day, subject_cols=subject_cols) if monthly else daily
    if samples is not None:
        frame = filter_by_coverage(frame, samples, day=day, subject_cols=subject_cols, **coverage)
    out = {f"trend_{k}": v for k, v in trend_summary(frame).items()}
    if features:
        filled = impute(frame, list(features), "median").na.drop(subset=list(features))
        out["anomalies"] = isolation_forest(filled, [*subject_cols, day], features)
    if "score" in frame.columns and "steps" in frame.columns:
        out["best_ranges"] = optimal_ranges(frame, subject_cols=subject_cols)
    return out


def quality_report(
    df: DataFrame, *, samples: DataFrame | None = None, subject_cols: Sequence[str] = (), **coverage,
) -> dict[str, DataFrame]:
    """Everything about one table's quality, and its continuous days if samples are given."""
    out = {
        "profile": quality.dataset_profile(df), "completeness": quality.completeness(df),
        "domains": quality.column_domains(df), "outliers": quality.extreme_outliers(df),
        "duplicates": quality.duplicate_columns(df), "text": quality.text_issues(df),
        "suitability": quality.modeling_suitability(df),
    }
    out["recommendations"] = quality_recommendations(out)
    if samples is not None:
        days = qualifying_days(samples, subject_cols=subject_cols, **coverage)
        out["continuous_days"] = days
        out["continuous_day_count"] = days.agg(F.count("*").alias("days"))
    return out


def quality_recommendations(report: dict[str, DataFrame]) -> DataFrame:
    c, t = report["completeness"], report["text"]
    sparse = c.where(~F.col("adequate_for_analysis")).agg(F.count("*")).scalar()
    # duplicate pairs, outlier columns, time strings and mixed columns
    issues = (report["outliers"].agg(F.count("*")).scalar() + report["duplicates"].agg(F.count("*")).scalar()
              + t.agg(F.count_if("has_time_strings") + F.count_if("mixed_types")).scalar())
    suitable = report["suitability"].where("task = 'anomaly_detection'").agg(F.count("*")).scalar()
    row = c.agg(F.count("*").alias("_n")).select(sparse.alias("sparse"), issues.alias("issues"), suitable.alias("suitable"))
    return _rules(row, (
        ("sparse_columns", "high", "sparse", F.col("sparse") > 0),
        ("column_issues", "medium", "issues", F.col("issues") > 0),
        ("few_model_columns", "high", "suitable", F.col("suitable") < 5),
        ("enough_model_columns", "low", "suitable", F.col("suitable") >= 5),
    ))


def modeling_recommendations(
    *, features: DataFrame, detectors: DataFrame | None = None, clusterings: DataFrame | None = None,
    models: DataFrame | None = None,
) -> DataFrame:
    """Rules over feature statistics, ensemble rate, silhouette, R2 and the number of features."""
    def one(frame: DataFrame | None, what: Column, where: str | None = None) -> Column:
        if frame is None:
            return F.lit(None).cast("double")
        return (frame.where(where) if where else frame).agg(what).scalar()

    row = features.agg(F.count_if(F.col("missing_pct") > 30).alias("gappy"), F.count("*").alias("n")).select(
        "gappy", "n", one(detectors, F.max("anomaly_rate"), "detector = 'ensemble'").alias("rate"),
        one(clusterings, F.max("silhouette")).alias("silhouette"), one(models, F.max("test_r2")).alias("r2"))
    return _rules(row, (
        ("gappy_features", "medium", "gappy", F.col("gappy") > 0),
        ("anomalies_many", "high", "rate", F.col("rate") > 0.1),
        ("anomalies_few", "low", "rate", F.col("rate") < 0.01),
        ("clusters_overlap", "medium", "silhouette", F.col("silhouette") < 0.2),
        ("clusters_apart", "low", "silhouette", F.col("silhouette") > 0.6),
        ("prediction_weak", "medium", "r2", F.col("r2") < 0.3),
        ("prediction_good", "low", "r2", F.col("r2") > 0.7),
        ("many_features", "medium", "n", F.col("n") > 50),
    ))
