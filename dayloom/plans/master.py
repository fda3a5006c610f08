"""One row per subject and day out of all sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.operators.coverage import daily_coverage, valid_heart_rate
from dayloom.operators.daily import (
    daily_activity, daily_activity_detail, daily_stress, first_row_per_day, left_join_daily,
    missing_flags, normalize_day, prepare_sleep, rolling_mean, yesterday,
)


def build_master(
    tables: Mapping[str, DataFrame], *, subject_cols: Sequence[str] = (),
    max_gap_minutes: float = 2, edge_minutes: float = 2, calendar_lags: bool = False,
) -> DataFrame:
    """Join ``daily_summary`` with whichever other source tables are given.

    Sources: ``sleep``, ``stress``, ``resting_hr``, ``days_summary``,
    ``activities``, ``steps_activities``, ``monitoring_hr``.  Every source is
    reduced to one row per (subject, day) first, so all joins are one to one on
    the same key and share its partitioning.
    """
    keys = {"subject_cols": subject_cols}

    def by_day(df: DataFrame) -> DataFrame:
        return first_row_per_day(normalize_day(df), **keys)

    out = by_day(tables["daily_summary"])
    if "sleep" in tables:
        sleep = prepare_sleep(by_day(tables["sleep"]))
        out = left_join_daily(out, sleep, source="sleep", **keys)
    if "stress" in tables:
        out = left_join_daily(out, daily_stress(tables["stress"], ts="timestamp", **keys), source="stress", **keys)
    if "resting_hr" in tables:
        out = left_join_daily(out, by_day(tables["resting_hr"]), source="resting_hr", **keys)
    if "days_summary" in tables:
        out = left_join_daily(out, by_day(tables["days_summary"]), source="summary", as_suffix=True, **keys)
    if "activities" in tables:
        activities = tables["activities"]
        out = left_join_daily(out, daily_activity(activities, **keys), source="activities", **keys)
        if "steps_activities" in tables:
            detail = daily_activity_detail(tables["steps_activities"], activities, **keys)
            out = left_join_daily(out, detail, source="steps_activities", **keys)

    if "monitoring_hr" in tables and "heart_rate" in tables["monitoring_hr"].columns:
        cover = daily_coverage(
            tables["monitoring_hr"].where(valid_heart_rate()), ts="timestamp",
            max_gap_minutes=max_gap_minutes, edge_minutes=edge_minutes, **keys)
        out = left_join_daily(out, cover.drop("first_sample", "last_sample"), source="coverage", **keys)

    # windows come last: they need whole subjects together, the joins only (subject, day)
    out = yesterday(out, calendar=calendar_lags, **keys)
    if "steps" not in out.columns:
        out = out.withColumn("steps", F.lit(None).cast("double"))
    out = missing_flags(rolling_mean(out, "steps", 7, "steps_avg_7d", **keys))

    return out
