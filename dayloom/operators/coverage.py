"""How completely each day was recorded.

Two samples in the same ``max_gap``-wide slot of a day can not be further apart
than ``max_gap``.  So samples are first reduced, with map-side combine, to the
first and last sample of each slot; only those extents (at most ``1440 /
max_gap`` rows per subject and day) are ordered to find the gaps.  A subject or
day that holds a large part of all samples costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayloom.functions.temporal import MICROS_PER_DAY, MICROS_PER_MINUTE, micros_of_day

# Plausible heart rate, both ends included.
HEART_RATE_MIN, HEART_RATE_MAX = 20, 250


def valid_heart_rate(c: str = "heart_rate") -> Column:
    return F.col(c).isNotNull() & F.col(c).between(HEART_RATE_MIN, HEART_RATE_MAX)


def _micros(minutes: float) -> int:
    return int(round(minutes * MICROS_PER_MINUTE))


def clamp_coverage_args(allowance_minutes, max_gap_minutes, edge_minutes) -> tuple[int, int, int]:
    """Allowance 0..300, gap at least 1 (else 2), edge at least 0 (else 2)."""
    allowance = min(300, max(0, int(allowance_minutes or 0)))
    gap = int(max_gap_minutes) if max_gap_minutes is not None and max_gap_minutes >= 1 else 2
    edge = int(edge_minutes) if edge_minutes is not None and edge_minutes >= 0 else 2
    return allowance, gap, edge


def sample_extents(
    samples: DataFrame, *, ts: str = "ts", day: str = "day",
    subject_cols: Sequence[str] = (), max_gap_minutes: float = 2,
) -> DataFrame:
    """First and last sample (microseconds of day) and sample count per slot of each day."""
    width = max(_micros(max_gap_minutes), 1)
    return (
        samples.where(F.col(ts).isNotNull())
        .select(*subject_cols, F.to_date(ts).alias(day), micros_of_day(ts).alias("_us"))
        .withColumn("slot", F.floor(F.col("_us") / width))
        .groupBy(*subject_cols, day, "slot")
        .agg(F.min("_us").alias("first_us"), F.max("_us").alias("last_us"), F.count("_us").alias("samples"))
    )


def coverage_from_extents(
    extents: DataFrame, *, day: str = "day", subject_cols: Sequence[str] = (),
    max_gap_minutes: float = 2, edge_minutes: float = 2,
) -> DataFrame:
    gap, edge = _micros(max_gap_minutes), _micros(edge_minutes)
    in_day = Window.partitionBy(*subject_cols, day).orderBy("slot")
    step = F.col("first_us") - F.lag("last_us").over(in_day)
    days = (
        extents.withColumn("_gap", step)
        .groupBy(*subject_cols, day)
        .agg(
            F.min("first_us").alias("_first"),
            F.max("last_us").alias("_last"),
            F.count_if(F.col("_gap") > gap).alias("gap_count"),
            F.coalesce(F.sum(F.greatest(F.col("_gap") - gap, F.lit(0))), F.lit(0)).alias("_inner"),
        )
    )
    late = F.greatest(F.col("_first") - edge, F.lit(0))
    early = F.greatest(F.lit(MICROS_PER_DAY - edge) - F.col("_last"), F.lit(0))
    hours = (F.col("_last") - F.col("_first")) / (60 * MICROS_PER_MINUTE)

    def stamp(us: str) -> Column:
        return F.col(day).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col(us) / F.lit(1_000_000).cast("decimal(18,6)"))

    return days.select(
        *subject_cols, day,
        hours.alias("coverage_hours"),
        F.least(F.lit(100.0), hours / 24 * 100).alias("coverage_pct"),
        ((late == 0) & (early == 0) & (F.col("gap_count") == 0)).alias("has_24h_coverage"),
        stamp("_first").alias("first_sample"),
        stamp("_last").alias("last_sample"),
        "gap_count",
        ((F.col("_inner") + late + early) / MICROS_PER_MINUTE).alias("total_missing_minutes"),
    )


def daily_coverage(
    samples: DataFrame, *, ts: str = "ts", day: str = "day", subject_cols: Sequence[str] = (),
    max_gap_minutes: float = 2, edge_minutes: float = 2,
) -> DataFrame:
    """Hours, percent, gaps, missing minutes and the strict 24-hour flag of each day."""
    extents = sample_extents(
        samples, ts=ts, day=day, subject_cols=subject_cols, max_gap_minutes=max_gap_minutes)
    return coverage_from_extents(
        extents, day=day, subject_cols=subject_cols,
        max_gap_minutes=max_gap_minutes, edge_minutes=edge_minutes)


def qualifying_days(
    samples: DataFrame, *, ts: str = "ts", day: str = "day", subject_cols: Sequence[str] = (),
    max_gap_minutes: float = 2, edge_minutes: float = 2, allowance_minutes: float = 0,
) -> DataFrame:
    """Days whose missing time, inside and at the edges, stays within the allowance."""
    cover = daily_coverage(
        samples, ts=ts, day=day, subject_cols=subject_cols,
        max_gap_minutes=max_gap_minutes, edge_minutes=edge_minutes)
    missing = F.round(F.col("total_missing_minutes") * MICROS_PER_MINUTE)
    return cover.where(missing <= _micros(allowance_minutes)).select(*subject_cols, day)


def keep_days(daily: DataFrame, days: DataFrame, *, day: str = "day", subject_cols: Sequence[str] = ()) -> DataFrame:
    """Rows of a daily table whose (subject, day) is listed."""
    return daily.join(days.select(*subject_cols, day), [*subject_cols, day], "left_semi")


def filter_by_coverage(
    daily: DataFrame, samples: DataFrame, *, ts: str = "ts", heart_rate: str | None = "heart_rate",
    day: str = "day", subject_cols: Sequence[str] = (), max_gap_minutes: float = 2,
    edge_minutes: float = 2, allowance_minutes: float = 0, on_empty: str = "keep",
) -> DataFrame:
    """Daily rows on qualifying days of valid heart-rate samples.

    With ``on_empty="keep"`` a run in which no day qualifies returns all rows,
    which costs one probe job; ``"empty"`` returns none and stays lazy.
    """
    if on_empty not in ("keep", "empty"):
        raise ValueError(f"on_empty must be 'keep' or 'empty', not {on_empty!r}")
    valid = samples.where(valid_heart_rate(heart_rate)) if heart_rate else samples
    days = qualifying_days(
        valid, ts=ts, day=day, subject_cols=subject_cols, max_gap_minutes=max_gap_minutes,
        edge_minutes=edge_minutes, allowance_minutes=allowance_minutes)
    if on_empty == "keep" and days.isEmpty():
        return daily
    return keep_days(daily, days, day=day, subject_cols=subject_cols)


def monthly_coverage(cover: DataFrame, *, day: str = "day", subject_cols: Sequence[str] = ()) -> DataFrame:
    """Mean percent, full days, all days and the share of full days per month."""
    return (
        cover.groupBy(*subject_cols, F.year(day).alias("year"), F.month(day).alias("month"))
        .agg(
            F.avg("coverage_pct").alias("mean_coverage_pct"),
            F.count_if("has_24h_coverage").alias("days_24h"),
            F.count("*").alias("total_days"),
        )
        .withColumn("pct_24h", F.bround(F.col("days_24h") / F.col("total_days") * 100, 1))
    )


def coverage_totals(cover: DataFrame) -> DataFrame:
    """One row over all days with a known percentage."""
    return cover.where(F.col("coverage_pct").isNotNull()).agg(
        F.count("*").alias("valid_days"),
        F.avg("coverage_pct").alias("mean_coverage_pct"),
        F.count_if("has_24h_coverage").alias("days_24h"),
        (F.count_if("has_24h_coverage") / F.count("*") * 100).alias("pct_24h"),
    )


def worn_label(columns: Sequence[str]) -> Column:
    """Worn / not worn from the 24-hour flag where the table has it, else from the percentage."""
    if "has_24h_coverage" in columns:
        worn = F.coalesce(F.col("has_24h_coverage"), F.lit(False))
    elif "coverage_pct" in columns:
        worn = F.coalesce(F.col("coverage_pct") >= 80, F.lit(False))
    else:
        raise ValueError("needs has_24h_coverage or coverage_pct")
    return F.when(worn, "worn").otherwise("not_worn")
