"""Days of subjects who live in different time zones, some of 23 or 25 hours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dayloom.functions.temporal import MICROS_PER_MINUTE
from dayloom.operators.daily import first_row_per_day


def local_days(samples: DataFrame, *, ts: str = "ts", zone: str = "zone", day: str = "day") -> DataFrame:
    """``day`` of each UTC instant in its row's zone, ``day_start`` (the instant it begins) and ``day_minutes`` (its real length).

    Rows without an instant or zone have no day.  The session time zone has to be UTC.
    """
    samples = samples.withColumn(ts, F.col(ts).cast("timestamp"))
    out = samples.withColumn(day, F.to_date(F.from_utc_timestamp(F.col(ts), F.col(zone))))
    start = F.to_utc_timestamp(F.col(day).cast("timestamp"), F.col(zone))
    end = F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), F.col(zone))
    length = (F.unix_micros(end) - F.unix_micros(start)) / MICROS_PER_MINUTE
    return out.withColumns({"day_start": start, "day_minutes": length})


def zoned_coverage(
    samples: DataFrame, *, ts: str = "ts", zone: str = "zone", day: str = "day", subject_cols: Sequence[str] = (),
    max_gap_minutes: float = 2, edge_minutes: float = 2,
) -> DataFrame:
    """Coverage of each local day against its real length.

    As in ``operators/coverage.py`` samples are first reduced, with map-side
    combine, to the first and last of each slot of a day; slots count from the
    real beginning of the day, so a changed clock makes or hides no gap.
    """
    gap, edge = int(round(max_gap_minutes * MICROS_PER_MINUTE)), int(round(edge_minutes * MICROS_PER_MINUTE))
    keys = [*subject_cols, zone, day]
    rows = local_days(samples, ts=ts, zone=zone, day=day).where(F.col(day).isNotNull()).select(
        *keys, "day_minutes", (F.unix_micros(F.col(ts)) - F.unix_micros("day_start")).alias("_us"))
    extents = rows.groupBy(*keys, "day_minutes", F.floor(F.col("_us") / max(gap, 1)).alias("_slot")).agg(
        F.min("_us").alias("_first"), F.max("_us").alias("_last"))
    in_day = Window.partitionBy(*keys).orderBy("_slot")
    days = extents.withColumn("_gap", F.col("_first") - F.lag("_last").over(in_day)).groupBy(*keys, "day_minutes").agg(
        F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.count_if(F.col("_gap") > gap).alias("gap_count"),
        F.coalesce(F.sum(F.greatest(F.col("_gap") - gap, F.lit(0))), F.lit(0)).alias("_inner"))
    whole = F.col("day_minutes") * MICROS_PER_MINUTE
    late, early = F.greatest(F.col("_first") - edge, F.lit(0)), F.greatest(whole - edge - F.col("_last"), F.lit(0.0))
    covered = (F.col("_last") - F.col("_first")) / MICROS_PER_MINUTE
    return days.select(
        *keys, (F.col("day_minutes") / 60).alias("day_hours"), (covered / 60).alias("coverage_hours"),
        F.least(F.lit(100.0), covered / F.col("day_minutes") * 100).alias("coverage_pct"),
        ((late == 0) & (early == 0) & (F.col("gap_count") == 0)).alias("has_full_coverage"), "gap_count",
        ((F.col("_inner") + late + early) / MICROS_PER_MINUTE).alias("total_missing_minutes"))


def first_per_local_day(df: DataFrame, *, ts: str, zone: str = "zone", subject_cols: Sequence[str] = ()) -> DataFrame:
    """Parsed, without rows that have no instant or zone, first row of each subject and local day."""
    parsed = local_days(df.withColumn(ts, F.col(ts).try_cast("timestamp")), ts=ts, zone=zone)
    return first_row_per_day(parsed.where(F.col("day").isNotNull()), subject_cols=subject_cols, tie_break=[ts])
