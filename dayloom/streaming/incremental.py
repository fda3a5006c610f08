"""Daily stress, daily coverage and hourly moments from a stream of samples.

Each works in append mode: a day or hour is emitted once the watermark has
passed its end.  Samples later than the watermark are dropped; rebuilding the
day from the stored samples in batch repairs it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dayloom.functions.temporal import MICROS_PER_DAY, MICROS_PER_MINUTE, micros_of_day
from dayloom.operators.coverage import coverage_from_extents


def with_event_time(samples: DataFrame, ts: str = "ts", *, delay: str = "1 day") -> DataFrame:
    """Watermark needs TIMESTAMP; wall-clock stamps are read in the session zone, which has to be UTC."""
    return samples.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def daily_stress_stream(samples: DataFrame, *, ts: str = "ts", value: str = "stress", subject_cols: Sequence[str] = (),
                        delay: str = "1 day") -> DataFrame:
    return (
        with_event_time(samples, ts, delay=delay)
        .groupBy(*subject_cols, F.window(ts, "1 day").alias("_w"))
        .agg(F.avg(value).alias("stress_avg"), F.max(value).alias("stress_max"),
             F.count_if(F.col(value) > 0).alias("stress_duration"))
        .select(*subject_cols, F.to_date("_w.start").alias("day"), "stress_avg", "stress_max", "stress_duration")
    )


def extents_stream(samples: DataFrame, *, ts: str = "ts", subject_cols: Sequence[str] = (), max_gap_minutes: float = 2,
                   delay: str = "1 day") -> DataFrame:
    """First and last sample per slot of a day.

    The state of an open day is one row per slot, at most ``1440 / max_gap``,
    however many samples arrive.
    """
    width = max(int(round(max_gap_minutes * MICROS_PER_MINUTE)), 1)
    us = micros_of_day(ts)
    return (
        with_event_time(samples, ts, delay=delay).withColumn("_us", us)
        .groupBy(*subject_cols, F.window(ts, "1 day").alias("_w"), F.floor(F.col("_us") / width).alias("slot"))
        .agg(F.min("_us").alias("first_us"), F.max("_us").alias("last_us"), F.count("_us").alias("samples"))
        .select(*subject_cols, F.to_date("_w.start").alias("day"), "slot", "first_us", "last_us", "samples", "_w")
    )


def daily_coverage_stream(samples: DataFrame, *, ts: str = "ts", subject_cols: Sequence[str] = (),
                          max_gap_minutes: float = 2, edge_minutes: float = 2, delay: str = "1 day") -> DataFrame:
    """Daily coverage: slots first, then the slots of a day in order."""
    gap = int(round(max_gap_minutes * MICROS_PER_MINUTE))
    edge = int(round(edge_minutes * MICROS_PER_MINUTE))
    slots = F.array_sort(F.collect_list(F.struct("slot", "first_us", "last_us")))     # at most 1440 / max_gap
    days = (
        extents_stream(samples, ts=ts, subject_cols=subject_cols, max_gap_minutes=max_gap_minutes, delay=delay)
        .groupBy(*subject_cols, F.window("_w", "1 day").alias("_day"))
        .agg(slots.alias("_s"))
    )
    steps = F.zip_with(F.slice("_s", 2, F.size("_s")), F.slice("_s", 1, F.size("_s") - 1),
                       lambda b, a: b["first_us"] - a["last_us"])
    first, last = F.col("_s")[0]["first_us"], F.element_at("_s", -1)["last_us"]
    late = F.greatest(first - edge, F.lit(0))
    early = F.greatest(F.lit(MICROS_PER_DAY - edge) - last, F.lit(0))
    hours = (last - first) / (60 * MICROS_PER_MINUTE)
    inner = F.aggregate("_gaps", F.lit(0).cast("bigint"), lambda acc, g: acc + F.greatest(g - gap, F.lit(0)))
    return (
        days.withColumn("_gaps", F.filter(steps, lambda g: g.isNotNull()))
        .select(
            *subject_cols, F.to_date("_day.start").alias("day"), hours.alias("coverage_hours"),
            F.least(F.lit(100.0), hours / 24 * 100).alias("coverage_pct"),
            F.size(F.filter("_gaps", lambda g: g > gap)).cast("long").alias("gap_count"),
            ((inner + late + early) / MICROS_PER_MINUTE).alias("total_missing_minutes"),
            late.alias("_late"), early.alias("_early"))
        .withColumn("has_24h_coverage", (F.col("_late") == 0) & (F.col("_early") == 0) & (F.col("gap_count") == 0))
        .drop("_late", "_early")
    )


def hourly_moments_stream(samples: DataFrame, *, ts: str = "ts", value: str = "stress",
                          subject_cols: Sequence[str] = (), delay: str = "1 day") -> DataFrame:
    """Count, mean, sum of squared distances from the mean and extremes per hour of the calendar."""
    x = F.col(value)
    return (
        with_event_time(samples, ts, delay=delay)
        .groupBy(*subject_cols, F.window(ts, "1 hour").alias("_w"))
        .agg(F.count(x).alias("n"), F.avg(x).alias("center"), (F.var_pop(x) * F.count(x)).alias("spread"),
             F.min(x).alias("low"), F.max(x).alias("high"))
        .select(*subject_cols, F.col("_w.start").alias("hour_start"), "n", "center", "spread", "low", "high")
    )


def hourly_profile_from_moments(moments: DataFrame, *, subject_cols: Sequence[str] = ()) -> DataFrame:
    """Hour-of-day statistics out of stored moments; the median needs the samples and stays in batch."""
    # spreads about the means of single hours are moved to the common mean: no difference of large squares
    keys = [*subject_cols, "hour"]
    together = Window.partitionBy(*keys)        # one row per hour of the calendar
    rows = moments.where("n > 0").withColumn("hour", F.hour("hour_start"))
    rows = rows.withColumn("_mean", F.sum(F.col("center") * F.col("n")).over(together) / F.sum("n").over(together))
    moved = F.sum(F.col("spread") + F.col("n") * (F.col("center") - F.col("_mean")) ** 2)
    n = F.sum("n")
    return rows.groupBy(*keys).agg(
        F.max("_mean").alias("mean"), F.sqrt(moved / F.when(n > 1, n - 1)).alias("std"),
        F.min("low").alias("min"), F.max("high").alias("max"), n.alias("count"))


def run_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what has arrived and stop; the Parquet sink and the checkpoint make restarts exactly-once."""
    query = (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return query


__all__ = ["coverage_from_extents", "daily_coverage_stream", "daily_stress_stream", "extents_stream",
           "hourly_moments_stream", "hourly_profile_from_moments", "run_available", "with_event_time"]
