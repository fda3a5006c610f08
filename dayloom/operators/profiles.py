"""Weekday and hour-of-day profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dayloom.functions.quantiles import quantiles
from dayloom.functions.temporal import WEEKDAYS, period_of_day, weekday_name, weekday_number

# Metric name and the daily column it is taken from.
WEEKDAY_METRICS = {
    "sleep_score": "score",
    "body_battery_max": "bb_max",
    "body_battery_min": "bb_min",
    "water_intake": "hydration_intake",
}


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, cond, "left").drop(*[f"_r_{k}" for k in keys])


def with_median(df: DataFrame, keys: Sequence[str], value: str, stats: DataFrame, *, mode: str = "exact",
                few_groups: bool = True) -> DataFrame:
    """Add the exact median of each group to a frame of per-group statistics."""
    q = quantiles(df, keys, value, [0.5], mode=mode, few_groups=few_groups)
    return _null_safe_join(stats, q.select(*keys, F.col("q")[0].alias("median")), keys)


def weekday_profile(
    daily: DataFrame, metrics: Mapping[str, str] = WEEKDAY_METRICS, *, day: str = "day",
    subject_cols: Sequence[str] = (), mode: str = "exact",
) -> DataFrame:
    """Mean, median, deviation and count per metric and weekday.

    The days are made once for all metrics; moments come from the counters of the medians.
    """
    present = {m: c for m, c in metrics.items() if c in daily.columns}
    wide = daily.select(
        *subject_cols, weekday_name(day).alias("day_of_week"), weekday_number(day).alias("day_of_week_num"),
        *[F.col(c).cast("double").alias(m) for m, c in present.items()])
    keys = [*subject_cols, "metric", "day_of_week", "day_of_week_num"]
    long = wide.unpivot(
        [*subject_cols, "day_of_week", "day_of_week_num"], list(present), "metric", "value",
    ).where(F.col("value").isNotNull())
    out = quantiles(long, keys, "value", [0.5], mode=mode, few_groups=not subject_cols, moments=True, store=True)
    out = out.withColumns({"median": F.col("q")[0], "count": F.col("n")})
    source = F.element_at(F.create_map(*[F.lit(x) for kv in present.items() for x in kv]), F.col("metric"))
    return out.select(*subject_cols, "metric", source.alias("column"), "day_of_week", "day_of_week_num",
                      "mean", "median", "std", "count")


def weekday_insight(profile: DataFrame, *, keys: Sequence[str] = ("metric",), mean: str = "mean") -> DataFrame:
    """Best and worst day, their difference, variation, and the weekend effect in percent."""
    order = F.struct(F.col(mean), -F.col("day_of_week_num"))
    low_order = F.struct(F.col(mean), F.col("day_of_week_num"))
    weekend = F.col("day_of_week_num").isin(0, 6)
    return (
        profile.groupBy(*keys).agg(
            F.max_by("day_of_week", order).alias("best_day"), F.max(mean).alias("best_mean"),
            F.min_by("day_of_week", low_order).alias("worst_day"), F.min(mean).alias("worst_mean"),
            (F.stddev_samp(mean) / F.avg(mean) * 100).alias("cv_pct"),
            F.avg(F.when(weekend, F.col(mean))).alias("weekend_mean"),
            F.avg(F.when(~weekend, F.col(mean))).alias("weekday_mean"))
        .withColumn("difference", F.col("best_mean") - F.col("worst_mean"))
        .withColumn("weekend_effect_pct",
                    (F.col("weekend_mean") - F.col("weekday_mean")) / F.col("weekday_mean") * 100)
    )


def weekday_minmax(profile: DataFrame, *, keys: Sequence[str] = ("metric",)) -> DataFrame:
    """Weekday means scaled to 0-100 within a metric; 50 if all are equal."""
    w = Window.partitionBy(*keys)      # seven rows per metric
    low, high = F.min("mean").over(w), F.max("mean").over(w)
    return profile.withColumn(
        "normalized", F.when(high > low, (F.col("mean") - low) / (high - low) * 100).otherwise(F.lit(50.0)))


def hourly_profile(
    samples: DataFrame, *, ts: str = "ts", value: str = "stress", subject_cols: Sequence[str] = (), mode: str = "exact",
) -> DataFrame:
    """Statistics per hour of day with a 95 % interval of the mean."""
    keys = [*subject_cols, "hour"]
    rows = samples.where(F.col(ts).isNotNull()).select(
        *subject_cols, F.hour(ts).alias("hour"), F.col(value).cast("double").alias("_x"))
    stats = rows.groupBy(*keys).agg(
        F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("std"), F.min("_x").alias("min"),
        F.max("_x").alias("max"), F.count("_x").alias("count"))
    out = with_median(rows, keys, "_x", stats, mode=mode, few_groups=not subject_cols)
    # Fixed value: 1.96 standard errors.
    margin = F.coalesce(1.96 * F.col("std") / F.sqrt(F.when(F.col("count") > 0, F.col("count"))), F.lit(0.0))
    return out.select(*keys, "mean", "median", "std", "min", "max", "count",
                      (F.col("mean") - margin).alias("ci_lower"), (F.col("mean") + margin).alias("ci_upper"))


def hour_weekday_profile(
    samples: DataFrame, *, ts: str = "ts", value: str = "stress", subject_cols: Sequence[str] = (),
) -> DataFrame:
    return (
        samples.where(F.col(ts).isNotNull())
        .groupBy(*subject_cols, F.hour(ts).alias("hour"), weekday_name(ts).alias("day_of_week"),
                 weekday_number(ts).alias("day_of_week_num"))
        .agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("count"))
    )


def weekday_of_hours(hour_weekday: DataFrame, *, subject_cols: Sequence[str] = ()) -> DataFrame:
    """Unweighted weekday mean of the hourly means."""
    return hour_weekday.groupBy(*subject_cols, "day_of_week", "day_of_week_num").agg(F.avg("mean").alias("mean"))


def overall_of_hours(hourly: DataFrame, *, subject_cols: Sequence[str] = ()) -> DataFrame:
    """Sample count, mean of hourly means, mean of hourly deviations, variation of the means."""
    return hourly.groupBy(*subject_cols).agg(
        F.sum("count").alias("samples"), F.avg("mean").alias("mean_of_means"), F.avg("std").alias("mean_of_stds"),
        (F.stddev_samp("mean") / F.avg("mean") * 100).alias("cv_pct"))


def peak_hours(hourly: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` highest and the ``n`` lowest hours by mean."""
    high = hourly.orderBy(F.desc("mean"), "hour").limit(n).withColumn("kind", F.lit("highest"))
    low = hourly.orderBy("mean", "hour").limit(n).withColumn("kind", F.lit("lowest"))
    return high.unionByName(low).select("kind", "hour", "mean", "std", "count")


def period_profile(hourly: DataFrame, *, subject_cols: Sequence[str] = ()) -> DataFrame:
    """Morning, afternoon, evening and night out of the hourly profile."""
    return (
        hourly.withColumn("period", period_of_day("hour")).groupBy(*subject_cols, "period")
        .agg(F.avg("mean").alias("mean"), F.avg("median").alias("median"), F.avg("std").alias("std"),
             F.min("mean").alias("min"), F.max("mean").alias("max"))
    )


def period_extremes(periods: DataFrame, *, subject_cols: Sequence[str] = ()) -> DataFrame:
    return periods.groupBy(*subject_cols).agg(
        F.min_by("period", F.struct("mean", "period")).alias("lowest_period"), F.min("mean").alias("lowest_mean"),
        F.max_by("period", F.struct("mean", "period")).alias("highest_period"), F.max("mean").alias("highest_mean"))


def pivot_weekdays(profile: DataFrame, index: Sequence[str], value: str = "mean") -> DataFrame:
    """One column per weekday, Sunday first."""
    wide = profile.groupBy(*index).pivot("day_of_week", list(WEEKDAYS)).agg(F.first(value))
    return wide.select(*index, *WEEKDAYS)


def pivot_months(df: DataFrame, value: str, *, day: str = "day") -> DataFrame:
    """Mean per year and month, one column per month."""
    wide = (
        df.select(F.year(day).alias("year"), F.month(day).alias("_m"), F.col(value).alias("_v"))
        .groupBy("year").pivot("_m", list(range(1, 13))).agg(F.avg("_v"))
    )
    return wide.withColumnsRenamed({str(m): f"m{m:02d}" for m in range(1, 13)})
