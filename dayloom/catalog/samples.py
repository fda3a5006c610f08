"""Queries on samples: coverage, daily stress, hour profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayloom.catalog import inputs
from dayloom.catalog.base import Query
from dayloom.operators import coverage, daily, profiles
from dayloom.functions.quantiles import quantiles

SUBJECT = ("subject",)


def coverage_sql(subject: bool, gap: int, edge: int, source: str = "samples", ts: str = "ts") -> str:
    keys = "subject, " if subject else ""
    return f"""valid AS (SELECT {keys}"{ts}" AS ts FROM {source} WHERE heart_rate BETWEEN 20 AND 250),
gaps AS (
  SELECT {keys}ts, CAST(ts AS DATE) AS day,
    epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY {keys}CAST(ts AS DATE) ORDER BY ts)) AS gap FROM valid),
ends AS (
  SELECT {keys}day, min(ts) AS first_sample, max(ts) AS last_sample,
    count(CASE WHEN gap > {gap}::BIGINT * 60000000 THEN 1 END) AS gap_count,
    coalesce(sum(greatest(gap - {gap}::BIGINT * 60000000, 0)), 0)::BIGINT AS inner_us,
    greatest(epoch_us(min(ts)) - epoch_us(day::TIMESTAMP) - {edge}::BIGINT * 60000000, 0) AS late,
    greatest(epoch_us(day::TIMESTAMP) + 86400000000 - {edge}::BIGINT * 60000000 - epoch_us(max(ts)), 0) AS early
  FROM gaps GROUP BY {keys}day),
cover AS (
  SELECT {keys}day, (epoch_us(last_sample) - epoch_us(first_sample)) / 3600000000.0::DOUBLE AS coverage_hours,
    least(100.0::DOUBLE, (epoch_us(last_sample) - epoch_us(first_sample)) / 3600000000.0::DOUBLE / 24 * 100) AS coverage_pct,
    late = 0 AND early = 0 AND gap_count = 0 AS has_24h_coverage, first_sample, last_sample, gap_count,
    (inner_us + late + early) / 60000000.0::DOUBLE AS total_missing_minutes
  FROM ends)"""


def valid_samples(spark, sf):
    return inputs.samples(spark, sf).where(coverage.valid_heart_rate())


def daily_coverage(spark, sf):
    return coverage.daily_coverage(valid_samples(spark, sf), max_gap_minutes=20, edge_minutes=10)


def subject_coverage(spark, sf):
    return coverage.daily_coverage(
        valid_samples(spark, sf), subject_cols=SUBJECT, max_gap_minutes=240, edge_minutes=120)


def qualifying(spark, sf):
    return coverage.qualifying_days(
        valid_samples(spark, sf), max_gap_minutes=20, edge_minutes=10, allowance_minutes=30)


def filtered_daily(spark, sf):
    samples = inputs.samples(spark, sf)
    stress = daily.daily_stress(samples, subject_cols=SUBJECT)
    return coverage.filter_by_coverage(
        stress, samples, subject_cols=SUBJECT, max_gap_minutes=240, edge_minutes=120, allowance_minutes=300)


def stress_per_hour(spark, sf):
    return profiles.hourly_profile(inputs.samples(spark, sf))


def hour_weekday(spark, sf):
    return profiles.hour_weekday_profile(inputs.samples(spark, sf))


HOURLY_SQL = f"""{inputs.SAMPLES_SQL},
stats AS (
  SELECT hour(ts) AS hour, avg(stress) AS mean, quantile_cont(stress, 0.5) AS median, stddev_samp(stress) AS std,
    min(stress) AS min, max(stress) AS max, count(stress) AS count FROM samples GROUP BY 1),
hourly AS (
  SELECT *, mean - coalesce(1.96::DOUBLE * std / sqrt(count), 0) AS ci_lower,
    mean + coalesce(1.96::DOUBLE * std / sqrt(count), 0) AS ci_upper FROM stats)"""

DOW = ("CASE dayofweek({0}) WHEN 0 THEN 'Sunday' WHEN 1 THEN 'Monday' WHEN 2 THEN 'Tuesday' WHEN 3 THEN 'Wednesday' "
       "WHEN 4 THEN 'Thursday' WHEN 5 THEN 'Friday' ELSE 'Saturday' END")
HOUR_WEEKDAY_SQL = f"""{inputs.SAMPLES_SQL},
hour_weekday AS (
  SELECT hour(ts) AS hour, {DOW.format('ts')} AS day_of_week, dayofweek(ts) AS day_of_week_num,
    avg(stress) AS mean, stddev_samp(stress) AS std, count(stress) AS count FROM samples GROUP BY 1, 2, 3)"""
PERIODS_SQL = f"""{HOURLY_SQL},
periods AS (
  SELECT CASE WHEN hour BETWEEN 6 AND 11 THEN 'morning' WHEN hour BETWEEN 12 AND 17 THEN 'afternoon'
    WHEN hour BETWEEN 18 AND 22 THEN 'evening' ELSE 'night' END AS period,
    avg(mean) AS mean, avg(median) AS median, avg(std) AS std, min(mean) AS min, max(mean) AS max
  FROM hourly GROUP BY 1)"""
COVER_ALL = f"WITH {inputs.SAMPLES_SQL}, {coverage_sql(False, 20, 10)}"
COVER_SUBJECT = f"WITH {inputs.SAMPLES_SQL}, {coverage_sql(True, 240, 120)}"
STATS = ("mean", "std")
COVER_DOUBLES = ("coverage_hours", "coverage_pct", "total_missing_minutes")

QUERIES = [
    Query("daily_coverage", daily_coverage, f"{COVER_ALL} SELECT * FROM cover", COVER_DOUBLES),
    Query("subject_coverage", subject_coverage, f"{COVER_SUBJECT} SELECT * FROM cover", COVER_DOUBLES),
    Query("qualifying_days", qualifying,
          f"{COVER_ALL} SELECT day FROM cover WHERE round(total_missing_minutes * 60000000) <= 30::BIGINT * 60000000"),
    Query("coverage_filter", filtered_daily,
          f"""{COVER_SUBJECT}, stress_daily AS (
  SELECT subject, CAST(ts AS DATE) AS day, avg(stress) AS stress_avg, max(stress) AS stress_max,
    count(CASE WHEN stress > 0 THEN 1 END) AS stress_duration FROM samples GROUP BY 1, 2),
good AS (SELECT subject, day FROM cover WHERE round(total_missing_minutes * 60000000) <= 300::BIGINT * 60000000)
SELECT * FROM stress_daily WHERE (subject, day) IN (SELECT (subject, day) FROM good)
  OR NOT EXISTS (SELECT 1 FROM good)""", ("stress_avg",)),
    Query("monthly_coverage", lambda s, d: coverage.monthly_coverage(subject_coverage(s, d), subject_cols=SUBJECT),
          f"""{COVER_SUBJECT} SELECT subject, year(day) AS year, month(day) AS month, avg(coverage_pct) AS mean_coverage_pct,
  count(CASE WHEN has_24h_coverage THEN 1 END) AS days_24h, count(*) AS total_days,
  round_even(count(CASE WHEN has_24h_coverage THEN 1 END) * 100.0::DOUBLE / count(*), 1) AS pct_24h
FROM cover GROUP BY 1, 2, 3""", ("mean_coverage_pct", "pct_24h")),
    Query("coverage_totals", lambda s, d: coverage.coverage_totals(daily_coverage(s, d)),
          f"""{COVER_ALL} SELECT count(*) AS valid_days, avg(coverage_pct) AS mean_coverage_pct,
  count(CASE WHEN has_24h_coverage THEN 1 END) AS days_24h,
  count(CASE WHEN has_24h_coverage THEN 1 END) * 100.0::DOUBLE / count(*) AS pct_24h FROM cover""",
          ("mean_coverage_pct", "pct_24h")),
    Query("worn_days",
          lambda s, d: subject_coverage(s, d).drop("has_24h_coverage").withColumn(
              "worn", coverage.worn_label(["coverage_pct"])).groupBy("worn").agg(
                  F.count("*").alias("days"), F.avg("gap_count").alias("mean_gaps")),
          f"""{COVER_SUBJECT} SELECT CASE WHEN coverage_pct >= 80 THEN 'worn' ELSE 'not_worn' END AS worn,
  count(*) AS days, avg(gap_count) AS mean_gaps FROM cover GROUP BY 1""", ("mean_gaps",)),
    Query("daily_stress", lambda s, d: daily.daily_stress(inputs.samples(s, d), subject_cols=SUBJECT),
          f"""WITH {inputs.SAMPLES_SQL} SELECT subject, CAST(ts AS DATE) AS day, avg(stress) AS stress_avg,
  max(stress) AS stress_max, count(CASE WHEN stress > 0 THEN 1 END) AS stress_duration FROM samples GROUP BY 1, 2""",
          ("stress_avg",)),
    Query("valid_heart_rate", lambda s, d: valid_samples(s, d).groupBy("subject").agg(
        F.count("*").alias("n"), F.min("heart_rate").alias("low"), F.max("heart_rate").alias("high")),
          f"""WITH {inputs.SAMPLES_SQL} SELECT subject, count(*) AS n, min(heart_rate) AS low, max(heart_rate) AS high
FROM samples WHERE heart_rate BETWEEN 20 AND 250 GROUP BY 1"""),
    Query("hourly_profile", stress_per_hour, f"WITH {HOURLY_SQL} SELECT * FROM hourly",
          ("mean", "median", "std", "ci_lower", "ci_upper")),
    Query("hour_weekday", hour_weekday, f"WITH {HOUR_WEEKDAY_SQL} SELECT * FROM hour_weekday", STATS),
    Query("weekday_of_hours", lambda s, d: profiles.weekday_of_hours(hour_weekday(s, d)),
          f"""WITH {HOUR_WEEKDAY_SQL} SELECT day_of_week, day_of_week_num, avg(mean) AS mean FROM hour_weekday
GROUP BY 1, 2""", ("mean",)),
    Query("hour_overall", lambda s, d: profiles.overall_of_hours(stress_per_hour(s, d)),
          f"""WITH {HOURLY_SQL} SELECT CAST(sum(count) AS BIGINT) AS samples, avg(mean) AS mean_of_means,
  avg(std) AS mean_of_stds, stddev_samp(mean) / avg(mean) * 100 AS cv_pct FROM hourly""",
          ("mean_of_means", "mean_of_stds", "cv_pct")),
    Query("peak_hours", lambda s, d: profiles.peak_hours(stress_per_hour(s, d)),
          f"""WITH {HOURLY_SQL} SELECT * FROM (SELECT 'highest' AS kind, hour, mean, std, count FROM hourly
  ORDER BY mean DESC, hour LIMIT 5) UNION ALL SELECT * FROM (SELECT 'lowest' AS kind, hour, mean, std, count FROM hourly
  ORDER BY mean, hour LIMIT 5)""", STATS),
    Query("period_of_day", lambda s, d: profiles.period_profile(stress_per_hour(s, d)),
          f"WITH {PERIODS_SQL} SELECT * FROM periods", ("mean", "median", "std", "min", "max")),
    Query("period_extremes",
          lambda s, d: profiles.period_extremes(profiles.period_profile(stress_per_hour(s, d))),
          f"""WITH {PERIODS_SQL} SELECT arg_min(period, mean) AS lowest_period, min(mean) AS lowest_mean,
  arg_max(period, mean) AS highest_period, max(mean) AS highest_mean FROM periods""", ("lowest_mean", "highest_mean")),
    Query("hour_weekday_pivot", lambda s, d: profiles.pivot_weekdays(hour_weekday(s, d), ["hour"]),
          f"""WITH {HOUR_WEEKDAY_SQL} SELECT hour, """ + ", ".join(
              f"max(CASE WHEN day_of_week = '{n}' THEN mean END) AS {n}" for n in profiles.WEEKDAYS)
          + " FROM hour_weekday GROUP BY 1", profiles.WEEKDAYS),
    Query("weekday_hour_insight",
          lambda s, d: profiles.weekday_insight(
              profiles.weekday_of_hours(hour_weekday(s, d)).withColumn("metric", F.lit("stress"))),
          f"""WITH {HOUR_WEEKDAY_SQL}, w AS (
  SELECT day_of_week, day_of_week_num, avg(mean) AS mean FROM hour_weekday GROUP BY 1, 2),
v AS (SELECT 'stress' AS metric, arg_max(day_of_week, mean) AS best_day, max(mean) AS best_mean,
  arg_min(day_of_week, mean) AS worst_day, min(mean) AS worst_mean, stddev_samp(mean) / avg(mean) * 100 AS cv_pct,
  avg(CASE WHEN day_of_week_num IN (0, 6) THEN mean END) AS weekend_mean,
  avg(CASE WHEN day_of_week_num NOT IN (0, 6) THEN mean END) AS weekday_mean FROM w)
SELECT *, best_mean - worst_mean AS difference, (weekend_mean - weekday_mean) / weekday_mean * 100 AS weekend_effect_pct
FROM v""", ("best_mean", "worst_mean", "cv_pct", "weekend_mean", "weekday_mean", "difference", "weekend_effect_pct")),
    Query("exact_quantiles",
          lambda s, d: quantiles(inputs.samples(s, d), ["kind"], "stress", [0.05, 0.25, 0.5, 0.75, 0.95], mode="exact",
                                 few_groups=True).select("kind", "n", *[F.col("q")[i].alias(f"q{p:02d}") for i, p in
                                                                        enumerate((5, 25, 50, 75, 95))]),
          f"""WITH {inputs.SAMPLES_SQL} SELECT kind, count(*) AS n, """ + ", ".join(
              f"quantile_cont(stress, {p / 100}) AS q{p:02d}" for p in (5, 25, 50, 75, 95))
          + " FROM samples GROUP BY 1", ("q05", "q25", "q50", "q75", "q95")),
]
