"""Queries on daily tables: master, weeks, weekdays, windows, ranges, sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayloom.catalog import inputs
from dayloom.catalog.base import Query, table
from dayloom.catalog.samples import DOW, coverage_sql
from dayloom.operators import activity, daily, impute, prep, profiles, quality, ranges, stats, weekly
from dayloom.plans.master import build_master
from dayloom.sources import sinks
from dayloom.sources.tables import mapping_from

SUBJECT = ("subject",)
ONE, MANY = f"WITH {inputs.DAILY_SQL}", f"WITH {inputs.SUBJECT_DAILY_SQL}"
SESSIONS = f"WITH {inputs.SESSIONS_SQL}"

MINUTES = """CASE
    WHEN regexp_full_match(trim({0}), '[+-]?\\d+\\s*:\\s*[+-]?\\d+\\s*:\\s*[+-]?\\d+') THEN
      CAST(split_part(trim({0}), ':', 1) AS BIGINT) * 60 + CAST(split_part(trim({0}), ':', 2) AS BIGINT)
      + CAST(split_part(trim({0}), ':', 3) AS BIGINT) / 60.0::DOUBLE
    WHEN regexp_full_match(trim({0}), '[+-]?\\d+\\s*:\\s*[+-]?\\d+') THEN
      CAST(split_part(trim({0}), ':', 1) AS BIGINT) + CAST(split_part(trim({0}), ':', 2) AS BIGINT) / 60.0::DOUBLE
    WHEN strpos({0}, ':') = 0 AND isfinite(TRY_CAST(trim({0}) AS DOUBLE)) THEN TRY_CAST(trim({0}) AS DOUBLE) END"""

ACTIVITY_DAILY_SQL = f"""activity_daily AS (
  SELECT {{0}} CAST(start_time AS DATE) AS day, 1::BIGINT AS had_workout, count(activity_id) AS activity_count,
    coalesce(sum({MINUTES.format('elapsed_time')}), 0) AS activity_minutes,
    coalesce(sum(calories), 0) AS activity_calories, avg(training_effect) AS training_effect,
    avg(anaerobic_training_effect) AS anaerobic_te FROM sessions GROUP BY {{1}})"""

def master_sql(sources: str, s: str = "") -> str:
    """The master table; ``s`` is "subject, " for many subjects."""
    g, by = ("1, 2", "PARTITION BY subject ") if s else ("1", "")
    return f"""WITH {sources},
stress_daily AS (SELECT {s}CAST("timestamp" AS DATE) AS day, avg(stress) AS stress_avg, max(stress) AS stress_max,
  count(CASE WHEN stress > 0 THEN 1 END) AS stress_duration FROM stress GROUP BY {g}),
sleep_daily AS (SELECT {s}day, score, {MINUTES.format('total_sleep')} AS total_sleep_min,
  {MINUTES.format('deep_sleep')} AS deep_sleep_min, {MINUTES.format('rem_sleep')} AS rem_sleep_min FROM sleep WHERE score > 0),
{ACTIVITY_DAILY_SQL.format(s, g)},
detail AS (SELECT {s}CAST(s.start_time AS DATE) AS day, avg(d.steps) AS steps_from_steps_activity, avg(d.vo2_max) AS vo2_max
  FROM steps_activities d JOIN sessions s USING ({s}activity_id) GROUP BY {g}),
{coverage_sql(bool(s), 20, 10, 'monitoring_hr', 'timestamp')},
joined AS (
  SELECT * FROM daily_summary LEFT JOIN sleep_daily USING ({s}day) LEFT JOIN stress_daily USING ({s}day)
  LEFT JOIN resting_hr USING ({s}day)
  LEFT JOIN (SELECT {s}day, steps AS steps_summary, calories_bmr_avg FROM days_summary) USING ({s}day)
  LEFT JOIN activity_daily USING ({s}day) LEFT JOIN detail USING ({s}day)
  LEFT JOIN (SELECT * EXCLUDE (first_sample, last_sample) FROM cover) USING ({s}day)),
master AS (SELECT *, lag(had_workout) OVER w AS yesterday_had_workout, lag(activity_minutes) OVER w AS yesterday_activity_minutes,
  lag(activity_calories) OVER w AS yesterday_activity_calories, lag(training_effect) OVER w AS yesterday_training_effect,
  lag(anaerobic_te) OVER w AS yesterday_anaerobic_te,
  avg(steps) OVER ({by}ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS steps_avg_7d,
  score IS NULL AS missing_score, training_effect IS NULL AS missing_training_effect
FROM joined WINDOW w AS ({by}ORDER BY day))"""


MASTER_SQL = master_sql(inputs.MASTER_SQL)
SUBJECT_MASTER_SQL = master_sql(inputs.SUBJECT_MASTER_SQL, "subject, ")
MASTER_DOUBLES = (
    "steps", "calories_total", "score", "total_sleep_min", "deep_sleep_min", "rem_sleep_min", "stress_avg", "vo2_max",
    "activity_minutes", "training_effect", "anaerobic_te", "steps_from_steps_activity", "coverage_hours", "coverage_pct",
    "total_missing_minutes", "yesterday_activity_minutes", "yesterday_training_effect", "yesterday_anaerobic_te",
    "steps_avg_7d")


def master(spark, sf):
    return build_master(inputs.master_tables(spark, sf), max_gap_minutes=20, edge_minutes=10)


def master_subject(spark, sf):
    return build_master(inputs.subject_master_tables(spark, sf), subject_cols=SUBJECT, max_gap_minutes=20, edge_minutes=10)


QUALITY_SQL = """quality AS (
  SELECT day, round_even((0.5 * coalesce(coverage_pct, 0) + 0.5 * found / total * 100) / 1, 1) AS data_quality_score,
    round_even(coalesce(coverage_pct, 0), 1) AS coverage_score, round_even(found::DOUBLE / total * 100, 1) AS completeness_score,
    found AS key_metrics_count, total AS key_metrics_total
  FROM (SELECT *, CAST((steps IS NOT NULL)::INT + (score IS NOT NULL)::INT + (stress_avg IS NOT NULL)::INT
    + (resting_heart_rate IS NOT NULL)::INT + (calories_total IS NOT NULL)::INT AS BIGINT) AS found, 5::BIGINT AS total
    FROM master))"""
QUALITY_DOUBLES = ("data_quality_score", "coverage_score", "completeness_score")


def weeks(spark, sf):
    return weekly.weekly_aggregates(
        inputs.subject_daily(spark, sf), None, subject_cols=SUBJECT, resting_hr="resting_heart_rate")


WEEKS_SQL = f"""{MANY}, weeks AS (
  SELECT subject, isoyear(day) AS iso_year, weekofyear(day) AS iso_week, min(day) AS week_start, max(day) AS week_end,
    avg(score) AS sleep_score_avg, count(score) AS sleep_score_count, avg(resting_heart_rate) AS rhr_avg,
    count(resting_heart_rate) AS rhr_count, CAST(coalesce(sum(stress_duration), 0) AS DOUBLE) AS stress_minutes_total,
    count(stress_duration) AS stress_minutes_count
  FROM daily GROUP BY 1, 2, 3)"""
WEEK_DOUBLES = ("sleep_score_avg", "rhr_avg")


def delta_sql(value: str, count: str, sign: int, whole: bool = False) -> str:
    x = f"round_even({value}, 0)" if whole else value
    return f"""{WEEKS_SQL}, u AS (SELECT subject, iso_year, iso_week, CASE WHEN {count} >= 3 THEN {x} END AS value,
  {count} AS days FROM weeks),
d AS (SELECT *, value - lag(value) OVER (PARTITION BY subject ORDER BY iso_year, iso_week) AS delta FROM u)
SELECT *, CASE WHEN delta * {sign} > 0 THEN '+' WHEN delta * {sign} < 0 THEN '-' WHEN delta = 0 THEN '=' END AS trend FROM d"""


PROFILE_SQL = f"""profile AS (
  SELECT metric, "column", {DOW.format('day')} AS day_of_week, dayofweek(day) AS day_of_week_num, avg(x) AS mean,
    quantile_cont(x, 0.5) AS median, stddev_samp(x) AS std, count(x) AS count
  FROM (SELECT day, 'sleep_score' AS metric, 'score' AS "column", score AS x FROM daily
    UNION ALL SELECT day, 'body_battery_max', 'bb_max', bb_max FROM daily
    UNION ALL SELECT day, 'body_battery_min', 'bb_min', bb_min FROM daily
    UNION ALL SELECT day, 'water_intake', 'hydration_intake', hydration_intake FROM daily)
  WHERE x IS NOT NULL GROUP BY 1, 2, 3, 4)"""


def profile(spark, sf):
    return profiles.weekday_profile(inputs.subject_daily(spark, sf))


MAPPING = {
    "1-URGENT": {"display_name": "Sprint", "description": "Short and fast", "category": "cardio", "color": "#E74C3C"},
    "5-LOW": {"display_name": "Easy Walk", "description": "Recovery", "category": "outdoor", "color": "#2ECC71"},
}
MAPPING_SQL = """mapping AS (SELECT * FROM (VALUES ('1-URGENT', 'Sprint', 'Short and fast', 'cardio', '#E74C3C'),
  ('5-LOW', 'Easy Walk', 'Recovery', 'outdoor', '#2ECC71')) AS m(sport, display_name, description, category, color))"""
READABLE = ("array_to_string(list_transform(regexp_extract_all(replace({0}, '_', ' '), '[A-Za-z]+|[^A-Za-z]+'), "
            "lambda s: upper(s[1]) || lower(s[2:])), '')")
DARKER = "'#' || " + " || ".join(
    f"lpad(lower(to_hex(CAST(floor(CAST('0x' || substr(color, {p}, 2) AS INTEGER) * (1 - 0.3::DOUBLE)) AS INTEGER))), 2, '0')"
    for p in (2, 4, 6))
DAYS_SQL = f"""{inputs.SESSIONS_SQL}, days AS (
  SELECT CAST(start_time AS DATE) AS day, arg_min(sport, (start_time, activity_id)) AS sport, count(*) AS activity_count
  FROM sessions GROUP BY 1)"""
COLORS_SQL = f"""{MAPPING_SQL}, firsts AS (SELECT sport, min((start_time, activity_id)) AS f FROM sessions GROUP BY 1),
colors AS (SELECT sport, coalesce(m.color, {list(activity.SPARE_COLORS)}[
    (row_number() OVER (PARTITION BY m.color IS NULL ORDER BY f) - 1) % {len(activity.SPARE_COLORS)} + 1]) AS color
  FROM firsts LEFT JOIN mapping m USING (sport))"""


def mapping(spark):
    return mapping_from(spark, MAPPING)


def windows(spark, sf):
    return inputs.subject_daily(spark, sf).select("subject", "day", "score", "steps", "resting_heart_rate")


W = "(PARTITION BY subject ORDER BY day{0})"


def ranges_frame(spark, sf):
    return inputs.subject_daily(spark, sf).withColumn("intensity_time", F.col("hydration_intake"))


def bins_sql(value: str, source: str = "daily", n: int = 5, keys: str = "") -> str:
    quants = ", ".join(f"quantile_cont({value}, {i}::DOUBLE / {n})" for i in range(n + 1))
    group = f"GROUP BY {keys.rstrip(', ')}" if keys else ""
    using = f"USING ({keys.rstrip(', ')})" if keys else "ON true"
    return f"""valid AS (SELECT {keys}{value}, score FROM {source} WHERE {value} IS NOT NULL AND score IS NOT NULL),
e AS (SELECT {keys}list_sort(list_distinct([{quants}])) AS edges FROM valid {group}),
b AS (SELECT v.*, edges, greatest(len(list_filter(edges, lambda x: x < {value})), 1) AS bin FROM valid v JOIN e {using}),
binned AS (SELECT {keys}bin, edges[bin] AS bin_low, edges[bin + 1] AS bin_high, avg(score) AS mean, count(score) AS count,
  stddev_samp(score) AS std FROM b GROUP BY ALL)"""


def quantile_bins_subject(spark, sf):
    return ranges.quantile_bins(inputs.subject_daily(spark, sf), "steps", subject_cols=SUBJECT)


QUERIES = [
    Query("activity_daily", lambda s, d: daily.daily_activity(inputs.sessions(s, d), subject_cols=SUBJECT),
          f"{SESSIONS}, {ACTIVITY_DAILY_SQL.format('subject,', '1, 2')} SELECT * FROM activity_daily",
          ("activity_minutes", "training_effect", "anaerobic_te")),
    Query("activity_detail_daily",
          lambda s, d: daily.daily_activity_detail(
              inputs.master_tables(s, d)["steps_activities"], inputs.sessions(s, d), subject_cols=SUBJECT),
          f"""WITH {inputs.MASTER_SQL} SELECT s.subject, CAST(s.start_time AS DATE) AS day,
  avg(d.steps) AS steps_from_steps_activity, avg(d.vo2_max) AS vo2_max
FROM steps_activities d JOIN sessions s USING (activity_id) GROUP BY 1, 2""", ("steps_from_steps_activity", "vo2_max")),
    Query("sleep_prepared", lambda s, d: daily.prepare_sleep(inputs.master_tables(s, d)["sleep"]),
          f"""WITH {inputs.MASTER_SQL} SELECT day, score, {MINUTES.format('total_sleep')} AS total_sleep_min,
  {MINUTES.format('deep_sleep')} AS deep_sleep_min, {MINUTES.format('rem_sleep')} AS rem_sleep_min
FROM sleep WHERE score > 0""", ("total_sleep_min", "deep_sleep_min", "rem_sleep_min")),
    Query("master_daily", master, f"{MASTER_SQL} SELECT * FROM master", MASTER_DOUBLES),
    Query("master_daily_subject", master_subject, f"{SUBJECT_MASTER_SQL} SELECT * FROM master", MASTER_DOUBLES),
    Query("quality_score_subject", lambda s, d: quality.quality_score(master_subject(s, d), subject_cols=SUBJECT),
          f"{SUBJECT_MASTER_SQL}, {QUALITY_SQL.replace('SELECT day,', 'SELECT subject, day,')} SELECT * FROM quality", QUALITY_DOUBLES, 4),
    Query("modeling_set_subject",
          lambda s, d: prep.modeling_set(
              master_subject(s, d), ["score", "stress_avg"], min_coverage_pct=20.0).select("subject", "day", "score", "stress_avg"),
          f"""{SUBJECT_MASTER_SQL} SELECT subject, day, score, stress_avg FROM master
WHERE coverage_pct >= 20 AND score IS NOT NULL AND stress_avg IS NOT NULL""", ("score", "stress_avg")),
    Query("activity_detail_clashing_ids",
          lambda s, d: (lambda t: daily.daily_activity_detail(t["steps_activities"], t["activities"], subject_cols=SUBJECT))(
              inputs.subject_master_tables(s, d)),
          f"""WITH {inputs.SUBJECT_MASTER_SQL} SELECT subject, CAST(s.start_time AS DATE) AS day,
  avg(d.steps) AS steps_from_steps_activity, avg(d.vo2_max) AS vo2_max
FROM steps_activities d JOIN sessions s USING (subject, activity_id) GROUP BY 1, 2""", ("steps_from_steps_activity", "vo2_max")),
    Query("quality_score", lambda s, d: quality.quality_score(master(s, d)),
          f"{MASTER_SQL}, {QUALITY_SQL} SELECT * FROM quality", QUALITY_DOUBLES, 4),
    Query("quality_totals", lambda s, d: quality.quality_totals(quality.quality_score(master(s, d))),
          f"""{MASTER_SQL}, {QUALITY_SQL} SELECT avg(data_quality_score) AS mean_score,
  count(CASE WHEN data_quality_score >= 80 THEN 1 END) AS days_80, count(*) AS total_days,
  count(CASE WHEN data_quality_score >= 80 THEN 1 END) * 100.0::DOUBLE / count(*) AS pct_80 FROM quality""",
          ("mean_score", "pct_80")),
    Query("master_with_quality",
          lambda s, d: (lambda m: sinks.join_quality(m, quality.quality_score(m)))(master(s, d)).select(
              "day", "steps", "score", "data_quality_score", "key_metrics_count"),
          f"""{MASTER_SQL}, {QUALITY_SQL} SELECT day, steps, score, data_quality_score, key_metrics_count
FROM master LEFT JOIN quality USING (day)""", ("steps", "score", "data_quality_score")),
    Query("modeling_set",
          lambda s, d: prep.modeling_set(
              master(s, d), ["score", "stress_avg", "no_such_feature"], min_coverage_pct=50.0).select(
                  "day", "score", "stress_avg"),
          f"""{MASTER_SQL} SELECT day, score, stress_avg FROM master
WHERE coverage_pct >= 50 AND score IS NOT NULL AND stress_avg IS NOT NULL""", ("score", "stress_avg")),
    Query("weekly_aggregates", weeks, f"{WEEKS_SQL} SELECT * FROM weeks", WEEK_DOUBLES, 9),
    Query("last_weeks", lambda s, d: weekly.last_weeks(weeks(s, d), 4, subject_cols=SUBJECT),
          f"""{WEEKS_SQL} SELECT * FROM weeks QUALIFY row_number() OVER (PARTITION BY subject
  ORDER BY iso_year DESC, iso_week DESC) <= 4""", WEEK_DOUBLES, 9),
    Query("weekly_delta", lambda s, d: weekly.weekly_delta(
        weeks(s, d), "rhr_avg", "rhr_count", lower_is_better=True, subject_cols=SUBJECT),
          delta_sql("rhr_avg", "rhr_count", -1), ("value", "delta"), 9),
    Query("weekly_stress_delta", lambda s, d: weekly.weekly_delta(
        weeks(s, d), "stress_minutes_total", "stress_minutes_count", lower_is_better=True, whole=True,
        subject_cols=SUBJECT), delta_sql("stress_minutes_total", "stress_minutes_count", -1, True), ("value", "delta"), 9),
    Query("latest_week", lambda s, d: weekly.latest_week_summary(weeks(s, d), subject_cols=SUBJECT).select(
        "subject", "iso_year", "iso_week", "sleep_score_avg", "sleep_score_previous", "sleep_score_change", "sleep_score_sign",
        "rhr_previous", "stress_previous", "stress_sign"),
          f"""{WEEKS_SQL} SELECT subject, iso_year, iso_week, sleep_score_avg, lag(sleep_score_avg) OVER w AS sleep_score_previous,
  CASE WHEN least(sleep_score_count, lag(sleep_score_count) OVER w) >= 3 AND lag(sleep_score_count) OVER w IS NOT NULL
    THEN sleep_score_avg - lag(sleep_score_avg) OVER w END AS sleep_score_change,
  sign(CASE WHEN least(sleep_score_count, lag(sleep_score_count) OVER w) >= 3 AND lag(sleep_score_count) OVER w IS NOT NULL
    THEN sleep_score_avg - lag(sleep_score_avg) OVER w END)::BIGINT AS sleep_score_sign,
  lag(rhr_avg) OVER w AS rhr_previous, lag(stress_minutes_total) OVER w AS stress_previous,
  sign(CASE WHEN least(stress_minutes_count, lag(stress_minutes_count) OVER w) >= 3 AND lag(stress_minutes_count) OVER w IS NOT NULL
    THEN stress_minutes_total - lag(stress_minutes_total) OVER w END)::BIGINT AS stress_sign FROM weeks
WINDOW w AS (PARTITION BY subject ORDER BY iso_year, iso_week)
QUALIFY row_number() OVER (PARTITION BY subject ORDER BY iso_year DESC, iso_week DESC) = 1""",
          ("sleep_score_avg", "sleep_score_previous", "sleep_score_change", "rhr_previous"), 9),
    Query("weekday_profile", profile, f"{MANY}, {PROFILE_SQL} SELECT * FROM profile", ("mean", "median", "std")),
    Query("weekday_profile_subject",
          lambda s, d: profiles.weekday_profile(inputs.subject_daily(s, d), subject_cols=SUBJECT).drop("column"),
          f"""{MANY}, l AS (SELECT subject, day, 'sleep_score' AS metric, score AS x FROM daily
  UNION ALL SELECT subject, day, 'body_battery_max', bb_max FROM daily
  UNION ALL SELECT subject, day, 'body_battery_min', bb_min FROM daily
  UNION ALL SELECT subject, day, 'water_intake', hydration_intake FROM daily)
SELECT subject, metric, {DOW.format('day')} AS day_of_week, dayofweek(day) AS day_of_week_num, avg(x) AS mean,
  quantile_cont(x, 0.5) AS median, stddev_samp(x) AS std, count(x) AS count FROM l WHERE x IS NOT NULL GROUP BY 1, 2, 3, 4""",
          ("mean", "median", "std")),
    Query("weekend_effect", lambda s, d: profiles.weekday_insight(profile(s, d)),
          f"""{MANY}, {PROFILE_SQL}, v AS (SELECT metric, arg_max(day_of_week, mean) AS best_day, max(mean) AS best_mean,
  arg_min(day_of_week, mean) AS worst_day, min(mean) AS worst_mean, stddev_samp(mean) / avg(mean) * 100 AS cv_pct,
  avg(CASE WHEN day_of_week_num IN (0, 6) THEN mean END) AS weekend_mean,
  avg(CASE WHEN day_of_week_num NOT IN (0, 6) THEN mean END) AS weekday_mean FROM profile GROUP BY 1)
SELECT *, best_mean - worst_mean AS difference, (weekend_mean - weekday_mean) / weekday_mean * 100 AS weekend_effect_pct
FROM v""", ("best_mean", "worst_mean", "cv_pct", "weekend_mean", "weekday_mean", "difference", "weekend_effect_pct")),
    Query("weekday_minmax", lambda s, d: profiles.weekday_minmax(profile(s, d)),
          f"""{MANY}, {PROFILE_SQL} SELECT *, CASE WHEN max(mean) OVER w > min(mean) OVER w
  THEN (mean - min(mean) OVER w) / (max(mean) OVER w - min(mean) OVER w) * 100 ELSE 50 END AS normalized
FROM profile WINDOW w AS (PARTITION BY metric)""", ("mean", "median", "std", "normalized")),
    Query("weekday_pivot", lambda s, d: profiles.pivot_weekdays(profile(s, d), ["metric"]),
          f"{MANY}, {PROFILE_SQL} SELECT metric, " + ", ".join(
              f"max(CASE WHEN day_of_week = '{n}' THEN mean END) AS {n}" for n in profiles.WEEKDAYS)
          + " FROM profile GROUP BY 1", profiles.WEEKDAYS),
    Query("month_pivot", lambda s, d: profiles.pivot_months(inputs.daily(s, d), "steps"),
          f"{ONE} SELECT year(day) AS year, " + ", ".join(
              f"avg(CASE WHEN month(day) = {m} THEN steps END) AS m{m:02d}" for m in range(1, 13))
          + " FROM daily GROUP BY 1", tuple(f"m{m:02d}" for m in range(1, 13))),
    Query("quantile_bins", lambda s, d: ranges.quantile_bins(inputs.subject_daily(s, d), "steps"),
          f"{MANY}, {bins_sql('steps')} SELECT * FROM binned", ("bin_low", "bin_high", "mean", "std")),
    Query("quantile_bins_subject", quantile_bins_subject,
          f"{MANY}, {bins_sql('steps', keys='subject, ')} SELECT * FROM binned", ("bin_low", "bin_high", "mean", "std")),
    Query("best_range_subject", lambda s, d: ranges.best_range(quantile_bins_subject(s, d), subject_cols=SUBJECT),
          f"""{MANY}, {bins_sql('steps', keys='subject, ')} SELECT subject, arg_max(bin_low, (mean, -bin)) AS low,
  arg_max(bin_high, (mean, -bin)) AS high, max(mean) AS best_mean FROM binned GROUP BY 1 HAVING max(count) >= 3""",
          ("low", "high", "best_mean")),
    Query("best_range", lambda s, d: ranges.optimal_ranges(ranges_frame(s, d)),
          f"""{MANY}, r AS (SELECT 'steps' AS habit, 'steps' AS label, bin_low, bin_high, mean, bin, count
    FROM (WITH {bins_sql('steps')} SELECT * FROM binned)
  UNION ALL SELECT 'intensity', 'intensity minutes', bin_low, bin_high, mean, bin, count
    FROM (WITH {bins_sql('hydration_intake')} SELECT * FROM binned)),
p AS (SELECT habit, label, arg_max(bin_low, (mean, -bin)) AS low, arg_max(bin_high, (mean, -bin)) AS high,
  max(mean) AS best_mean FROM r GROUP BY 1, 2 HAVING max(count) >= 3)
SELECT habit, low, high, best_mean, CASE WHEN habit = 'steps'
  THEN format('Your best sleep occurs when {{}} are between {{:,}}–{{:,}}', label, CAST(round_even(low, 0) AS BIGINT),
    CAST(round_even(high, 0) AS BIGINT))
  ELSE format('Your best sleep occurs when {{}} are between {{}}–{{}}', label, CAST(round_even(low, 0) AS BIGINT),
    CAST(round_even(high, 0) AS BIGINT)) END AS message FROM p""", ("low", "high", "best_mean")),
    Query("quartile_box", lambda s, d: ranges.quartile_spread(inputs.subject_daily(s, d), "steps", "stress_avg"),
          f"""{MANY}, e AS (SELECT [quantile_cont(steps, i::DOUBLE / 4) FOR i IN [0]] AS unused,
  quantile_cont(steps, 0.25) AS a, quantile_cont(steps, 0.5) AS b, quantile_cont(steps, 0.75) AS c FROM daily)
SELECT CASE WHEN steps <= a THEN 'Q1' WHEN steps <= b THEN 'Q2' WHEN steps <= c THEN 'Q3' ELSE 'Q4' END AS "group",
  count(*) AS n, min(stress_avg) AS minimum, quantile_cont(stress_avg, 0.25) AS q1, median(stress_avg) AS median,
  quantile_cont(stress_avg, 0.75) AS q3, max(stress_avg) AS maximum FROM daily, e GROUP BY 1""".replace(
              "SELECT [quantile_cont(steps, i::DOUBLE / 4) FOR i IN [0]] AS unused,\n  ", "SELECT "),
          ("minimum", "q1", "median", "q3", "maximum")),
    Query("lag_1_7", lambda s, d: windows(s, d).withColumns({
        "lag1": F.lag("steps", 1).over(daily.subject_window("day", SUBJECT)),
        "lag7": F.lag("steps", 7).over(daily.subject_window("day", SUBJECT))}).select("subject", "day", "lag1", "lag7"),
          f"""{MANY} SELECT subject, day, lag(steps, 1) OVER w AS lag1, lag(steps, 7) OVER w AS lag7 FROM daily
WINDOW w AS {W.format('')}"""),
    Query("lag_or_own", lambda s, d: windows(s, d).select(
        "subject", "day", F.coalesce(F.lag("score").over(daily.subject_window("day", SUBJECT)), F.col("score")).alias("score_lag1")),
          f"{MANY} SELECT subject, day, coalesce(lag(score) OVER {W.format('')}, score) AS score_lag1 FROM daily"),
    Query("yesterday_calendar",
          lambda s, d: daily.yesterday(windows(s, d), ["steps"], subject_cols=SUBJECT, calendar=True).select(
              "subject", "day", "yesterday_steps"),
          f"""{MANY} SELECT a.subject, a.day, b.steps AS yesterday_steps FROM daily a
LEFT JOIN daily b ON a.subject = b.subject AND b.day = a.day - 1"""),
    Query("rolling_7_30",
          lambda s, d: daily.rolling_mean(daily.rolling_mean(
              windows(s, d), "score", 7, "mean7", subject_cols=SUBJECT), "score", 30, "mean30", subject_cols=SUBJECT).select(
                  "subject", "day", "mean7", "mean30"),
          f"""{MANY} SELECT subject, day, avg(score) OVER {W.format(' ROWS BETWEEN 6 PRECEDING AND CURRENT ROW')} AS mean7,
  avg(score) OVER {W.format(' ROWS BETWEEN 29 PRECEDING AND CURRENT ROW')} AS mean30 FROM daily""", ("mean7", "mean30"), 9),
    Query("rolling_full_window",
          lambda s, d: daily.rolling_mean(windows(s, d), "score", 7, "mean7", subject_cols=SUBJECT, require_full=True).select(
              "subject", "day", "mean7"),
          f"""{MANY} SELECT subject, day, CASE WHEN count(score) OVER w = 7 THEN avg(score) OVER w END AS mean7 FROM daily
WINDOW w AS {W.format(' ROWS BETWEEN 6 PRECEDING AND CURRENT ROW')}""", ("mean7",), 9),
    Query("ffill", lambda s, d: impute.impute(windows(s, d), ["score"], "forward_fill", subject_cols=SUBJECT).select(
        "subject", "day", "score"),
          f"""{MANY} SELECT subject, day, last_value(score IGNORE NULLS) OVER
  {W.format(' ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW')} AS score FROM daily"""),
    Query("bfill", lambda s, d: impute.impute(windows(s, d), ["score"], "backward_fill", subject_cols=SUBJECT).select(
        "subject", "day", "score"),
          f"""{MANY} SELECT subject, day, first_value(score IGNORE NULLS) OVER
  {W.format(' ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING')} AS score FROM daily"""),
    Query("ewm_decay", lambda s, d: stats.decayed_mean(
        windows(s, d), ["resting_heart_rate"], 0.95, subject_cols=SUBJECT).select(
            "subject", "day", "smoothed_resting_heart_rate"),
          f"""{MANY} SELECT a.subject, a.day,
  sum(pow(0.95::DOUBLE, date_diff('day', b.day, a.day)) * b.resting_heart_rate)
    / sum(CASE WHEN b.resting_heart_rate IS NOT NULL THEN pow(0.95::DOUBLE, date_diff('day', b.day, a.day)) END)
    AS smoothed_resting_heart_rate
FROM daily a JOIN daily b ON a.subject = b.subject AND b.day <= a.day GROUP BY 1, 2""", ("smoothed_resting_heart_rate",), 5),
    Query("time_split", lambda s, d: stats.chronological_split(windows(s, d), subject_cols=SUBJECT).select(
        "subject", "day", "is_train"),
          f"""{MANY} SELECT subject, day, row_number() OVER {W.format('')}
  <= floor(count(*) OVER (PARTITION BY subject) * 0.8::DOUBLE) AS is_train FROM daily"""),
    Query("ts_folds", lambda s, d: stats.expanding_folds(windows(s, d), 5, subject_cols=SUBJECT).groupBy(
        "subject", "fold").agg(F.count("*").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day")),
          f"""{MANY}, r AS (SELECT subject, day, count(*) OVER (PARTITION BY subject) AS n,
  row_number() OVER {W.format('')} AS rn FROM daily),
f AS (SELECT subject, day, CAST(greatest(0, 5 - floor((n - rn) / floor(n / 6))) AS BIGINT) AS fold FROM r)
SELECT subject, fold, count(*) AS n, min(day) AS first_day, max(day) AS last_day FROM f GROUP BY 1, 2"""),
    Query("dedup_first",
          lambda s, d: daily.first_row_per_day(
              table(s, d, "orders").select(F.col("o_custkey").alias("subject"), F.to_date("o_orderdate").alias("day"),
                                           "o_orderkey", "o_totalprice", "o_orderpriority"),
              subject_cols=SUBJECT, tie_break=["o_totalprice", "o_orderkey"]),
          """SELECT o_custkey AS subject, CAST(o_orderdate AS DATE) AS day, o_orderkey, o_totalprice, o_orderpriority
FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_totalprice, o_orderkey) = 1"""),
    Query("last_30_days", lambda s, d: prep.last_days(windows(s, d), 30, subject_cols=SUBJECT).select("subject", "day", "steps"),
          f"""{MANY} SELECT subject, day, steps FROM daily
QUALIFY day >= max(day) OVER (PARTITION BY subject) - 30"""),
    Query("last_full_month", lambda s, d: prep.last_full_month(inputs.daily(s, d)).select("day", "steps"),
          f"""{ONE} SELECT day, steps FROM daily WHERE day >= (SELECT date_trunc('month', max(day)) - INTERVAL 1 MONTH FROM daily)
  AND day < (SELECT date_trunc('month', max(day)) FROM daily)"""),
    Query("date_range", lambda s, d: prep.filter_by_date(
        windows(s, d), start="1996-02-29", end="1998-02-28").select("subject", "day", "steps"),
          f"{MANY} SELECT subject, day, steps FROM daily WHERE day BETWEEN '1996-02-29' AND '1998-02-28'"),
    Query("months_back", lambda s, d: prep.filter_by_date(
        windows(s, d), months_back=18, now="2001-08-31 12:00:00").select("subject", "day", "steps"),
          f"""{MANY} SELECT subject, day, steps FROM daily
WHERE CAST(day AS TIMESTAMP) >= TIMESTAMP '2001-08-31 12:00:00' - INTERVAL 18 MONTH"""),
    Query("display_names", lambda s, d: activity.with_display_names(inputs.sessions(s, d), mapping(s)).groupBy(
        "sport", "display_name", "description").agg(F.count("*").alias("n")),
          f"""{SESSIONS}, {MAPPING_SQL} SELECT sport, coalesce(display_name, {READABLE.format('sport')}) AS display_name,
  coalesce(description, '') AS description, count(*) AS n FROM sessions LEFT JOIN mapping USING (sport) GROUP BY 1, 2, 3"""),
    Query("unmapped_types", lambda s, d: activity.unmapped_sports(inputs.sessions(s, d), mapping(s)),
          f"""{SESSIONS}, {MAPPING_SQL} SELECT sport, count(*) AS activities FROM sessions
WHERE sport NOT IN (SELECT sport FROM mapping) GROUP BY 1"""),
    Query("mapping_suggestions", lambda s, d: activity.suggest_mappings(inputs.sessions(s, d), mapping(s)).select(
        "sport", "display_name", "activities"),
          f"""{SESSIONS}, {MAPPING_SQL} SELECT sport, {READABLE.format('sport')} AS display_name, count(*) AS activities
FROM sessions WHERE sport NOT IN (SELECT sport FROM mapping) GROUP BY 1"""),
    Query("sport_colors", lambda s, d: activity.sport_colors(inputs.sessions(s, d), mapping(s)),
          f"{SESSIONS}, {COLORS_SQL} SELECT sport, color FROM colors"),
    Query("activity_calendar", lambda s, d: activity.activity_calendar(inputs.sessions(s, d), mapping(s)),
          f"""WITH {DAYS_SQL}, {COLORS_SQL}, spine AS (
  SELECT CAST(unnest(generate_series(date_trunc('week', min(day))::TIMESTAMP, date_trunc('week', max(day))::TIMESTAMP
    + INTERVAL 6 DAY, INTERVAL 1 DAY)) AS DATE) AS day, CAST(date_trunc('week', min(day)) AS DATE) AS start FROM days)
SELECT s.day, CAST(date_diff('day', start, s.day) // 7 AS BIGINT) AS week, CAST(date_diff('day', start, s.day) % 7 AS BIGINT) AS weekday,
  sport, coalesce(activity_count, 0) AS activity_count,
  CASE WHEN activity_count IS NULL THEN '#FFFFFF' WHEN activity_count > 1 AND color IS NOT NULL THEN {DARKER}
    ELSE coalesce(color, '#E0E0E0') END AS color
FROM spine s LEFT JOIN (SELECT * FROM days LEFT JOIN colors USING (sport)) AS d ON s.day = d.day"""),
    Query("activity_days", lambda s, d: activity.activity_days(inputs.sessions(s, d), subject_cols=SUBJECT),
          f"""{SESSIONS} SELECT subject, CAST(start_time AS DATE) AS day, arg_min(sport, (start_time, activity_id)) AS sport,
  count(*) AS activity_count FROM sessions GROUP BY 1, 2"""),
    Query("activity_summary", lambda s, d: activity.activity_summary(inputs.sessions(s, d)),
          f"""WITH {DAYS_SQL} SELECT count(*) AS active_days, CAST(max(day) - min(day) + 1 AS BIGINT) AS total_days,
  count(*) * 100.0::DOUBLE / (max(day) - min(day) + 1) AS active_pct FROM days""", ("active_pct",)),
    Query("sport_days", lambda s, d: activity.sport_days(inputs.sessions(s, d)),
          f"WITH {DAYS_SQL} SELECT sport, count(*) AS days FROM days GROUP BY 1"),
    Query("sessions_in_range", lambda s, d: activity.filter_sessions(
        inputs.sessions(s, d), months=12, now="2001-01-01 00:00:00", end="2001-03-01").select("activity_id", "start_time"),
          f"""{SESSIONS} SELECT activity_id, start_time FROM sessions
WHERE start_time >= TIMESTAMP '2001-01-01' - INTERVAL 360 DAY AND start_time <= TIMESTAMP '2001-03-01'"""),
    Query("marked_days", lambda s, d: activity.mark_days(
        windows(s, d), windows(s, d).where("steps > 45000"), subject_cols=SUBJECT).select("subject", "day", "is_anomaly"),
          f"{MANY} SELECT subject, day, steps > 45000 AS is_anomaly FROM daily"),
    Query("score_histogram", lambda s, d: quality.score_histogram(inputs.subject_daily(s, d), "score"),
          f"""{MANY} SELECT CAST(least(floor(score / 5), 19) AS BIGINT) AS bin, count(*) AS n,
  least(floor(score / 5), 19) * 5 AS bin_low, (least(floor(score / 5), 19) + 1) * 5 AS bin_high
FROM daily WHERE score BETWEEN 0 AND 100 GROUP BY 1, 3, 4""", ("bin_low", "bin_high")),
    Query("interactions", lambda s, d: prep.interactions(inputs.subject_daily(s, d)).select(
        "subject", "day", "steps_stress_interaction"),
          f"{MANY} SELECT subject, day, steps * stress_avg AS steps_stress_interaction FROM daily",
          ("steps_stress_interaction",)),
    Query("stress_bands", lambda s, d: inputs.subject_daily(s, d).groupBy(
        quality.stress_band(F.col("stress_avg")).alias("band")).agg(F.count("*").alias("days")),
          f"""{MANY} SELECT CASE WHEN stress_avg < 30 THEN 'low' WHEN stress_avg < 50 THEN 'medium' ELSE 'high' END AS band,
  count(*) AS days FROM daily GROUP BY 1"""),
    Query("coalesce_alias", lambda s, d: prep.coalesce_columns(
        windows(s, d).withColumnsRenamed({"score": "sleep_score"}), "value", "missing", "sleep_score", "resting_heart_rate").select(
            "subject", "day", "value"),
          f"{MANY} SELECT subject, day, coalesce(score, resting_heart_rate) AS value FROM daily"),
]
