"""Queries on zones, stored days, exports, mapping files, schemas and fallbacks of raw tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from dayloom.catalog import inputs
from dayloom.catalog.base import Query, table
from dayloom.catalog.daily import MASTER_SQL, QUALITY_DOUBLES, QUALITY_SQL, SUBJECT, master
from dayloom.catalog.reports import stored
from dayloom.operators import prep, quality, zones
from dayloom.operators.coverage import clamp_coverage_args
from dayloom.operators.daily import normalize_day
from dayloom.plans import reports
from dayloom.sources import schema, sinks, tables

# events moved into the weeks of the changes of clocks: days of 23 hours in spring, of 25 in autumn
ZONED_SQL = """zoned AS (SELECT event_id, user_id AS subject, value,
  CASE user_id % 3 WHEN 0 THEN 'Europe/Berlin' WHEN 1 THEN 'America/New_York' ELSE 'Asia/Tokyo' END AS zone,
  ts + to_days(CASE WHEN user_id % 2 = 0 THEN 62 ELSE 290 END) AS ts FROM events),
local AS (SELECT *, CAST(timezone(zone, timezone('UTC', ts)) AS DATE) AS day FROM zoned),
bounds AS (SELECT *, epoch_us(timezone(zone, day::TIMESTAMP)) AS start_us, epoch_us(timezone(zone, (day + 1)::TIMESTAMP)) AS end_us FROM local)"""
GAP, EDGE = 120, 60
ZONED_COVERAGE_SQL = f"""WITH {ZONED_SQL},
g AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY zone, day ORDER BY ts) AS gap FROM bounds),
e AS (SELECT zone, day, any_value(end_us - start_us) AS len, min(epoch_us(ts)) - any_value(start_us) AS first_us, max(epoch_us(ts)) - any_value(start_us) AS last_us,
  count(CASE WHEN gap > {GAP} * 60000000::BIGINT THEN 1 END) AS gap_count, coalesce(sum(greatest(gap - {GAP} * 60000000::BIGINT, 0)), 0) AS inner_us FROM g GROUP BY zone, day),
f AS (SELECT *, greatest(first_us - {EDGE} * 60000000::BIGINT, 0) AS late, greatest(len - {EDGE} * 60000000::BIGINT - last_us, 0) AS early FROM e)
SELECT zone, day, len / 60000000.0::DOUBLE / 60 AS day_hours, (last_us - first_us) / 60000000.0::DOUBLE / 60 AS coverage_hours,
  least(100.0::DOUBLE, (last_us - first_us) / 60000000.0::DOUBLE / (len / 60000000.0::DOUBLE) * 100) AS coverage_pct, late = 0 AND early = 0 AND gap_count = 0 AS has_full_coverage, gap_count,
  (inner_us + late + early) / 60000000.0::DOUBLE AS total_missing_minutes FROM f"""


def zoned(spark, sf):
    kind, days = F.col("user_id") % 3, F.when(F.col("user_id") % 2 == 0, 62).otherwise(290)
    return table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("subject"), "value",
        F.when(kind == 0, "Europe/Berlin").when(kind == 1, "America/New_York").otherwise("Asia/Tokyo").alias("zone"),
        (F.col("ts") + F.make_dt_interval(days=days)).cast("timestamp").alias("ts"))


def repaired_days(spark, sf):
    """Stored days of all subjects, of which two subjects get new values on every seventh day of two years."""
    daily = inputs.subject_daily(spark, sf).select("subject", "day", "steps", "score")
    path = stored(spark)
    sinks.store_days(daily, path)
    late = daily.where(F.col("subject").isin("1-URGENT", "5-LOW") & (F.dayofmonth("day") % 7 == 0) & F.year("day").isin(1995, 1996)).withColumn("steps", F.col("steps") + 1000)
    sinks.repair_days(late, path, subject_cols=SUBJECT)
    return spark.read.parquet(path).select("subject", "day", "steps", "score")


def broken_build(spark, sf):
    """A folder without the marker of a finished write is built again."""
    path, rows = stored(spark), table(spark, sf, "region").select("r_regionkey", "r_name")
    rows.limit(1).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return tables.read_or_build(spark, path, lambda: rows)


def bucketed(spark, sf):
    """Daily rows and their session counts as two tables of equal buckets, joined without a shuffle."""
    daily, sessions = inputs.subject_daily(spark, sf).select("subject", "day", "steps"), inputs.sessions(spark, sf)
    counts = sessions.groupBy(F.col("sport").alias("subject"), F.to_date("start_time").alias("day")).agg(F.count("*").alias("sessions"))
    for name, frame in (("bucketed_daily", daily), ("bucketed_counts", counts)):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        sinks.publish(frame, name, stored=True, buckets=8, bucket_by=("subject", "day"), path=stored(spark))
    return spark.table("bucketed_daily").hint("merge").join(spark.table("bucketed_counts"), ["subject", "day"], "left")


def exported(spark, sf):
    """The master with its quality columns as Parquet, by month, read back."""
    path, rows = stored(spark), master(spark, sf).withColumn("month", F.date_format("day", "yyyy-MM"))
    sinks.write_parquet(rows, path, quality=quality.quality_score(rows.drop("month")), partition_by=("month",))
    return spark.read.parquet(path).select("day", "steps", "score", *QUALITY_DOUBLES, "key_metrics_count", F.col("month").cast("string").alias("month"))


def mapped(spark, sf):
    """Sports of all sessions with names from a mapping file."""
    path = stored(spark)
    entries = {"1-URGENT": {"display_name": "Run", "category": "cardio"}, "5-LOW": {"display_name": "Walk", "category": "easy"}}
    spark.createDataFrame([(json.dumps({"unknown_activity_mappings": entries}),)], "value string").coalesce(1).write.text(path)
    mapping = tables.read_mapping(spark, path)
    return inputs.sessions(spark, sf).join(F.broadcast(mapping.select("sport", "display_name", "category")), "sport", "left").groupBy(
        "sport", "display_name", "category").agg(F.count("*").alias("sessions"))


TABLES = ("region", "nation", "customer", "orders", "lineitem", "events")


def extracted(spark, sf):
    """Columns of the tables by position."""
    return schema.extract_schema(spark, {t: table(spark, sf, t) for t in TABLES}).select("table", "position", "column")


def absent(spark, sf):
    required = spark.createDataFrame([("core", t) for t in (*TABLES, "sleep", "stress")], "source string, `table` string")
    return schema.missing_tables(required, extracted(spark, sf))


def prepared(spark, sf):
    """Durations as minutes, days without time, and rows that have them."""
    rows = inputs.sessions(spark, sf).select("activity_id", "sport", "start_time", "elapsed_time", "training_effect")
    rows = prep.strip_time(prep.duration_columns(rows, ["elapsed_time", "absent"]), "start_time")
    return prep.require_columns(rows, ["elapsed_time", "training_effect"])


def fallbacks(spark, sf):
    """Intensity minutes from each of the column sets that a table may have, and the first column that holds values."""
    rows = inputs.sessions(spark, sf).select(F.col("activity_id"), F.col("elapsed_time"), F.col("calories"))
    shapes = {
        "intensity": rows.withColumn("intensity_time", F.col("elapsed_time")),
        "parts": rows.withColumns({"moderate_activity_time": F.col("elapsed_time"), "vigorous_activity_time": F.col("calories")}),
        "yesterday": rows.withColumn("yesterday_activity_minutes", F.col("calories"))}
    out = None
    for name, frame in shapes.items():
        first = prep.first_with_values(frame.withColumn("empty", F.lit(None).cast("double")), ["absent", "empty", "calories"])
        one = frame.agg(F.count(prep.intensity_minutes(frame)).alias("n"), F.sum(prep.intensity_minutes(frame)).alias("minutes")).select(
            F.lit(name).alias("shape"), F.lit(first).alias("first_column"), "n", "minutes")
        out = one if out is None else out.unionByName(one)
    return out


def looked_back(spark, sf):
    """Orders of the last 10 days, 6 weeks and 3 months before a day, and days from each candidate column."""
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("string").alias("calendarDate"),
                                               F.col("o_orderdate").alias("timestamp"))
    by_text, by_time = normalize_day(orders.drop("timestamp")), normalize_day(orders.drop("calendarDate"))
    out = None
    for name, frame, back in (("days", by_text, {"days_back": 10}), ("weeks", by_time, {"weeks_back": 6}), ("months", by_text, {"months_back": 3})):
        one = prep.filter_by_date(frame, "day", now="1997-06-15 12:00:00", end="1997-06-15", **back).agg(
            F.count("*").alias("orders"), F.min("day").alias("first_day"), F.max("day").alias("last_day")).withColumn("back", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def clamped(spark, sf):
    """Coverage arguments taken from a table, whatever they are."""
    keys = table(spark, sf, "nation").select(F.collect_list("n_nationkey").alias("k")).first()["k"]     # 25 nations
    rows = [(k, *clamp_coverage_args(k * 40 - 100, k - 3, 5 - k)) for k in keys]
    return spark.createDataFrame(rows, "n_nationkey long, allowance long, gap long, edge long")


def report_rows(spark, sf):
    """Row counts of the parts of the quality report and of the full report."""
    out = None
    daily = inputs.subject_daily(spark, sf)
    parts = {f"quality_{k}": v for k, v in reports.quality_report(daily).items() if k in ("completeness", "domains", "duplicates", "text")}
    parts |= {f"full_{k}": v for k, v in reports.full_report(daily, subject_cols=SUBJECT).items() if k in ("trend_missing", "best_ranges")}
    for name, frame in parts.items():
        one = frame.agg(F.count("*").alias("rows")).select(F.lit(name).alias("part"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


_MINUTES = "CASE WHEN elapsed_time IS NOT NULL THEN split_part(elapsed_time, ':', 1)::DOUBLE * 60 + split_part(elapsed_time, ':', 2)::DOUBLE + split_part(elapsed_time, ':', 3)::DOUBLE / 60 END"
QUERIES = [
    Query("zoned_coverage", lambda s, d: zones.zoned_coverage(zoned(s, d), max_gap_minutes=GAP, edge_minutes=EDGE), ZONED_COVERAGE_SQL,
          ("day_hours", "coverage_hours", "coverage_pct", "total_missing_minutes"), 3),
    Query("first_local_day", lambda s, d: zones.first_per_local_day(zoned(s, d), ts="ts", subject_cols=SUBJECT).select(
        "subject", "day", "event_id", "zone", "day_minutes"),
          f"""WITH {ZONED_SQL} SELECT subject, day, event_id, zone, (end_us - start_us) / 60000000.0::DOUBLE AS day_minutes FROM bounds
QUALIFY row_number() OVER (PARTITION BY subject, day ORDER BY ts, event_id, value) = 1""", ("day_minutes",)),
    Query("repaired_days", repaired_days, f"""WITH {inputs.SUBJECT_DAILY_SQL} SELECT subject, day,
  CASE WHEN subject IN ('1-URGENT', '5-LOW') AND day(day) % 7 = 0 AND year(day) IN (1995, 1996) THEN steps + 1000 ELSE steps END AS steps, score FROM daily""", ("steps", "score")),
    Query("broken_build", broken_build, "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region"),
    Query("bucketed_join", bucketed, f"""WITH {inputs.SUBJECT_DAILY_SQL}, c AS (SELECT o_orderpriority AS subject, CAST(o_orderdate AS DATE) AS day, count(*) AS sessions
  FROM orders GROUP BY 1, 2) SELECT subject, day, steps, sessions FROM daily LEFT JOIN c USING (subject, day)""", ("steps",)),
    Query("exported_master", exported, f"""{MASTER_SQL}, {QUALITY_SQL} SELECT day, steps, score, {', '.join(QUALITY_DOUBLES)}, key_metrics_count,
  strftime(day, '%Y-%m') AS month FROM master LEFT JOIN quality USING (day)""", ("steps", "score", *QUALITY_DOUBLES)),
    Query("mapping_file", mapped, """SELECT o_orderpriority AS sport, CASE o_orderpriority WHEN '1-URGENT' THEN 'Run' WHEN '5-LOW' THEN 'Walk' END AS display_name,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'cardio' WHEN '5-LOW' THEN 'easy' END AS category, count(*) AS sessions FROM orders GROUP BY 1"""),
    Query("extracted_schema", extracted, f"""SELECT table_name AS "table", ordinal_position - 1::BIGINT AS position, column_name AS "column"
FROM information_schema.columns WHERE table_name IN ({', '.join(f"'{t}'" for t in TABLES)})"""),
    Query("absent_tables", absent, """SELECT 'core' AS source, unnest(['sleep', 'stress']) AS "table" """),
    Query("prepared_sessions", prepared, f"""WITH {inputs.SESSIONS_SQL} SELECT activity_id, sport, CAST(start_time AS DATE) AS start_time, {_MINUTES} AS elapsed_time, training_effect
FROM sessions WHERE elapsed_time IS NOT NULL AND training_effect IS NOT NULL""", ("elapsed_time", "training_effect")),
    Query("intensity_fallbacks", fallbacks, f"""WITH {inputs.SESSIONS_SQL}, m AS (SELECT {_MINUTES} AS m, calories FROM sessions)
SELECT 'intensity' AS shape, 'calories' AS first_column, count(m) AS n, sum(m) AS minutes FROM m
UNION ALL SELECT 'parts', 'calories', count(*), sum(coalesce(m, 0) + coalesce(calories, 0)) FROM m
UNION ALL SELECT 'yesterday', 'calories', count(calories), sum(calories) FROM m""", ("minutes",)),
    Query("looked_back", looked_back, """WITH o AS (SELECT CAST(o_orderdate AS DATE) AS day FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '1997-06-15'),
b AS (SELECT * FROM (VALUES ('days', TIMESTAMP '1997-06-05 12:00:00'), ('weeks', TIMESTAMP '1997-05-04 12:00:00'), ('months', TIMESTAMP '1997-03-15 12:00:00')) AS t(back, low))
SELECT back, count(*) AS orders, min(day) AS first_day, max(day) AS last_day FROM o JOIN b ON day::TIMESTAMP >= low GROUP BY back"""),
    Query("clamped_arguments", clamped, """SELECT n_nationkey::BIGINT AS n_nationkey, least(300, greatest(0, n_nationkey * 40 - 100))::BIGINT AS allowance,
  CASE WHEN n_nationkey - 3 >= 1 THEN n_nationkey - 3 ELSE 2 END::BIGINT AS gap, CASE WHEN 5 - n_nationkey >= 0 THEN 5 - n_nationkey ELSE 2 END::BIGINT AS edge FROM nation"""),
    Query("report_parts", report_rows),
]
