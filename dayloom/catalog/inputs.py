"""The shared test tables in the roles of wearable data, as frames and as SQL.

Every ``*_SQL`` text is a list of common table expressions that says the same as
the function beside it.  Nulls are made by rule because the tables have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayloom.catalog.base import table

# events as heart-rate and stress samples of many subjects
SAMPLES_SQL = """samples AS (
  SELECT user_id AS subject, ts, value AS stress, value AS heart_rate, event_type AS kind, event_id FROM events)"""


def samples(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("user_id").alias("subject"), "ts", F.col("value").alias("stress"),
        F.col("value").alias("heart_rate"), F.col("event_type").alias("kind"), "event_id")


def _daily_sql(subject: str, group: str) -> str:
    return f"""
  SELECT {subject} CAST(o_orderdate AS DATE) AS day,
    max(CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END) / 5000 AS score,
    max(o_totalprice) / 10 AS steps,
    count(CASE WHEN o_totalprice > 200000 THEN 1 END) AS stress_duration,
    CAST(min(CASE WHEN o_orderkey % 5 <> 0 THEN 40 + o_custkey % 40 END) AS DOUBLE) AS resting_heart_rate,
    min(o_totalprice) / 5000 AS stress_avg,
    max(CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END) / 4000 AS bb_max,
    min(CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END) / 4000 AS bb_min,
    CAST(max(o_custkey % 3000) AS DOUBLE) AS hydration_intake
  FROM orders GROUP BY {group}"""


# orders as a daily table: of one subject, and with the order priority as subject
DAILY_SQL = f"daily AS ({_daily_sql('', '1')})"
SUBJECT_DAILY_SQL = f"daily AS ({_daily_sql('o_orderpriority AS subject,', '1, 2')})"


def _daily(orders: DataFrame, *keys) -> DataFrame:
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    return orders.groupBy(*keys, F.to_date("o_orderdate").alias("day")).agg(
        (F.max(F.when(key % 7 != 0, price)) / 5000).alias("score"),
        (F.max(price) / 10).alias("steps"),
        F.count_if(price > 200000).alias("stress_duration"),
        F.min(F.when(key % 5 != 0, 40 + F.col("o_custkey") % 40)).cast("double").alias("resting_heart_rate"),
        (F.min(price) / 5000).alias("stress_avg"),
        (F.max(F.when(key % 11 != 0, price)) / 4000).alias("bb_max"),
        (F.min(F.when(key % 3 != 0, price)) / 4000).alias("bb_min"),
        F.max(F.col("o_custkey") % 3000).cast("double").alias("hydration_intake"))


def daily(spark: SparkSession, sf: str) -> DataFrame:
    return _daily(table(spark, sf, "orders"))


def subject_daily(spark: SparkSession, sf: str) -> DataFrame:
    return _daily(table(spark, sf, "orders"), F.col("o_orderpriority").alias("subject"))


# orders as sessions, the priority as sport
SESSIONS_SQL = """sessions AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS activity_id, o_orderpriority AS sport, o_custkey AS subject,
    o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS start_time,
    CASE WHEN o_orderkey % 9 = 0 THEN NULL
         ELSE CAST(o_orderkey % 3 AS VARCHAR) || ':' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') || ':30' END
      AS elapsed_time,
    CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_custkey % 50 AS DOUBLE) / 10 END AS training_effect,
    CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_custkey % 30 AS DOUBLE) / 10 END AS anaerobic_training_effect,
    CAST(o_orderkey % 700 AS DOUBLE) AS calories
  FROM orders)"""


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf, "orders").select(
        key.cast("string").alias("activity_id"), F.col("o_orderpriority").alias("sport"), cust.alias("subject"),
        (F.col("o_orderdate") + F.make_dt_interval(hours=(key % 24).cast("int"))).alias("start_time"),
        F.when(key % 9 != 0, F.concat((key % 3).cast("string"), F.lit(":"),
                                      F.lpad((key % 60).cast("string"), 2, "0"), F.lit(":30"))).alias("elapsed_time"),
        F.when(key % 4 != 0, (cust % 50).cast("double") / 10).alias("training_effect"),
        F.when(key % 6 != 0, (cust % 30).cast("double") / 10).alias("anaerobic_training_effect"),
        (key % 700).cast("double").alias("calories"))


# events as heart rate on days that orders have too: 9497 days earlier is January 1998
MASTER_SQL = f"""{SESSIONS_SQL},
daily_summary AS (
  SELECT CAST(o_orderdate AS DATE) AS day, max(o_totalprice) / 10 AS steps, min(o_totalprice) / 100 AS calories_total
  FROM orders GROUP BY 1),
sleep AS (
  SELECT CAST(l_shipdate AS DATE) AS day,
    CAST(CAST(max(l_quantity) AS BIGINT) % 10 AS VARCHAR) || ':15:00' AS total_sleep,
    '1:' || lpad(CAST(CAST(min(l_quantity) AS BIGINT) AS VARCHAR), 2, '0') || ':00' AS deep_sleep,
    '0:45:30' AS rem_sleep,
    CASE WHEN CAST(max(l_partkey) AS BIGINT) % 5 = 0 THEN 0.0 ELSE CAST(max(l_partkey) % 100 AS DOUBLE) END AS score
  FROM lineitem GROUP BY 1),
stress AS (
  SELECT l_shipdate + to_hours(CAST(l_linenumber AS INTEGER)) AS "timestamp", l_quantity - 10 AS stress FROM lineitem),
resting_hr AS (
  SELECT CAST(o_orderdate AS DATE) AS day, CAST(min(40 + o_custkey % 40) AS DOUBLE) AS resting_heart_rate
  FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
days_summary AS (
  SELECT CAST(o_orderdate AS DATE) AS day, CAST(count(*) AS DOUBLE) AS steps, CAST(max(o_custkey) AS DOUBLE) AS calories_bmr_avg
  FROM orders WHERE o_orderstatus = 'O' GROUP BY 1),
steps_activities AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS activity_id, CASE WHEN l_linenumber <> 3 THEN l_quantity END AS steps,
    l_discount * 100 AS vo2_max FROM lineitem),
monitoring_hr AS (
  SELECT ts - to_days(9497) AS "timestamp", value AS heart_rate FROM events)"""


def master_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    orders, lines, events = (table(spark, sf, t) for t in ("orders", "lineitem", "events"))
    day, price, cust = F.to_date("o_orderdate").alias("day"), F.col("o_totalprice"), F.col("o_custkey")
    qty, part_key = F.col("l_quantity"), F.col("l_partkey")
    return {
        "daily_summary": orders.groupBy(day).agg(
            (F.max(price) / 10).alias("steps"), (F.min(price) / 100).alias("calories_total")),
        "sleep": lines.groupBy(F.to_date("l_shipdate").alias("day")).agg(
            F.concat((F.max(qty).cast("long") % 10).cast("string"), F.lit(":15:00")).alias("total_sleep"),
            F.concat(F.lit("1:"), F.lpad(F.min(qty).cast("long").cast("string"), 2, "0"), F.lit(":00")).alias("deep_sleep"),
            F.lit("0:45:30").alias("rem_sleep"),
            F.when(F.max(part_key) % 5 == 0, 0.0).otherwise((F.max(part_key) % 100).cast("double")).alias("score")),
        "stress": lines.select(
            (F.col("l_shipdate") + F.make_dt_interval(hours=F.col("l_linenumber"))).alias("timestamp"),
            (qty - 10).alias("stress")),
        "resting_hr": orders.where(F.col("o_orderstatus") == "F").groupBy(day).agg(
            F.min(40 + cust % 40).cast("double").alias("resting_heart_rate")),
        "days_summary": orders.where(F.col("o_orderstatus") == "O").groupBy(day).agg(
            F.count("*").cast("double").alias("steps"), F.max(cust).cast("double").alias("calories_bmr_avg")),
        "activities": sessions(spark, sf).drop("subject"),
        "steps_activities": lines.select(
            F.col("l_orderkey").cast("string").alias("activity_id"),
            F.when(F.col("l_linenumber") != 3, qty).alias("steps"), (F.col("l_discount") * 100).alias("vo2_max")),
        "monitoring_hr": events.select(
            (F.col("ts") - F.make_dt_interval(days=F.lit(9497))).alias("timestamp"), F.col("value").alias("heart_rate")),
    }


def _subject_sql(key: str) -> str:
    """One subject has a third of all rows, the others share the rest."""
    return f"CASE WHEN {key} % 3 = 0 THEN 'hot' ELSE 's' || CAST({key} % 50 AS VARCHAR) END"


# the same sources for many subjects, whose activities have the same ids
SUBJECT_MASTER_SQL = f"""o AS (SELECT *, {_subject_sql('o_orderkey')} AS subject FROM orders),
l AS (SELECT *, {_subject_sql('l_orderkey')} AS subject FROM lineitem),
sessions AS (
  SELECT subject, CAST(o_orderkey % 997 AS VARCHAR) AS activity_id, o_orderpriority AS sport,
    o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS start_time, '0:30:00' AS elapsed_time,
    CAST(o_custkey % 50 AS DOUBLE) / 10 AS training_effect, CAST(o_custkey % 30 AS DOUBLE) / 10 AS anaerobic_training_effect,
    CAST(o_orderkey % 700 AS DOUBLE) AS calories FROM o),
daily_summary AS (
  SELECT subject, CAST(o_orderdate AS DATE) AS day, max(o_totalprice) / 10 AS steps, min(o_totalprice) / 100 AS calories_total
  FROM o GROUP BY 1, 2),
sleep AS (
  SELECT subject, CAST(l_shipdate AS DATE) AS day, '7:15:00' AS total_sleep, '1:20:00' AS deep_sleep, '0:45:30' AS rem_sleep,
    CAST(max(l_partkey) % 100 AS DOUBLE) AS score FROM l GROUP BY 1, 2),
stress AS (
  SELECT subject, l_shipdate + to_hours(CAST(l_linenumber AS INTEGER)) AS "timestamp", l_quantity - 10 AS stress FROM l),
resting_hr AS (
  SELECT subject, CAST(o_orderdate AS DATE) AS day, CAST(min(40 + o_custkey % 40) AS DOUBLE) AS resting_heart_rate
  FROM o WHERE o_orderstatus = 'F' GROUP BY 1, 2),
days_summary AS (
  SELECT subject, CAST(o_orderdate AS DATE) AS day, CAST(count(*) AS DOUBLE) AS steps, CAST(max(o_custkey) AS DOUBLE) AS calories_bmr_avg
  FROM o WHERE o_orderstatus = 'O' GROUP BY 1, 2),
steps_activities AS (
  SELECT subject, CAST(l_orderkey % 997 AS VARCHAR) AS activity_id, l_quantity AS steps, l_discount * 100 AS vo2_max FROM l),
monitoring_hr AS (
  SELECT {_subject_sql('user_id')} AS subject, ts - to_days(9497) AS "timestamp", value AS heart_rate FROM events)"""


def subject_master_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    def owned(name: str, key: str) -> DataFrame:
        k = F.col(key)
        return table(spark, sf, name).withColumn(
            "subject", F.when(k % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (k % 50).cast("string"))))

    orders, lines, events = owned("orders", "o_orderkey"), owned("lineitem", "l_orderkey"), owned("events", "user_id")
    day, price, cust, key = F.to_date("o_orderdate").alias("day"), F.col("o_totalprice"), F.col("o_custkey"), F.col("o_orderkey")
    return {
        "daily_summary": orders.groupBy("subject", day).agg(
            (F.max(price) / 10).alias("steps"), (F.min(price) / 100).alias("calories_total")),
        "sleep": lines.groupBy("subject", F.to_date("l_shipdate").alias("day")).agg(
            F.lit("7:15:00").alias("total_sleep"), F.lit("1:20:00").alias("deep_sleep"), F.lit("0:45:30").alias("rem_sleep"),
            (F.max("l_partkey") % 100).cast("double").alias("score")),
        "stress": lines.select(
            "subject", (F.col("l_shipdate") + F.make_dt_interval(hours=F.col("l_linenumber"))).alias("timestamp"),
            (F.col("l_quantity") - 10).alias("stress")),
        "resting_hr": orders.where(F.col("o_orderstatus") == "F").groupBy("subject", day).agg(
            F.min(40 + cust % 40).cast("double").alias("resting_heart_rate")),
        "days_summary": orders.where(F.col("o_orderstatus") == "O").groupBy("subject", day).agg(
            F.count("*").cast("double").alias("steps"), F.max(cust).cast("double").alias("calories_bmr_avg")),
        "activities": orders.select(
            "subject", (key % 997).cast("string").alias("activity_id"), F.col("o_orderpriority").alias("sport"),
            (F.col("o_orderdate") + F.make_dt_interval(hours=(key % 24).cast("int"))).alias("start_time"),
            F.lit("0:30:00").alias("elapsed_time"), ((cust % 50).cast("double") / 10).alias("training_effect"),
            ((cust % 30).cast("double") / 10).alias("anaerobic_training_effect"), (key % 700).cast("double").alias("calories")),
        "steps_activities": lines.select(
            "subject", (F.col("l_orderkey") % 997).cast("string").alias("activity_id"), F.col("l_quantity").alias("steps"),
            (F.col("l_discount") * 100).alias("vo2_max")),
        "monitoring_hr": events.select(
            "subject", (F.col("ts") - F.make_dt_interval(days=F.lit(9497))).alias("timestamp"), F.col("value").alias("heart_rate")),
    }
