import datetime as dt

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from dayloom.functions.temporal import (
    duration_minutes, iso_week, iso_year, minutes_of, period_of_day, utc_day, wall_clock, weekday_name, weekday_number)
from dayloom.operators import daily as d
from dayloom.plans.master import build_master

D0 = dt.date(2024, 1, 1)


def day(i):
    return D0 + dt.timedelta(days=i)


@pytest.mark.parametrize("text,minutes", [
    ("1:30:00", 90.0), ("00:45:30", 45.5), ("45:30", 45.5), (" 5 ", 5.0), ("12.5", 12.5), ("-3", -3.0), ("1e2", 100.0),
    ("0:00:00", 0.0), ("+1:00:00", 60.0), ("-1:30", -0.5), ("100:00:00", 6000.0),
    ("", None), ("   ", None), (None, None), ("abc", None), ("1:xx:00", None), ("1:2:3:4", None), ("inf", None),
    ("nan", None), ("1.5:30", None), (":", None), ("1::2", None),
])
def test_duration_minutes(spark, text, minutes):
    got = spark.createDataFrame([(text,)], "t string").select(duration_minutes("t")).first()[0]
    assert got == minutes


def test_minutes_of_any_type(spark):
    df = spark.sql("select interval '1 02:30:30' day to second as a, '2:00:00' as b, cast(7 as int) as c")
    assert df.select(*[minutes_of(df, c) for c in "abc"]).first()[:] == (1590.5, 120.0, 7.0)


def test_zones(spark):
    df = spark.createDataFrame([("2024-01-01 23:30:00-05:00",), ("2024-01-01T01:00:00Z",), ("x",), (None,)], "t string")
    got = df.select(utc_day("t"), wall_clock("t")).collect()
    assert got[0][:] == (dt.date(2024, 1, 2), dt.datetime(2024, 1, 1, 23, 30))
    assert got[1][:] == (dt.date(2024, 1, 1), dt.datetime(2024, 1, 1, 1))
    assert got[2][:] == got[3][:] == (None, None)


def test_calendar_parts(spark):
    df = spark.createDataFrame([(dt.date(2024, 12, 29),), (dt.date(2024, 12, 30),)], "day date")
    got = df.select(weekday_number("day"), weekday_name("day"), iso_year("day"), iso_week("day")).collect()
    assert got[0][:] == (0, "Sunday", 2024, 52) and got[1][:] == (1, "Monday", 2025, 1)
    hours = spark.range(24).select(period_of_day(F.col("id")).alias("p")).collect()
    assert [h["p"] for h in hours] == (["night"] * 6 + ["morning"] * 6 + ["afternoon"] * 6 + ["evening"] * 5 + ["night"])


def test_first_row_per_day(spark):
    df = spark.createDataFrame([("p", day(0), 5, "x"), ("p", day(0), 3, "y"), ("p", None, 1, "z"), ("q", day(0), 9, "w")],
                               "subject string, day date, seq int, v string")
    got = {r["subject"]: r["v"] for r in d.first_row_per_day(df, subject_cols=["subject"], tie_break=["seq"]).collect()}
    assert got == {"p": "y", "q": "w"}
    assert d.first_row_per_day(df.select("day")).count() == 1


def test_normalize_day_picks_first_candidate(spark):
    df = spark.createDataFrame([("2024-01-05", "2024-02-01 10:00:00")], "calendarDate string, timestamp string")
    assert d.normalize_day(df).first()["day"] == dt.date(2024, 1, 5)
    assert d.normalize_day(df.drop("calendarDate")).first()["day"] == dt.date(2024, 2, 1)
    assert "day" not in d.normalize_day(df.select(F.lit(1).alias("x"))).columns


def test_sleep_rows_without_score_go(spark):
    df = spark.createDataFrame([(day(0), "7:30:00", "1:00:00", "80"), (day(1), "6:00:00", None, "0"), (day(2), "5:00:00", "x", None)],
                               "day date, total_sleep string, deep_sleep string, score string")
    rows = d.prepare_sleep(df).collect()
    assert rows == [Row(day=day(0), score=80.0, total_sleep_min=450.0, deep_sleep_min=60.0)]


def test_activity_minutes_of_nothing_is_zero(spark):
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, 7), None, None, None, None)],
                               "activity_id string, start_time timestamp_ntz, elapsed_time string, calories double, "
                               "training_effect double, anaerobic_training_effect double")
    r = d.daily_activity(df).first()
    assert (r["activity_count"], r["activity_minutes"], r["activity_calories"], r["training_effect"]) == (1, 0.0, 0.0, None)


def test_detail_mean_weighs_rows_not_sessions(spark):
    acts = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, 7)), ("b", dt.datetime(2024, 1, 1, 9))],
                                 "activity_id string, start_time timestamp_ntz")
    detail = spark.createDataFrame([("a", 10.0), ("a", 20.0), ("a", None), ("b", 60.0), ("zz", 1.0)], "activity_id string, steps double")
    r = d.daily_activity_detail(detail, acts).collect()
    assert len(r) == 1 and r[0]["steps_from_steps_activity"] == 30.0


def test_windows(spark):
    df = spark.createDataFrame([("p", day(0), 1.0), ("p", day(1), None), ("p", day(5), 4.0), ("q", day(1), 7.0)],
                               "subject string, day date, x double")
    keys = {"subject_cols": ["subject"]}
    rows = {(r["subject"], r["day"]): r["yesterday_x"] for r in d.yesterday(df, ["x", "absent"], **keys).collect()}
    assert rows == {("p", day(0)): None, ("p", day(1)): 1.0, ("p", day(5)): None, ("q", day(1)): None}
    rows = {(r["subject"], r["day"]): r["yesterday_x"] for r in d.yesterday(df, ["x"], calendar=True, **keys).collect()}
    assert rows[("p", day(1))] == 1.0 and rows[("p", day(5))] is None
    roll = {r["day"]: r["m"] for r in d.rolling_mean(df.where("subject='p'"), "x", 2, "m").collect()}
    assert roll == {day(0): 1.0, day(1): 1.0, day(5): 4.0}
    full = {r["day"]: r["m"] for r in d.rolling_mean(df.where("subject='p'"), "x", 2, "m", require_full=True).collect()}
    assert full == {day(0): None, day(1): None, day(5): None}


def source_tables(spark):
    seq = spark.range(10).withColumn("day", F.date_add(F.lit(D0), F.col("id").cast("int")))
    return {
        "daily_summary": seq.select("day", (5000 + 100 * F.col("id")).cast("double").alias("steps"),
                                    (2000 + 20 * (F.col("id") % 5)).cast("double").alias("calories_total")),
        "sleep": seq.where("id < 8").select("day", F.lit("6:30:00").alias("total_sleep"),
                                            (70 + F.col("id")).cast("double").alias("score")),
        "stress": seq.select((F.col("day").cast("timestamp_ntz") + F.expr("interval 8 hours")).alias("timestamp"),
                             (20 + F.col("id")).cast("double").alias("stress")),
        "resting_hr": seq.select("day", (60 + F.col("id") % 5).cast("double").alias("resting_heart_rate")),
        "days_summary": seq.select("day", F.lit(1.0).alias("steps"), F.lit(1500.0).alias("calories_bmr_avg")),
        "activities": seq.where("id % 2 = 0").select(
            F.col("id").cast("string").alias("activity_id"), F.lit("running").alias("sport"),
            (F.col("day").cast("timestamp_ntz") + F.expr("interval 7 hours")).alias("start_time"),
            F.lit("00:30:00").alias("elapsed_time"), F.lit(2.0).alias("training_effect"),
            F.lit(1.0).alias("anaerobic_training_effect"), F.lit(300.0).alias("calories")),
    }


def test_master_from_all_sources(spark):
    tables = source_tables(spark)
    master = build_master(tables)
    rows = {r["day"]: r for r in master.collect()}
    assert len(rows) == 10
    assert rows[day(3)]["yesterday_activity_minutes"] == 30.0 and rows[day(4)]["yesterday_activity_minutes"] is None
    assert rows[day(3)]["steps"] == 5300.0 and rows[day(3)]["steps_summary"] == 1.0
    assert rows[day(2)]["steps_avg_7d"] == 5100.0
    assert rows[day(9)]["missing_score"] and not rows[day(7)]["missing_score"]
    assert rows[day(1)]["missing_training_effect"] and rows[day(0)]["stress_duration"] == 1
    assert "has_24h_coverage" not in master.columns


def test_master_of_two_subjects_equals_each_alone(spark):
    tables = source_tables(spark)
    both = {n: t.withColumn("subject", F.lit("a")).unionByName(t.withColumn("subject", F.lit("b"))) for n, t in tables.items()}
    both["activities"] = both["activities"].withColumn("activity_id", F.concat("subject", "activity_id"))
    joint = build_master(both, subject_cols=["subject"])
    alone = build_master(tables)
    for s in "ab":
        mine = joint.where(F.col("subject") == s).select(*alone.columns)
        assert mine.exceptAll(alone).count() == 0 and mine.count() == 10


def test_master_with_daily_table_only(spark):
    out = build_master({"daily_summary": source_tables(spark)["daily_summary"].drop("steps")})
    r = out.first()
    assert r["steps"] is None and r["steps_avg_7d"] is None and r["missing_score"] and r["missing_training_effect"]


def test_detail_of_subjects_with_the_same_session_ids(spark):
    start = dt.datetime(2024, 1, 1, 8)
    sessions = spark.createDataFrame([("a", "1", start), ("b", "1", start)], "subject string, activity_id string, start_time timestamp_ntz")
    detail = spark.createDataFrame([("a", "1", 10.0), ("b", "1", 30.0)], "subject string, activity_id string, steps double")
    got = {r["subject"]: r["steps_from_steps_activity"] for r in d.daily_activity_detail(detail, sessions, subject_cols=["subject"]).collect()}
    assert got == {"a": 10.0, "b": 30.0}
    shared = d.daily_activity_detail(detail.where("subject = 'a'").drop("subject"), sessions, subject_cols=["subject"]).collect()
    assert {r["steps_from_steps_activity"] for r in shared} == {10.0}
