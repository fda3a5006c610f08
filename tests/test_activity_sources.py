import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from dayloom.operators import activity as act
from dayloom.operators.quality import quality_score
from dayloom.sources import schema, sinks, tables

T0 = dt.datetime(2024, 5, 1, 8)
MAPPING = {"kite_3": {"display_name": "Kite Surfing", "description": "on the lake", "category": "water", "color": "#123ABC"}}


@pytest.fixture(scope="module")
def sessions(spark):
    rows = [("1", "running", T0), ("2", "cycling", T0 + dt.timedelta(hours=1)), ("3", "trail_running", T0 + dt.timedelta(days=2)),
            ("4", "kite_3", T0 + dt.timedelta(days=9)), ("5", "yoga", T0 + dt.timedelta(days=10)),
            ("6", "trail_running", T0 + dt.timedelta(days=11))]
    return spark.createDataFrame(rows, "activity_id string, sport string, start_time timestamp_ntz")


@pytest.fixture(scope="module")
def mapping(spark):
    return tables.mapping_from(spark, MAPPING)


def test_display_names(sessions, mapping):
    got = {r["sport"]: (r["display_name"], r["description"]) for r in act.with_display_names(sessions, mapping).collect()}
    assert got["kite_3"] == ("Kite Surfing", "on the lake") and got["trail_running"] == ("Trail Running", "")


def test_unmapped(sessions, mapping):
    assert [tuple(r) for r in act.unmapped_sports(sessions, mapping).collect()] == [
        ("trail_running", 2), ("cycling", 1), ("running", 1), ("yoga", 1)]
    assert act.suggest_mappings(sessions, mapping).first()["display_name"] == "Trail Running"


def test_colors_by_first_appearance(sessions, mapping):
    got = {r["sport"]: r["color"] for r in act.sport_colors(sessions, mapping).collect()}
    assert got == {"running": "#FF6B6B", "cycling": "#4ECDC4", "kite_3": "#123ABC", "trail_running": "#FF9F43", "yoga": "#10AC84"}


def test_calendar(sessions):
    rows = {r["day"]: r for r in act.activity_calendar(sessions).collect()}
    assert min(rows) == dt.date(2024, 4, 29) and max(rows) == dt.date(2024, 5, 12) and len(rows) == 14
    assert rows[dt.date(2024, 5, 1)]["color"] == "#b24a4a" and rows[dt.date(2024, 5, 1)]["activity_count"] == 2
    assert rows[dt.date(2024, 5, 2)]["color"] == "#FFFFFF" and rows[dt.date(2024, 5, 2)]["activity_count"] == 0
    assert rows[dt.date(2024, 5, 6)]["week"] == 1 and rows[dt.date(2024, 5, 6)]["weekday"] == 0
    assert act.activity_calendar(sessions.limit(0)).count() == 0


def test_summary_and_days(sessions):
    r = act.activity_summary(sessions).first()
    assert (r["active_days"], r["total_days"]) == (5, 12) and r["active_pct"] == pytest.approx(500 / 12)
    assert act.sport_days(sessions).first()[:] == ("trail_running", 2)
    assert act.filter_sessions(sessions, months=1, now="2024-06-05 08:00:00").count() == 3
    assert act.filter_sessions(sessions, start="2024-05-03", end="2024-05-11").count() == 2


def test_marked_days_do_not_multiply(spark):
    series = spark.createDataFrame([(dt.date(2024, 1, i),) for i in (1, 2)], "day date")
    marked = spark.createDataFrame([(dt.date(2024, 1, 2),)] * 3, "day date")
    assert [r["is_anomaly"] for r in act.mark_days(series, marked).orderBy("day").collect()] == [False, True]


def test_missing_path_is_empty_of_the_schema(spark, tmp_path):
    bundle = tables.read_bundle(spark, str(tmp_path), subject_cols=["subject"])
    assert set(bundle) == set(tables.CORE_TABLES) and bundle["sleep"].columns[0] == "subject"
    assert all(t.count() == 0 for t in bundle.values())
    assert tables.read_quality(spark, str(tmp_path / "q")).columns[1] == "data_quality_score"


def test_scan_pushes_filter_and_projection(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    plan = tables.read_samples(table, ts="ts", value="value")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(value)]" in plan and "ReadSchema: struct<ts:timestamp_ntz,value:double>" in plan


def test_read_or_build_builds_once(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    path = str(tmp_path / "master")
    assert tables.read_or_build(spark, path, build).count() == 3
    assert tables.read_or_build(spark, path, build).count() == 3 and built == [1]


def test_mapping_file(spark, tmp_path):
    path = tmp_path / "map.json"
    path.write_text(json.dumps({"unknown_activity_mappings": MAPPING, "activity_categories": {"x": {}}}, indent=2))
    assert tables.read_mapping(spark, str(path)).first().asDict() == {"sport": "kite_3", **MAPPING["kite_3"]}
    assert tables.read_mapping(spark, str(tmp_path / "none.json")).count() == 0


def test_sinks_round_trip(spark, tmp_path):
    daily = spark.createDataFrame([(dt.date(2024, 1, 1), 100.0, 1)], "day date, steps double, key_metrics_total int")
    quality = quality_score(daily)
    sinks.write_parquet(daily, str(tmp_path / "p"), quality=quality)
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.columns.count("key_metrics_total") == 1 and back.first()["completeness_score"] == 100.0
    sinks.write_csv(daily, str(tmp_path / "c"))
    assert tables.read_master_csv(spark, str(tmp_path / "c"), daily.schema).first()["day"] == dt.date(2024, 1, 1)
    sinks.write_results({"a": daily}, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r/a")).count() == 1
    sinks.write_quality(daily, str(tmp_path / "q"))
    assert tables.read_quality(spark, str(tmp_path / "q")).count() == 1
    sinks.publish(daily, "master_view")
    assert spark.sql("select max(steps) from master_view").first()[0] == 100.0


def test_bucketed_tables_join_without_shuffle(spark):
    df = spark.range(100).select(F.col("id").alias("subject"), F.lit(1.0).alias("v"))
    for name in ("bucketed_a", "bucketed_b"):
        sinks.publish(df, name, stored=True, buckets=4, bucket_by=["subject"])
    joined = spark.table("bucketed_a").join(spark.table("bucketed_b").hint("merge"), "subject")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 100 and "SortMergeJoin" in plan and "Exchange" not in plan
    for name in ("bucketed_a", "bucketed_b"):
        spark.sql(f"drop table {name}")


def test_schema_drift(spark):
    expected = schema.schema_from(spark, {"daily": [("day", "DATE"), ("steps", "INTEGER"), ("gone", "TEXT")], "lost": [("a", "TEXT")]})
    actual = schema.schema_from(spark, {"daily": [("day", "date"), ("steps", "REAL"), ("new", "TEXT")], "extra": [("b", "TEXT")]})
    drift = schema.schema_drift(expected, actual)
    assert {(r["table"], r["kind"], r["column"]) for r in drift.collect()} == {
        ("daily", "missing_column", "gone"), ("daily", "type_mismatch", "steps"), ("daily", "extra_column", "new"),
        ("lost", "missing_column", "a"), ("extra", "extra_column", "b")}
    report = {r["table"]: r for r in schema.drift_report(drift).collect()}
    assert report["daily"]["missing_columns"] == ["gone"] and report["daily"]["type_mismatches"][0]["actual_type"] == "REAL"
    assert schema.schema_drift(expected, expected).count() == 0


def test_extract_and_required(spark):
    actual = schema.extract_schema(spark, {"t": spark.range(1), "u": spark.createDataFrame([("a",)], "s string")})
    assert [tuple(r) for r in actual.orderBy("table").collect()] == [("t", 0, "id", "bigint"), ("u", 0, "s", "string")]
    required = spark.createDataFrame([("main", "t"), ("main", "zz")], "source string, `table` string")
    assert [tuple(r) for r in schema.missing_tables(required, actual).collect()] == [("main", "zz")]


def test_audit(spark):
    nulls = spark.range(7).select(F.lit(None).cast("double").alias("v"), F.lit(None).cast("string").alias("w"))
    got = {r["table"]: (r["rows"], r["status"]) for r in schema.audit_tables(
        spark, {"ok": spark.range(3), "nulls": nulls, "empty": spark.range(0), "none": None}).collect()}
    assert got == {"ok": (3, "ok"), "nulls": (7, "all null or empty"), "empty": (0, "all null or empty"), "none": (None, "not found")}
    assert schema.preview(spark.range(9), ["id", "nope"]).count() == 3


def test_audit_looks_at_all_rows(spark):
    late = spark.createDataFrame([(None,)] * 5 + [(1,)] * 100, "x int").coalesce(1)
    got = {r["table"]: (r["rows"], r["status"]) for r in schema.audit_tables(spark, {"late": late, "nulls": late.where("x is null")}).collect()}
    assert got == {"late": (105, "ok"), "nulls": (5, "all null or empty")}


def test_preview_in_order(spark):
    assert [r["id"] for r in schema.preview(spark.range(50).orderBy("id", ascending=False), ["id", "no"], 3, order_by=["id"]).collect()] == [0, 1, 2]
