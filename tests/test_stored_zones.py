"""Stored days, bucketed joins, zones, and a package that reaches the workers."""

import datetime as dt
import os
import subprocess
import sys
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from dayloom.catalog import QUERIES
from dayloom.operators import zones
from dayloom.session import cut_lineage, scratch
from dayloom.sources import sinks, tables

UTC = dt.timezone.utc


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_bucketed_join_has_no_shuffle(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = QUERIES["bucketed_join"].run(spark, SF_SMALL)
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    for name in ("bucketed_daily", "bucketed_counts"):
        spark.sql(f"DROP TABLE {name}")


def test_repair_touches_its_months_only(spark):
    path = f"{folder()}/days"
    rows = [(s, dt.date(2024, m, d), float(d)) for s in ("a", "b") for m in (1, 2, 3) for d in (1, 15)]
    sinks.store_days(spark.createDataFrame(rows, "subject string, day date, steps double"), path)
    stamp = {m: os.stat(f"{path}/month=2024-{m}").st_mtime_ns for m in ("01", "03")}
    changed = [("a", dt.date(2024, 2, 15), 99.0), ("c", dt.date(2024, 2, 16), 1.0)]
    sinks.repair_days(spark.createDataFrame(changed, "subject string, day date, steps double"), path, subject_cols=("subject",))
    got = sorted((r.subject, r.day, r.steps) for r in spark.read.parquet(path).collect())
    assert got == sorted([r for r in rows if r[:2] != ("a", dt.date(2024, 2, 15))] + changed)
    assert stamp == {m: os.stat(f"{path}/month=2024-{m}").st_mtime_ns for m in stamp}


def test_a_broken_build_is_not_read(spark):
    path = f"{folder()}/master"
    good, bad = spark.range(5), spark.range(2)
    bad.write.parquet(path)
    os.remove(f"{path}/_SUCCESS")
    assert tables.read_or_build(spark, path, lambda: good).count() == 5
    assert tables.read_or_build(spark, path, lambda: bad).count() == 5


def test_days_of_23_and_25_hours(spark):
    def every(minutes, start, end):
        at, out = start, []
        while at < end:
            out.append(at)
            at += dt.timedelta(minutes=minutes)
        return out

    # the whole of two local days in Berlin, whose clocks change on both
    spring = every(1, dt.datetime(2024, 3, 30, 23, tzinfo=UTC), dt.datetime(2024, 3, 31, 22, tzinfo=UTC))
    autumn = every(1, dt.datetime(2024, 10, 26, 22, tzinfo=UTC), dt.datetime(2024, 10, 27, 23, tzinfo=UTC))
    rows = spark.createDataFrame([(t, "Europe/Berlin") for t in spring + autumn] + [(None, "UTC"), (spring[0], None)], "ts timestamp, zone string")
    got = {r.day: r for r in zones.zoned_coverage(rows).collect()}
    assert set(got) == {dt.date(2024, 3, 31), dt.date(2024, 10, 27)}
    assert [got[d].day_hours for d in sorted(got)] == [23.0, 25.0]
    assert all(r.has_full_coverage and r.gap_count == 0 and r.total_missing_minutes == 0 and r.coverage_pct > 99.9 for r in got.values())
    short = zones.zoned_coverage(rows.where(F.hour("ts") != 1)).collect()
    assert [r.gap_count for r in short] == [1, 1] and all(58 < r.total_missing_minutes <= 61 for r in short)


def test_workers_get_the_package():
    """A driver in another folder whose workers have no path to the package."""
    code = ("import sys; sys.path.insert(0, %r)\n"
            "from dayloom.session import build_session\nfrom pyspark.sql import functions as F\n"
            "spark = build_session(**{'spark.master': 'local[2]', 'spark.ui.enabled': 'false'})\n"
            "from dayloom.operators import lloyd\n"
            "df = spark.range(20).select(F.col('id').cast('double').alias('x'))\n"
            "print('settled', sorted(lloyd.fit_all(df, ['x'], [2]).centers[2].ravel().tolist()))\n") % os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=folder(), env=env, capture_output=True, text=True, timeout=300)
    assert "settled [4.5, 14.5]" in out.stdout, out.stderr[-2000:]


def test_scratch_removes_what_was_stored_inside(spark):
    kept = cut_lineage(spark.range(3))
    with scratch(spark):
        inside = cut_lineage(spark.range(4))
        (path,) = inside.inputFiles()[:1]
        assert inside.count() == 4 and os.path.exists(path.removeprefix("file://"))
    assert not os.path.exists(os.path.dirname(path.removeprefix("file://"))) and kept.count() == 3
