"""Sports: names, colours, unknown types and the activity calendar."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Colour of well-known sports, then the colours handed to other sports in order of appearance.
SPORT_COLORS = {
    "running": "#FF6B6B",
    "cycling": "#4ECDC4",
    "fitness_equipment": "#45B7D1",
    "training": "#96CEB4",
    "soccer": "#FFEAA7",
    "rowing": "#DDA0DD",
    "walking": "#98D8C8",
    "generic": "#F7DC6F",
    "UnknownEnumValue_67": "#BDC3C7",
}
SPARE_COLORS = ("#FF9F43", "#10AC84", "#EE5A24", "#0984e3", "#6c5ce7",
                "#a29bfe", "#fd79a8", "#fdcb6e", "#e17055", "#00b894")
NO_ACTIVITY_COLOR, UNKNOWN_SPORT_COLOR = "#FFFFFF", "#E0E0E0"


def readable_name(sport: Column) -> Column:
    """Underscores to spaces and every run of letters capitalised."""
    runs = F.regexp_extract_all(F.replace(sport, F.lit("_"), F.lit(" ")), F.lit(r"(\p{L}+|[^\p{L}]+)"))
    return F.array_join(F.transform(runs, F.initcap), "")


def with_display_names(activities: DataFrame, mapping: DataFrame, *, sport: str = "sport") -> DataFrame:
    """Display name and description per row; unmapped sports get a readable form of their own name.

    The planner broadcasts the mapping when it is small and shuffles it, with
    skew handling, when it is not.
    """
    named = mapping.select(F.col("sport").alias("_sport"), F.col("display_name").alias("_name"),
                           F.col("description").alias("_description"))
    return (
        activities.join(named, F.col(sport) == F.col("_sport"), "left")
        .withColumn("display_name", F.coalesce("_name", readable_name(F.col(sport))))
        .withColumn("description", F.coalesce("_description", F.lit("")))
        .drop("_sport", "_name", "_description")
    )


def unmapped_sports(activities: DataFrame, mapping: DataFrame, *, sport: str = "sport") -> DataFrame:
    """Sports without a mapping and how often they occur; counted before the join."""
    counts = activities.where(F.col(sport).isNotNull()).groupBy(sport).agg(F.count("*").alias("activities"))
    return (
        counts.join(mapping.select(F.col("sport").alias(sport)), sport, "left_anti")
        .orderBy(F.desc("activities"), sport)
    )


def suggest_mappings(activities: DataFrame, mapping: DataFrame, *, sport: str = "sport") -> DataFrame:
    """A mapping row to fill in for every sport without one."""
    return unmapped_sports(activities, mapping, sport=sport).select(
        F.col(sport).alias("sport"), readable_name(F.col(sport)).alias("display_name"),
        F.lit("").alias("description"), F.lit("unknown").alias("category"), F.lit("#95A5A6").alias("color"), "activities")


def filter_sessions(
    activities: DataFrame, *, start: dt.date | str | None = None, end: dt.date | str | None = None,
    months: int | None = None, now: dt.datetime | str | None = None,
) -> DataFrame:
    """Sessions between start and end; ``months`` looks back that many times 30 days."""
    t = F.col("start_time")
    if months:
        anchor = F.lit(now).cast("timestamp_ntz") if now is not None else F.localtimestamp()
        activities = activities.where(t >= anchor - F.make_dt_interval(days=F.lit(30 * months)))
    if start is not None:
        activities = activities.where(t >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        activities = activities.where(t <= F.lit(end).cast("timestamp_ntz"))
    return activities


def darken(color: Column, factor: float = 0.3) -> Column:
    """Each channel of ``#rrggbb`` scaled down, in lower-case hex."""
    def channel(pos: int) -> Column:
        value = F.conv(F.substring(color, pos, 2), 16, 10).cast("int")
        return F.lpad(F.lower(F.hex(F.floor(value * (1 - factor)).cast("long"))), 2, "0")

    return F.concat(F.lit("#"), channel(2), channel(4), channel(6))


def activity_days(activities: DataFrame, *, subject_cols: Sequence[str] = ()) -> DataFrame:
    """First sport (by start time, then id) and session count per day."""
    return (
        activities.where(F.col("start_time").isNotNull())
        .groupBy(*subject_cols, F.to_date("start_time").alias("day"))
        .agg(F.min_by("sport", F.struct("start_time", "activity_id")).alias("sport"),
             F.count("*").alias("activity_count"))
    )


def sport_colors(activities: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """Colour per sport: mapping, fixed colours, then spare colours in order of first appearance."""
    firsts = activities.where(F.col("sport").isNotNull()).groupBy("sport").agg(
        F.min(F.struct("start_time", "activity_id")).alias("_first"))
    fixed = F.create_map(*[F.lit(x) for kv in SPORT_COLORS.items() for x in kv])[F.col("sport")]
    if mapping is not None:
        firsts = firsts.join(mapping.select("sport", F.col("color").alias("_mapped")), "sport", "left")
        fixed = F.coalesce(F.col("_mapped"), fixed)
    firsts = firsts.withColumn("_fixed", fixed)
    # one row per sport, not per session
    nth = F.row_number().over(Window.partitionBy(F.col("_fixed").isNull()).orderBy("_first")) - 1
    spare = F.get(F.array(*[F.lit(c) for c in SPARE_COLORS]), F.pmod(nth, F.lit(len(SPARE_COLORS))))
    return firsts.select("sport", F.coalesce("_fixed", spare).alias("color"))


def activity_calendar(activities: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """Every day of the Monday-aligned weeks from first to last session, with its sport and colour."""
    days = activity_days(activities)
    span = days.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).where(F.col("lo").isNotNull())
    spine = span.select(
        F.explode(F.sequence(
            F.trunc("lo", "week"), F.date_add(F.trunc("hi", "week"), 6), F.expr("INTERVAL 1 DAY"))).alias("day"),
        F.trunc("lo", "week").alias("_start"))
    colored = days.join(sport_colors(activities, mapping), "sport", "left")
    offset = F.datediff("day", "_start")
    base = F.coalesce("color", F.lit(UNKNOWN_SPORT_COLOR))
    return spine.join(colored, "day", "left").select(
        "day", F.floor(offset / 7).cast("int").alias("week"), F.pmod(offset, F.lit(7)).alias("weekday"),
        "sport", F.coalesce("activity_count", F.lit(0)).alias("activity_count"),
        F.when(F.col("activity_count").isNull(), NO_ACTIVITY_COLOR)
        .when((F.col("activity_count") > 1) & F.col("color").isNotNull(), darken(base))
        .otherwise(base).alias("color"))


def activity_summary(activities: DataFrame) -> DataFrame:
    """Active days, days in the span, and the active share in percent."""
    days = activity_days(activities)
    total = F.datediff(F.max("day"), F.min("day")) + 1
    return days.agg(F.count("*").alias("active_days"), total.alias("total_days"),
                    (F.count("*") / total * 100).alias("active_pct"))


def sport_days(activities: DataFrame) -> DataFrame:
    """Days per first sport."""
    return activity_days(activities).groupBy("sport").agg(F.count("*").alias("days")).orderBy(F.desc("days"), "sport")


def mark_days(series: DataFrame, marked: DataFrame, *, day: str = "day", subject_cols: Sequence[str] = (),
              flag: str = "is_anomaly") -> DataFrame:
    """Flag the rows of a daily series whose day is listed."""
    keys = [*subject_cols, day]
    hits = marked.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return series.join(hits, keys, "left").withColumn(flag, F.coalesce("_hit", F.lit(False))).drop("_hit")
