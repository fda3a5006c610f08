"""The daily row: per-source aggregation, the join chain, lags and flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayloom.functions.temporal import duration_minutes, minutes_of

# The activity columns whose previous row is carried as "yesterday".
LAGGED_ACTIVITY = ("had_workout", "activity_minutes", "activity_calories", "training_effect", "anaerobic_te")
SLEEP_DURATIONS = ("total_sleep", "deep_sleep", "rem_sleep")


def first_row_per_day(
    df: DataFrame, *, day: str = "day", subject_cols: Sequence[str] = (), tie_break: Sequence[str] = (),
) -> DataFrame:
    """One row per subject and day: the smallest by ``tie_break`` (all other columns if none given).

    An aggregate with map-side combine, so thousands of copies of a day are
    dropped before the shuffle.
    """
    keys = [*subject_cols, day]
    rest = [c for c in df.columns if c not in keys]
    order = [*tie_break, *[c for c in rest if c not in tie_break]]
    picked = (
        df.where(F.col(day).isNotNull()).groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row") if rest else F.count("*").alias("_row"))
    )
    return picked.select(*[F.col(c) if c in keys else F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def normalize_day(df: DataFrame, *, candidates: Sequence[str] = ("day", "calendarDate", "timestamp")) -> DataFrame:
    """Set ``day`` from the first candidate column the table has; none leaves it unchanged."""
    source = next((c for c in candidates if c in df.columns), None)
    if source is None:
        return df
    c = F.col(source)
    if isinstance(df.schema[source].dataType, T.StringType):
        c = c.try_cast("timestamp")
    return df.withColumn("day", F.to_date(c))


def daily_stress(
    samples: DataFrame, *, ts: str = "ts", value: str = "stress", day: str = "day", subject_cols: Sequence[str] = (),
) -> DataFrame:
    """Mean and maximum stress and the number of samples above zero."""
    return (
        samples.where(F.col(ts).isNotNull())
        .groupBy(*subject_cols, F.to_date(ts).alias(day))
        .agg(
            F.avg(value).alias("stress_avg"),
            F.max(value).alias("stress_max"),
            F.count_if(F.col(value) > 0).alias("stress_duration"),
        )
    )


def prepare_sleep(sleep: DataFrame) -> DataFrame:
    """Durations as ``*_min`` minutes; rows whose score is missing or not above zero go."""
    present = [c for c in SLEEP_DURATIONS if c in sleep.columns]
    out = sleep.withColumns({f"{c}_min": minutes_of(sleep, c) for c in present}).drop(*present)
    if "score" in out.columns:
        out = out.withColumn("score", F.col("score").cast("string").try_cast("double")).where(F.col("score") > 0)
    return out


def daily_activity(
    activities: DataFrame, *, day: str = "day", subject_cols: Sequence[str] = (), elapsed: Column | None = None,
) -> DataFrame:
    """Workout flag, session count, minutes, calories and mean training effects per day."""
    minutes = duration_minutes("elapsed_time") if elapsed is None else elapsed
    return (
        activities.where(F.col("start_time").isNotNull())
        .groupBy(*subject_cols, F.to_date("start_time").alias(day))
        .agg(
            F.lit(1).alias("had_workout"),
            F.count("activity_id").alias("activity_count"),
            F.coalesce(F.sum(minutes), F.lit(0.0)).alias("activity_minutes"),
            F.coalesce(F.sum("calories"), F.lit(0)).cast("double").alias("activity_calories"),
            F.avg("training_effect").alias("training_effect"),
            F.avg("anaerobic_training_effect").alias("anaerobic_te"),
        )
    )


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def daily_activity_detail(
    details: DataFrame, activities: DataFrame, *, day: str = "day", subject_cols: Sequence[str] = (),
) -> DataFrame:
    """Daily mean of every numeric detail column; the day comes from the session.

    Details are summed per session before the join, so a session with many
    detail rows joins as one row.  A session is known by its id and, where the
    details have them, the subject columns: subjects may use the same ids.
    """
    columns = numeric_columns(details, exclude=["activity_id", *subject_cols])
    keys = [*[c for c in subject_cols if c in details.columns], "activity_id"]
    per_session = details.groupBy(*keys).agg(
        *[F.sum(c).alias(f"_s_{c}") for c in columns], *[F.count(c).alias(f"_n_{c}") for c in columns])
    sessions = activities.select("activity_id", *subject_cols, F.to_date("start_time").alias(day))
    out = (
        per_session.join(sessions, keys).where(F.col(day).isNotNull())
        .groupBy(*subject_cols, day)
        .agg(*[(F.sum(f"_s_{c}") / F.when(F.sum(f"_n_{c}") > 0, F.sum(f"_n_{c}"))).alias(c) for c in columns])
    )
    return out.withColumnRenamed("steps", "steps_from_steps_activity")


def left_join_daily(
    left: DataFrame, right: DataFrame, *, source: str, day: str = "day", subject_cols: Sequence[str] = (),
    as_suffix: bool = False,
) -> DataFrame:
    """Left join on (subject, day); a clashing right column is renamed after its source."""
    keys = [*subject_cols, day]
    clash = [c for c in right.columns if c in left.columns and c not in keys]
    renamed = right.withColumnsRenamed({c: f"{c}_{source}" if as_suffix else f"{source}_{c}" for c in clash})
    return left.join(renamed, keys, "left")


def subject_window(day: str, subject_cols: Sequence[str]) -> Window:
    return Window.partitionBy(*subject_cols).orderBy(day) if subject_cols else Window.partitionBy(F.lit(0)).orderBy(day)


def yesterday(
    daily: DataFrame, columns: Sequence[str] = LAGGED_ACTIVITY, *, day: str = "day",
    subject_cols: Sequence[str] = (), calendar: bool = False,
) -> DataFrame:
    """``yesterday_*``: the previous row, or with ``calendar`` the previous date only."""
    w = subject_window(day, subject_cols)
    follows = F.datediff(F.col(day), F.lag(day).over(w)) == 1
    new = {}
    for c in columns:
        if c in daily.columns:
            previous = F.lag(c).over(w)
            new[f"yesterday_{c}"] = F.when(follows, previous) if calendar else previous
    return daily.withColumns(new) if new else daily


def rolling_mean(
    daily: DataFrame, column: str, rows: int, out: str, *, day: str = "day",
    subject_cols: Sequence[str] = (), require_full: bool = False,
) -> DataFrame:
    """Mean over the last ``rows`` rows; ``require_full`` gives null until they are all there and non-null."""
    w = subject_window(day, subject_cols).rowsBetween(-(rows - 1), 0)
    mean = F.avg(column).over(w)
    if require_full:
        mean = F.when(F.count(column).over(w) == rows, mean)
    return daily.withColumn(out, mean)


def missing_flags(daily: DataFrame, columns: Sequence[str] = ("score", "training_effect")) -> DataFrame:
    return daily.withColumns(
        {f"missing_{c}": F.col(c).isNull() if c in daily.columns else F.lit(True) for c in columns})
