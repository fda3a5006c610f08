"""Durations, days, weekdays and week keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WEEKDAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")

# Hours of each period of the day, both ends included; all other hours are night.
PERIODS = (("morning", 6, 11), ("afternoon", 12, 17), ("evening", 18, 22))

MICROS_PER_MINUTE = 60_000_000
MICROS_PER_DAY = 1440 * MICROS_PER_MINUTE


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def duration_minutes(c: Column | str) -> Column:
    """``H:M:S``, ``M:S`` or numeric text to minutes; blank, malformed or infinite is null."""
    text = F.trim(as_col(c).cast("string"))
    parts = F.split(text, ":")

    def whole(i: int) -> Column:
        return F.get(parts, F.lit(i)).try_cast("bigint")    # null unless a whole number

    number = text.try_cast("double")
    finite = ~F.isnan(number) & (F.abs(number) != F.lit(float("inf")))
    return (
        F.when(F.size(parts) == 3, whole(0) * 60 + whole(1) + whole(2) / 60)
        .when(F.size(parts) == 2, whole(0) + whole(1) / 60)
        .when((F.size(parts) == 1) & finite, number)
    )


def minutes_of(df: DataFrame, name: str) -> Column:
    """Minutes of a column whatever its type: interval, text, or already numeric."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.DayTimeIntervalType):
        secs = (F.extract(F.lit("DAY"), F.col(name)) * 86400
                + F.extract(F.lit("HOUR"), F.col(name)) * 3600
                + F.extract(F.lit("MINUTE"), F.col(name)) * 60
                + F.extract(F.lit("SECOND"), F.col(name)))
        return secs.cast("double") / 60
    if isinstance(kind, T.StringType):
        return duration_minutes(name)
    return F.col(name).cast("double")


def utc_day(c: Column | str) -> Column:
    """Calendar day in UTC of text that may carry an offset; unparseable is null.

    The session zone has to be UTC, as ``SETTINGS`` makes it.
    """
    return F.to_date(as_col(c).cast("string").try_cast("timestamp"))


def wall_clock(c: Column | str) -> Column:
    """Timestamp with any offset dropped and the local reading kept."""
    text = as_col(c).cast("string")
    bare = F.regexp_replace(F.trim(text), r"(Z|[+-]\d{2}:?\d{2})$", "")
    return bare.try_cast("timestamp_ntz")


def micros_of_day(ts: Column | str) -> Column:
    """Microseconds since midnight of ``ts``; the session zone has to be UTC, as ``SETTINGS`` makes it."""
    t = as_col(ts).cast("timestamp")
    return F.unix_micros(t) - F.unix_micros(F.to_date(t).cast("timestamp"))


def weekday_number(day: Column | str) -> Column:
    """Sunday = 0 ... Saturday = 6."""
    return F.dayofweek(as_col(day)) - 1


def weekday_name(day: Column | str) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), F.dayofweek(as_col(day)))


def iso_year(day: Column | str) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), as_col(day)).cast("int")


def iso_week(day: Column | str) -> Column:
    return F.weekofyear(as_col(day)).cast("int")


def period_of_day(hour: Column | str) -> Column:
    h = as_col(hour)
    label = F.lit("night")
    for name, first, last in reversed(PERIODS):
        label = F.when(h.between(first, last), name).otherwise(label)
    return F.when(h.isNotNull(), label)
