"""Filters, cleaning and typing of raw tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayloom.functions.quantiles import quantiles
from dayloom.functions.temporal import duration_minutes
from dayloom.operators.daily import numeric_columns
from dayloom.operators.quality import column_quantiles, present

# What stands for "no value" in raw exports.
PLACEHOLDER_TEXT = ("", "NA", "null", "None")
PLACEHOLDER_NUMBER = -1


def duration_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Listed text columns to minutes; columns that are numeric already stay as they are."""
    text = [c for c in columns if c in df.columns and isinstance(df.schema[c].dataType, T.StringType)]
    return df.withColumns({c: duration_minutes(c) for c in text}) if text else df


def strip_time(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.to_date(column))


def filter_by_date(
    df: DataFrame, column: str = "day", *, start: dt.date | str | None = None, end: dt.date | str | None = None,
    days_back: int | None = None, weeks_back: int | None = None, months_back: int | None = None,
    now: dt.datetime | str | None = None,
) -> DataFrame:
    """Inclusive date range; the first non-zero look-back, counted from ``now``, replaces ``start``.

    The bounds are constants of the column's own type, so they reach the scan.
    """
    is_date = isinstance(df.schema[column].dataType, T.DateType)
    low = F.lit(start).cast("timestamp_ntz") if start is not None else None
    anchor = F.lit(now).cast("timestamp_ntz") if now is not None else F.localtimestamp()
    if days_back or weeks_back:
        low = anchor - F.make_dt_interval(days=F.lit(days_back or 7 * weeks_back))
    elif months_back:
        low = anchor - F.make_interval(months=F.lit(months_back))
    out = df
    if low is not None:
        if is_date:     # the first midnight at or after the bound
            low = F.to_date(low + F.expr("INTERVAL '23:59:59.999999' HOUR TO SECOND"))
        out = out.where(F.col(column) >= low)
    if end is not None:
        out = out.where(F.col(column) <= F.lit(end).cast("date" if is_date else "timestamp_ntz"))
    return out


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop rows null in any required column; if a column is absent nothing is dropped."""
    if any(c not in df.columns for c in columns):
        return df
    return df.na.drop(subset=list(columns)) if columns else df


def coalesce_columns(df: DataFrame, out: str, *candidates: str) -> DataFrame:
    """First non-null of the candidates that exist, as ``out``; the other candidates are dropped."""
    found = [c for c in candidates if c in df.columns]
    if not found:
        return df
    return df.withColumn("_out", F.coalesce(*[F.col(c) for c in found])).drop(*found, out).withColumnRenamed("_out", out)


def blank_placeholders(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Placeholders and NaN to null; name ``columns`` where -1 is a real value elsewhere."""
    new = {}
    for f in df.schema.fields:
        if columns is not None and f.name not in columns:
            continue
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            new[f.name] = F.when(~c.isin(*PLACEHOLDER_TEXT), c)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            new[f.name] = F.when(~F.isnan(c) & (c != PLACEHOLDER_NUMBER), c)
        elif isinstance(f.dataType, T.NumericType):
            new[f.name] = F.when(c != PLACEHOLDER_NUMBER, c)
    return df.withColumns(new) if new else df


def numeric_text_to_double(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Text columns with at least one numeric value become double; one pass decides for all."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)
            and (columns is None or f.name in columns)]
    if not text:
        return df
    parsed = {c: F.trim(F.col(f"`{c}`")).try_cast("double") for c in text}
    seen = df.agg(*[F.max(parsed[c].isNotNull()).alias(f"_{i}") for i, c in enumerate(text)]).first()
    chosen = {c: parsed[c] for i, c in enumerate(text) if seen[i]}
    return df.withColumns(chosen) if chosen else df


def tighten_numeric(df: DataFrame, *, narrow: bool = False) -> DataFrame:
    """Columns whose values are all whole become long; others stay double, or float with ``narrow``."""
    columns = numeric_columns(df)
    if not columns:
        return df
    whole = df.agg(*[F.bool_and((F.col(c) == F.floor(c)) & (F.abs(F.col(c).cast("double")) < 9e18)).alias(f"_{i}")
                     for i, c in enumerate(columns)]).first()
    new = {}
    for i, c in enumerate(columns):
        if whole[i] is None:
            continue
        new[c] = F.col(c).cast("long" if whole[i] else "float" if narrow else "double")
    return df.withColumns(new) if new else df


def iqr_filter(df: DataFrame, columns: Sequence[str] | None = None, *, factor: float = 1.5,
               one_pass: bool = False, mode: str = "exact") -> DataFrame:
    """Drop rows outside the IQR fences; nulls stay.

    Column after column, each fence from the survivors of the one before, which
    needs one job per column.  ``one_pass`` takes every fence from the input and
    needs one job in all.
    """
    columns = list(columns or numeric_columns(df))

    def inside(c: str, q1: float, q3: float) -> Column:
        low, high = q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)
        return F.col(c).isNull() | F.col(c).between(low, high)

    if one_pass:
        fences = {r["column"]: r["q"] for r in column_quantiles(df, columns, [0.25, 0.75], mode=mode).collect()}
        for c, (q1, q3) in fences.items():
            df = df.where(inside(c, q1, q3))
        return df
    for c in columns:
        row = quantiles(df, [], c, [0.25, 0.75], mode=mode).first()
        if row is not None and row["n"]:
            df = df.where(inside(c, *row["q"]))
    return df


def normalize_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])


def clean(df: DataFrame, *, remove_outliers: bool = False, placeholder_columns: Sequence[str] | None = None,
          narrow: bool = False, one_pass: bool = False) -> DataFrame:
    """Placeholders, numeric text, types, optional IQR filter, names — in this order."""
    out = tighten_numeric(numeric_text_to_double(blank_placeholders(df, placeholder_columns)), narrow=narrow)
    if remove_outliers:
        out = iqr_filter(out, one_pass=one_pass)
    return normalize_names(out)


def modeling_set(
    daily: DataFrame, required: Sequence[str], *, require_24h: bool = False,
    min_coverage_pct: float | None = None, max_missing_share: float = 0.5,
) -> DataFrame:
    """Well covered rows with all required features, without sparse and helper columns."""
    out = daily
    if require_24h and "has_24h_coverage" in daily.columns:
        out = out.where(F.col("has_24h_coverage"))
    elif min_coverage_pct is not None and "coverage_pct" in daily.columns:
        out = out.where(F.col("coverage_pct") >= min_coverage_pct)
    needed = [c for c in required if c in out.columns]
    out = out.na.drop(subset=needed) if needed else out
    return drop_sparse_columns(out, max_missing_share)


def drop_sparse_columns(df: DataFrame, max_missing_share: float = 0.5) -> DataFrame:
    """Keep columns whose missing share is below the limit and that are no helper columns."""
    names = [c for c in df.columns if not c.startswith("missing_") and "Unnamed" not in c]
    row = df.agg(F.count("*").alias("n"),
                 *[F.count_if(present(df, c)).alias(f"_{i}") for i, c in enumerate(names)]).first()
    total = row["n"]
    keep = [c for i, c in enumerate(names) if total == 0 or (total - row[f"_{i}"]) / total < max_missing_share]
    return df.select(*keep)


def first_with_values(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """First candidate column that holds any value; one pass over those present."""
    found = [c for c in candidates if c in df.columns]
    if not found:
        return None
    row = df.agg(*[F.max(present(df, c)).alias(f"_{i}") for i, c in enumerate(found)]).first()
    return next((c for i, c in enumerate(found) if row[i]), None)


def intensity_minutes(df: DataFrame) -> Column | None:
    """Intensity minutes from whichever columns the table has, in order of preference."""
    def minutes(c: str) -> Column:
        return duration_minutes(c) if isinstance(df.schema[c].dataType, T.StringType) else F.col(c).cast("double")

    if "intensity_time" in df.columns:
        return minutes("intensity_time")
    if {"moderate_activity_time", "vigorous_activity_time"} <= set(df.columns):
        return (F.coalesce(minutes("moderate_activity_time"), F.lit(0.0))
                + F.coalesce(minutes("vigorous_activity_time"), F.lit(0.0)))
    if "yesterday_activity_minutes" in df.columns:
        return minutes("yesterday_activity_minutes")
    return None


def interactions(df: DataFrame) -> DataFrame:
    """Steps × stress and heart rate × stress, where the columns exist."""
    new = {}
    if {"steps", "stress_avg"} <= set(df.columns):
        new["steps_stress_interaction"] = F.col("steps") * F.col("stress_avg")
    if {"hr_avg", "stress_avg"} <= set(df.columns):
        new["hr_stress_interaction"] = F.col("hr_avg") * F.col("stress_avg")
    return df.withColumns(new) if new else df


# Parts of names that mark a column as no feature.
EXCLUDED_NAME_PARTS = ("time", "start", "end", "duration")


def select_features(
    df: DataFrame, preferred: Sequence[str] | None = None, *, min_values: int = 50, exclude: Sequence[str] = (),
    fallback: int = 5, min_features: int = 3, skip_time_names: bool = False,
) -> list[str]:
    """Preferred numeric columns with enough values; if too few, the first ``fallback`` numeric ones with enough."""
    numeric = [c for c in numeric_columns(df) if c not in exclude]
    if skip_time_names:
        numeric = [c for c in numeric if not any(p in c.lower() for p in EXCLUDED_NAME_PARTS)]
    wanted = [c for c in numeric if preferred is None or c in preferred]
    if not numeric:
        return []
    row = df.agg(*[F.count_if(present(df, c)).alias(f"_{i}") for i, c in enumerate(numeric)]).first()
    enough = {c for i, c in enumerate(numeric) if row[i] >= min_values}
    chosen = [c for c in wanted if c in enough]
    if preferred is None or len(chosen) >= min_features:
        return chosen
    return [c for c in numeric if c in enough][:fallback]


def resolve_target(df: DataFrame, target: str, *, min_target: int = 20, min_other: int = 50,
                   exclude: Sequence[str] = ("day", "date")) -> str:
    """The wanted target if it has enough values, else the most complete numeric column."""
    numeric = [c for c in numeric_columns(df) if c not in exclude]
    row = df.agg(*[F.count_if(present(df, c)).alias(f"_{i}") for i, c in enumerate(numeric)]).first()
    counts = {c: row[i] for i, c in enumerate(numeric)}
    if counts.get(target, 0) >= min_target:
        return target
    other = [(n, -numeric.index(c), c) for c, n in counts.items() if n >= min_other]
    if not other:
        raise ValueError(f"no target column with at least {min_other} values")
    return max(other)[2]


def last_days(df: DataFrame, n: int = 30, *, day: str = "day", subject_cols: Sequence[str] = ()) -> DataFrame:
    """Rows less than ``n`` days older than the newest day of the table, or of the subject."""
    return _against_newest(df, day, subject_cols, lambda d, newest: d >= F.date_sub(newest, n))


def last_full_month(df: DataFrame, *, day: str = "day", subject_cols: Sequence[str] = ()) -> DataFrame:
    """Rows of the calendar month before that of the newest day."""
    def in_month(d: Column, newest: Column) -> Column:
        first = F.trunc(newest, "month")
        return (d >= F.add_months(first, -1)) & (d < first)

    return _against_newest(df, day, subject_cols, in_month)


def _against_newest(df: DataFrame, day: str, subject_cols: Sequence[str], rule) -> DataFrame:
    if subject_cols:
        newest = F.max(F.to_date(day)).over(Window.partitionBy(*subject_cols))
        return df.withColumn("_newest", newest).where(rule(F.to_date(day), F.col("_newest"))).drop("_newest")
    return df.where(rule(F.to_date(F.col(day)), df.agg(F.max(F.to_date(day))).scalar()))


def first_element(df: DataFrame, column: str) -> DataFrame:
    """List cells to their first element, other cells to numbers; rows without a number go."""
    kind = df.schema[column].dataType
    c = F.get(F.col(column), F.lit(0)) if isinstance(kind, T.ArrayType) else F.col(column)
    return df.withColumn(column, c.cast("string").try_cast("double")).where(F.col(column).isNotNull())


def value_or_default(mapping: Mapping[str, str], key: Column, default: str) -> Column:
    entries = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.create_map(*entries)[key], F.lit(default)) if entries else F.lit(default)
