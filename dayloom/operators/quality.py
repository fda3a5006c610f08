"""Quality of daily rows and of whole tables.

Column statistics of a table come from one aggregate over all columns that is
then turned to one row per column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayloom.functions.quantiles import quantiles
from dayloom.operators.daily import numeric_columns

# The columns that count towards completeness; both spellings of a metric count.
KEY_METRICS = (
    "steps", "score", "stress_avg", "resting_heart_rate", "rhr", "calories_total",
    "body_battery_max", "bb_max", "body_battery_min", "bb_min",
)

# Lower bound of each completeness level.
COMPLETENESS_LEVELS = (
    (0.9, "Excellent (≥90%)"),
    (0.7, "Good (70-89%)"),
    (0.5, "Fair (50-69%)"),
    (0.3, "Poor (30-49%)"),
    (0.1, "Very Poor (10-29%)"),
    (0.0, "Critical (<10%)"),
)

# Health domain of a column, by the first domain with a keyword in its name.
DOMAIN_KEYWORDS = (
    ("activity", ("steps", "distance", "calories", "floors", "activity")),
    ("heart_rate", ("hr", "rhr", "heart_rate", "resting_heart_rate")),
    ("sleep", ("sleep", "rem", "deep", "awake", "light_sleep")),
    ("stress", ("stress", "recovery", "body_battery")),
    ("fitness", ("vo2_max", "training_effect", "fitness_age")),
    ("body", ("weight", "bmi", "body_fat", "muscle_mass")),
    ("nutrition", ("hydration", "sweat_loss", "calories_consumed")),
    ("time", ("time", "duration", "start", "end", "date")),
)

# Names that mark time columns and target columns.
TIME_WORDS = ("time", "date", "duration")
TARGET_WORDS = ("score", "target", "outcome")


def quality_score(
    daily: DataFrame, *, coverage_weight: float = 0.5, completeness_weight: float = 0.5,
    day: str = "day", subject_cols: Sequence[str] = (),
) -> DataFrame:
    """Score 0-100 per day from coverage and the share of key metrics present."""
    if "coverage_pct" in daily.columns:
        pct = F.nanvl(F.col("coverage_pct").cast("double"), F.lit(0.0))
        coverage = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.coalesce(pct, F.lit(0.0))))
    elif "has_24h_coverage" in daily.columns:
        coverage = F.when(F.col("has_24h_coverage"), 100.0).otherwise(0.0)
    else:
        coverage = F.lit(50.0)
    present = [c for c in KEY_METRICS if c in daily.columns]
    found = sum((F.col(c).isNotNull().cast("int") for c in present), F.lit(0))
    completeness = found / len(present) * 100 if present else F.lit(0.0)
    score = (coverage * coverage_weight + completeness * completeness_weight) / (coverage_weight + completeness_weight)
    return daily.select(
        *subject_cols, F.to_date(day).alias(day),
        F.bround(score, 1).alias("data_quality_score"),
        F.bround(coverage, 1).alias("coverage_score"),
        F.bround(completeness, 1).alias("completeness_score"),
        found.alias("key_metrics_count"),
        F.lit(len(present)).alias("key_metrics_total"),
    )


def quality_totals(quality: DataFrame) -> DataFrame:
    return quality.agg(
        F.avg("data_quality_score").alias("mean_score"),
        F.count_if(F.col("data_quality_score") >= 80).alias("days_80"),
        F.count("*").alias("total_days"),
        (F.count_if(F.col("data_quality_score") >= 80) / F.count("*") * 100).alias("pct_80"),
    )


def melt_row(row: DataFrame, columns: Sequence[str], fields: Mapping[str, str], *, label: str = "column") -> DataFrame:
    """One-row frame of ``<field>#<i>`` columns to one row per name in ``columns``."""
    if not columns:
        ddl = ", ".join(f"`{n}` {t}" for n, t in {label: "string", "position": "int", **fields}.items())
        return row.sparkSession.createDataFrame([], ddl)
    entries = F.array(*[
        F.struct(F.lit(c).alias(label), F.lit(i).alias("position"),
                 *[F.col(f"`{f}#{i}`").cast(t).alias(f) for f, t in fields.items()])
        for i, c in enumerate(columns)])
    return row.select(F.inline(entries))


def completeness_level(share: Column) -> Column:
    level = F.lit(COMPLETENESS_LEVELS[-1][1])
    for bound, name in reversed(COMPLETENESS_LEVELS[:-1]):
        level = F.when(share >= bound, name).otherwise(level)
    return level


def present(df: DataFrame, c: str) -> Column:
    """Neither null nor NaN."""
    col = F.col(f"`{c}`")
    if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
        return col.isNotNull() & ~F.isnan(col)
    return col.isNotNull()


def completeness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Non-null count, null count, share, level and two adequacy flags per column."""
    columns = list(columns or df.columns)
    row = df.agg(
        F.count("*").alias("_rows"),
        *[F.count_if(present(df, c)).alias(f"non_null_count#{i}") for i, c in enumerate(columns)])
    row = row.withColumns({f"rows#{i}": F.col("_rows") for i in range(len(columns))})
    share = F.when(F.col("rows") > 0, F.col("non_null_count") / F.col("rows")).otherwise(0.0)
    return melt_row(row, columns, {"rows": "long", "non_null_count": "long"}).select(
        "column", "position", "non_null_count",
        (F.col("rows") - F.col("non_null_count")).alias("null_count"),
        share.alias("completeness"),
        completeness_level(share).alias("completeness_level"),
        (F.col("non_null_count") >= 50).alias("sufficient_for_modeling"),
        (share >= 0.1).alias("adequate_for_analysis"),
    )


def missing_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing count and percent of numeric columns, worst first."""
    table = completeness(df, list(columns or numeric_columns(df)))
    return table.select(
        "column",
        F.col("null_count").alias("missing_count"),
        ((1 - F.col("completeness")) * 100).alias("missing_pct"),
        F.col("non_null_count").alias("available_count"),
    ).orderBy(F.desc("missing_pct"), "column")


def worst_columns(df: DataFrame, n: int = 10) -> DataFrame:
    return completeness(df).orderBy("completeness", "column").limit(n)


def column_domain(name: Column) -> Column:
    """Health domain of a column name by the first domain whose keyword it contains."""
    lowered = F.lower(name)
    domain = F.lit("other")
    for label, words in reversed(DOMAIN_KEYWORDS):
        domain = F.when(lowered.rlike("|".join(words)), label).otherwise(domain)
    return domain


def column_domains(df: DataFrame) -> DataFrame:
    """Completeness of each column with its health domain."""
    return completeness(df).withColumn("domain", column_domain(F.col("column")))


def dataset_profile(df: DataFrame, *, day: str | None = None, approximate_days: bool = False) -> DataFrame:
    """Rows, columns, cells, missing share, date range and distinct days in one pass."""
    numeric = len(numeric_columns(df))
    text = sum(isinstance(f.dataType, T.StringType) for f in df.schema.fields)
    present_cells = sum((present(df, c).cast("long") for c in df.columns), F.lit(0).cast("long"))
    aggs = [F.count("*").alias("rows"), F.coalesce(F.sum(present_cells), F.lit(0)).alias("_present")]
    if day is None:
        day = next((f.name for f in df.schema.fields
                    if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))), None)
    if day is not None:
        d = F.to_date(day)
        distinct = F.approx_count_distinct(d) if approximate_days else F.countDistinct(d)
        aggs += [F.min(d).alias("first_day"), F.max(d).alias("last_day"), distinct.alias("distinct_days")]
    out = df.agg(*aggs)
    if day is None:
        none = F.lit(None)
        out = out.withColumns({"first_day": none.cast("date"), "last_day": none.cast("date"),
                               "distinct_days": none.cast("long")})
    width = len(df.columns)
    cells = F.col("rows") * width
    return out.select(
        "rows", F.lit(width).alias("columns"), cells.alias("cells"),
        F.when(cells > 0, (cells - F.col("_present")) / cells).otherwise(0.0).alias("missing_share"),
        F.lit(numeric).alias("numeric_columns"), F.lit(text).alias("text_columns"),
        "first_day", "last_day",
        F.datediff("last_day", "first_day").alias("duration_days"), "distinct_days",
    )


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], *, mode: str = "exact", moments: bool = False) -> DataFrame:
    """Quantiles of many numeric columns of one table: ``column``, ``n``, ``q``, and moments if wanted."""
    return quantiles(long_values(df, columns), ["column"], "value", probs, mode=mode, few_groups=True, moments=moments)


def long_values(df: DataFrame, columns: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    """Numeric columns as ``(ids, column, value)`` rows."""
    casted = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns])
    return casted.unpivot(list(ids), list(columns), "column", "value")


def extreme_outliers(df: DataFrame, columns: Sequence[str] | None = None, *, factor: float = 3.0,
                     min_values: int = 10) -> DataFrame:
    """Values beyond ``factor`` IQRs of the quartiles, for columns with enough values and a spread."""
    columns = list(columns or numeric_columns(df))
    fences = (
        column_quantiles(df, columns, [0.25, 0.75])
        .withColumn("_iqr", F.col("q")[1] - F.col("q")[0])
        .where((F.col("n") > min_values) & (F.col("_iqr") > 0))
        .select("column", F.col("n").alias("values"),
                (F.col("q")[0] - F.col("_iqr") * factor).alias("lower_bound"),
                (F.col("q")[1] + F.col("_iqr") * factor).alias("upper_bound"))
    )
    beyond = (F.col("value") < F.col("lower_bound")) | (F.col("value") > F.col("upper_bound"))
    return (
        long_values(df, columns).join(F.broadcast(fences), "column")      # one row per column of the schema
        .where(beyond)
        .groupBy("column", "values", "lower_bound", "upper_bound")
        .agg(F.count("*").alias("outlier_count"), F.min("value").alias("outlier_min"),
             F.max("value").alias("outlier_max"))
        .withColumn("outlier_share", F.col("outlier_count") / F.col("values"))
    )


def duplicate_columns(df: DataFrame, columns: Sequence[str] | None = None, *, batch: int = 300) -> DataFrame:
    """Pairs of numeric columns equal in every row, nulls included.

    One pass compares columns by an order-free checksum; only columns with the
    same checksum are compared value by value in a second pass.
    """
    columns = list(columns or numeric_columns(df))
    as_double = {c: F.col(c).cast("double") for c in columns}
    signs = df.agg(*[
        F.struct(F.coalesce(F.bit_xor(F.xxhash64(as_double[c])), F.lit(0)).alias("x"),
                 F.count(c).alias("n"), F.sum(F.hash(as_double[c]).cast("decimal(12,0)")).alias("s")).alias(f"_{i}")
        for i, c in enumerate(columns)]).first()
    pairs = [(a, b) for i, a in enumerate(columns) for j, b in enumerate(columns)
             if i < j and signs[i] == signs[j]]
    spark = df.sparkSession
    out = None
    for start in range(0, len(pairs), batch):
        chunk = pairs[start:start + batch]
        row = df.agg(*[F.coalesce(F.bool_and(as_double[a].eqNullSafe(as_double[b])), F.lit(True)).alias(f"_{i}")
                       for i, (a, b) in enumerate(chunk)])
        entries = F.array(*[F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"),
                                     F.col(f"_{i}").alias("_same")) for i, (a, b) in enumerate(chunk)])
        found = row.select(F.inline(entries)).where("_same").drop("_same")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "column_a string, column_b string")


def text_issues(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per text column: values that look like times, and whether numbers and words are mixed."""
    columns = list(columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)])
    aggs = []
    for i, c in enumerate(columns):
        aggs += [
            F.count(c).alias(f"non_null_count#{i}"),
            F.count_if(F.col(c).rlike(":|AM|PM|am|pm")).alias(f"time_like#{i}"),
            F.count_if(F.col(c).try_cast("double").isNotNull()).alias(f"numeric_like#{i}"),
        ]
    fields = {"non_null_count": "long", "time_like": "long", "numeric_like": "long"}
    return melt_row(df.agg(F.count("*"), *aggs), columns, fields).select(
        "column", "non_null_count", "time_like", "numeric_like",
        (F.col("time_like") > 0).alias("has_time_strings"),
        ((F.col("numeric_like") > 0) & (F.col("numeric_like") < F.col("non_null_count"))).alias("mixed_types"),
    )


def modeling_suitability(df: DataFrame) -> DataFrame:
    """``(column, task)`` rows: what each column can be used for."""
    numeric = set(numeric_columns(df))
    name = F.lower("column")
    is_number = F.col("column").isin(*numeric) if numeric else F.lit(False)
    usable = F.col("sufficient_for_modeling") & is_number
    tasks = (
        F.when(~usable, F.array(F.lit("unsuitable")))
        .when(name.rlike("|".join(TIME_WORDS)), F.array(F.lit("time_series")))
        .when(name.rlike("|".join(TARGET_WORDS)), F.array(F.lit("predictive_modeling")))
        .otherwise(F.array(*[F.lit(t) for t in ("anomaly_detection", "clustering", "predictive_modeling")]))
    )
    return completeness(df).select("column", "completeness", F.explode(tasks).alias("task"))


def score_histogram(df: DataFrame, column: str, *, low: float = 0.0, high: float = 100.0, bins: int = 20) -> DataFrame:
    """Counts in equal bins; the last bin includes its right end."""
    width = (high - low) / bins
    slot = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("int")
    return (
        df.where(F.col(column).between(low, high)).groupBy(slot.alias("bin")).agg(F.count("*").alias("n"))
        .withColumn("bin_low", F.col("bin") * F.lit(width) + low)
        .withColumn("bin_high", (F.col("bin") + 1) * F.lit(width) + low)
    )


def coverage_band(pct: Column) -> Column:
    """95 / 80 / 50."""
    return (F.when(pct >= 95, "excellent").when(pct >= 80, "good").when(pct >= 50, "fair")
            .when(pct.isNotNull(), "poor"))


def stress_band(level: Column) -> Column:
    """Below 30 low, below 50 medium, else high."""
    return F.when(level < 30, "low").when(level < 50, "medium").when(level.isNotNull(), "high")
