"""Imputation and scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayloom.operators.daily import subject_window
from dayloom.operators.quality import column_quantiles, long_values, melt_row

STRATEGIES = ("median", "mean", "drop", "forward_fill", "backward_fill", "none")


def fill_values(df: DataFrame, columns: Sequence[str], strategy: str, *, mode: str = "exact") -> dict[str, float]:
    """Median or mean of each column that has values."""
    if strategy == "median":
        rows = column_quantiles(df, columns, [0.5], mode=mode).collect()
        return {r["column"]: r["q"][0] for r in rows if r["n"]}
    row = df.agg(*[F.avg(c).alias(f"_{i}") for i, c in enumerate(columns)]).first()
    return {c: row[i] for i, c in enumerate(columns) if row[i] is not None}


def impute(
    df: DataFrame, columns: Sequence[str], strategy: str = "median", *, day: str = "day",
    subject_cols: Sequence[str] = (), fitted_on: DataFrame | None = None,
) -> DataFrame:
    """Fill missing values; columns without any value stay empty.

    The fills run along the days of a subject.  ``fitted_on`` takes medians and
    means from another frame, such as the training rows.
    """
    if not columns:
        raise ValueError("no columns to impute")
    unknown = [c for c in columns if c not in df.columns]
    if unknown:
        raise ValueError(f"columns not in table: {unknown}")
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}, not {strategy!r}")
    if strategy == "none":
        return df
    if strategy == "drop":
        return df.na.drop(subset=list(columns))
    if strategy in ("median", "mean"):
        fills = fill_values(fitted_on if fitted_on is not None else df, columns, strategy)
        return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in fills.items()}) if fills else df
    w = subject_window(day, subject_cols)
    if strategy == "forward_fill":
        w = w.rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})
    w = w.rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({c: F.first(c, ignorenulls=True).over(w) for c in columns})


def sample_skewness(c: str) -> Column:
    """Bias-corrected skewness; null below three values or without spread."""
    n = F.count(c)
    return F.when((n > 2) & (F.stddev_samp(c) > 0), F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def recommend_imputation(df: DataFrame, columns: Sequence[str], *, threshold: float = 3.0) -> DataFrame:
    """Median for outliers or |skew| > 1, mean otherwise, drop for empty columns.

    Whether any value lies beyond the threshold follows from the extremes, so
    one pass is enough.
    """
    columns = [c for c in columns if c in df.columns]
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.count(c).alias(f"n#{i}"), F.avg(c).alias(f"mean#{i}"), F.stddev_samp(c).alias(f"std#{i}"),
                 F.min(c).alias(f"low#{i}"), F.max(c).alias(f"high#{i}"), sample_skewness(c).alias(f"skew#{i}")]
    fields = {"n": "long", "mean": "double", "std": "double", "low": "double", "high": "double", "skew": "double"}
    far = (F.col("std") > 0) & ((F.col("low") < F.col("mean") - threshold * F.col("std"))
                                | (F.col("high") > F.col("mean") + threshold * F.col("std")))
    skewed = F.abs(F.coalesce(F.col("skew"), F.lit(0.0))) > 1.0
    return melt_row(df.agg(*aggs), columns, fields).select(
        "column", "n", "skew", F.coalesce(far, F.lit(False)).alias("has_outliers"),
        F.when(F.col("n") == 0, "drop").when(F.coalesce(far, F.lit(False)) | skewed, "median")
        .otherwise("mean").alias("strategy"),
    )


def standardize(df: DataFrame, columns: Sequence[str], *, fitted_on: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population deviation over the rows that have all columns; constant columns become 0."""
    complete = df.na.drop(subset=list(columns))
    source = fitted_on.na.drop(subset=list(columns)) if fitted_on is not None else complete
    row = source.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(f"_{i}")
                       for i, c in enumerate(columns)]).first()
    return complete.withColumns({
        c: (F.col(c) - F.lit(row[i]["m"])) / F.lit(row[i]["s"] or 1.0) for i, c in enumerate(columns)})


def robust_scale(df: DataFrame, columns: Sequence[str], *, fitted_on: DataFrame | None = None,
                 mode: str = "exact") -> DataFrame:
    """(x - median) / IQR; columns without spread are only centred."""
    source = fitted_on if fitted_on is not None else df
    quart = {r["column"]: r["q"] for r in column_quantiles(source, columns, [0.25, 0.5, 0.75], mode=mode).collect()}
    return df.withColumns({
        c: (F.col(c) - F.lit(quart[c][1])) / F.lit((quart[c][2] - quart[c][0]) or 1.0)
        for c in columns if c in quart})


__all__ = ["fill_values", "impute", "long_values", "recommend_imputation", "robust_scale", "sample_skewness",
           "standardize"]
