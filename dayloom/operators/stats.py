"""Correlations, feature statistics, trends and decayed means."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayloom.functions.quantiles import average_ranks, lookup_by_frequency
from dayloom.operators.daily import numeric_columns, subject_window
from dayloom.session import cut_lineage
from dayloom.operators.quality import column_quantiles, long_values, melt_row


def pearson(x: Column, y: Column) -> Column:
    """Correlation of two columns that are null together; null without spread.

    The built-in fails on a constant column under ANSI rules instead.
    """
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.covar_pop(x, y) / F.when(spread > 0, spread)


PAIR_SUMS = "i int, j int, n double, x double, y double, xx double, yy double, xy double"


def _pair_sums(centers: list[float]):
    """Sums over all rows of a partition for every two columns, over the rows that have both."""
    d = len(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, d, d))
        for batch in batches:
            if batch.num_rows:
                values = np.stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns], axis=1) - centers
                there = ~np.isnan(values)
                x, m = np.where(there, values, 0.0), there.astype(float)
                sums += np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
        i, j = np.triu_indices(d, 1)
        n, one, two, both = sums
        yield pa.record_batch(
            [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
             *[pa.array(v) for v in (n[i, j], one[i, j], one[j, i], two[i, j], two[j, i], both[i, j])]],
            names=["i", "j", "n", "x", "y", "xx", "yy", "xy"])

    return run


def correlation_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson r of every column pair over the rows that have both: ``a``, ``b``, ``n``, ``r``.

    Two scans for any number of columns: one for the means, and one that adds up
    products of the centred columns as matrices, one matrix per task.  NaN counts
    as missing.
    """
    columns = list(columns or numeric_columns(df))
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, n long, r double")
    numbers = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    present = [F.when(~F.isnan(c), F.col(c)) for c in numbers.columns]
    centers = [m or 0.0 for m in numbers.agg(*[F.avg(c) for c in present]).first()]
    none = df.sparkSession.createDataFrame(     # every pair has a row, also without input
        [(i, j, *[0.0] * 6) for i in range(len(columns)) for j in range(i + 1, len(columns))], PAIR_SUMS)
    sums = numbers.mapInArrow(_pair_sums(centers), PAIR_SUMS).union(none).groupBy("i", "j").agg(
        *[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])

    n = F.when(F.col("n") > 0, F.col("n"))

    def spread(total: str, squares: str, index: str) -> Column:
        raw = F.col(squares) - F.col(total) * F.col(total) / n
        center = F.get(F.array(*[F.lit(float(m)) for m in centers]), F.col(index))
        return F.when(raw > 1e-24 * n * center * center, raw)      # what rounding leaves of a constant column is none

    names = F.array(*[F.lit(c) for c in columns])
    scale = F.sqrt(spread("x", "xx", "i")) * F.sqrt(spread("y", "yy", "j"))
    r = (F.col("xy") - F.col("x") * F.col("y") / n) / scale
    return sums.select(F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), F.col("n").cast("long").alias("n"), r.alias("r"))


def correlation_matrix(pairs: DataFrame) -> DataFrame:
    """Both triangles and the diagonal of the pair list."""
    flipped = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n", "r")
    names = pairs.select(F.explode(F.array("a", "b")).alias("a")).distinct()
    diagonal = names.select("a", F.col("a").alias("b"), F.lit(None).cast("long").alias("n"), F.lit(1.0).alias("r"))
    return pairs.unionByName(flipped).unionByName(diagonal)


def top_correlations(pairs: DataFrame, *, threshold: float = 0.5, limit: int = 20) -> DataFrame:
    return (pairs.where(F.abs("r") >= threshold).orderBy(F.desc(F.abs("r")), "a", "b").limit(limit))


def strongest_correlations(pairs: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most positive and the ``n`` most negative pairs."""
    known = pairs.where(F.col("r").isNotNull())
    up = known.where(F.col("r") > 0).orderBy(F.desc("r"), "a", "b").limit(n).withColumn("sign", F.lit("positive"))
    down = known.where(F.col("r") < 0).orderBy("r", "a", "b").limit(n).withColumn("sign", F.lit("negative"))
    return up.unionByName(down)


def spearman_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rank correlation over rows that have all columns, with average ranks for ties.

    Rows are numbered once and handled as (row, column, value), so that one pass
    ranks all columns, one join brings the ranks back and one group per row puts
    them side by side, whatever the number of columns.
    """
    columns = list(columns)
    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).na.drop()
    rows = cut_lineage(rows.withColumn("_row", F.monotonically_increasing_id()))
    long = rows.select("_row", F.posexplode(F.array(*[F.col(f"c{i}") for i in range(len(columns))])).alias("_at", "_v"))
    # one row per column and distinct value, stored because heavy and light values are both looked up in it
    ranks = cut_lineage(average_ranks(long, ["_at"], "_v"))
    ranked = lookup_by_frequency(long, ranks, ["_at", "_v"], "n_equal")
    wide = ranked.groupBy("_row").agg(*[F.max(F.when(F.col("_at") == i, F.col("rank"))).alias(c) for i, c in enumerate(columns)])
    return correlation_pairs(cut_lineage(wide), columns)


def feature_stats(df: DataFrame, columns: Sequence[str] | None = None, *, mode: str = "exact") -> DataFrame:
    """Count, mean, deviation, variance, extremes, median and missing percent per numeric column."""
    columns = list(columns or numeric_columns(df))
    spark, fields = df.sparkSession, ("mean", "std", "min", "max")
    names = spark.createDataFrame([(c,) for c in columns], "column string")
    found = column_quantiles(df, columns, [0.5], mode=mode, moments=True)
    found = found.select(F.col("column").alias("_c"), "n", F.col("q")[0].alias("median"), *fields)
    rows = df.agg(F.count("*").alias("rows"))
    out = names.join(F.broadcast(found), F.col("column") == F.col("_c"), "left").join(F.broadcast(rows))     # one row; one per column
    count = F.coalesce("n", F.lit(0)).cast("long")
    missing = F.when(F.col("rows") > 0, (F.col("rows") - count) / F.col("rows") * 100)
    return out.select("column", count.alias("count"), "mean", "std", F.pow("std", 2).alias("variance"), "min", "max", "median",
                      missing.alias("missing_pct"))


def volatility(df: DataFrame, columns: Sequence[str] | None = None, n: int = 10) -> DataFrame:
    """The numeric columns with the largest deviation."""
    columns = list(columns or numeric_columns(df))
    row = df.agg(*[F.stddev_samp(c).alias(f"std#{i}") for i, c in enumerate(columns)])
    return (melt_row(row, columns, {"std": "double"}).drop("position")
            .where(F.col("std").isNotNull()).orderBy(F.desc("std"), "column").limit(n))


def linear_trend(df: DataFrame, feature: str, target: str, *, keys: Sequence[str] = ()) -> DataFrame:
    """Least-squares line and r between a feature and the target."""
    x, y = F.col(feature).cast("double"), F.col(target).cast("double")
    slope = F.covar_pop(x, y) / F.when(F.var_pop(x) > 0, F.var_pop(x))
    return df.where(x.isNotNull() & y.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), slope.alias("slope"), (F.avg(y) - slope * F.avg(x)).alias("intercept"),
        pearson(x, y).alias("r"))


def linear_trends(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """``linear_trend`` of many features in one pass."""
    return linear_trend(long_values(df, features, ids=[target]), "value", target, keys=["column"])


def importance_by_category(importance: DataFrame, *, feature: str = "feature", value: str = "importance") -> DataFrame:
    """Summed importance and share of heart-rate, activity and other features."""
    name = F.lower(feature)
    # Name parts of the two categories; a feature may count in both.
    heart = F.coalesce(F.sum(F.when(name.rlike("hr|rhr"), F.col(value))), F.lit(0.0))
    active = F.coalesce(F.sum(F.when(
        name.rlike("activity|steps|workout|calories|distance|floors"), F.col(value))), F.lit(0.0))
    row = importance.agg(heart.alias("h"), active.alias("a"), F.sum(value).alias("t"))
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("category"), x.alias("importance"),
                 F.when(F.col("t") != 0, x / F.col("t")).alias("share"))
        for c, x in (("heart_rate", F.col("h")), ("activity", F.col("a")),
                     ("other", F.col("t") - F.col("h") - F.col("a")))])))


def decayed_mean(
    daily: DataFrame, columns: Sequence[str], alpha: float, *, day: str = "day", subject_cols: Sequence[str] = (),
) -> DataFrame:
    """Mean of all values up to the day, each weighted ``alpha ** (age in days)``, as ``smoothed_*``.

    Weights are powers of alpha within blocks of days, and whole blocks are
    carried over by one weighted sum each, so long histories neither overflow
    nor lose the recent part.  ``alpha=1`` is no smoothing: the mean of all days.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    if alpha == 1:
        whole = Window.partitionBy(*(list(subject_cols) or [F.lit(0)]))
        return daily.withColumns({f"smoothed_{c}": F.avg(c).over(whole) for c in columns})
    block_days = max(1, min(64, int(200 / -math.log10(alpha))))
    keys = list(subject_cols) or ["_one"]
    rows = daily if subject_cols else daily.withColumn("_one", F.lit(0))
    epoch = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    rows = rows.withColumn("_day", epoch).withColumn("_block", F.floor(F.col("_day") / block_days))
    end = (F.col("_block") + 1) * block_days - 1
    log_a = F.lit(alpha)
    in_block = Window.partitionBy(*keys, "_block").orderBy("_day").rangeBetween(Window.unboundedPreceding, 0)
    sums, weights = {}, []
    for i, c in enumerate(columns):
        w = F.when(F.col(c).isNotNull(), F.pow(log_a, F.col("_day") * -1 + F.col("_block") * block_days))
        sums[f"_n{i}"] = F.sum(w * F.col(c)).over(in_block)
        sums[f"_d{i}"] = F.sum(w).over(in_block)
        at_end = F.when(F.col(c).isNotNull(), F.pow(log_a, end - F.col("_day")))
        weights += [F.coalesce(F.sum(at_end * F.col(c)), F.lit(0.0)).alias(f"_bn{i}"),
                    F.coalesce(F.sum(at_end), F.lit(0.0)).alias(f"_bd{i}")]
    blocks = rows.groupBy(*keys, "_block").agg(*weights)
    ordered = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    past = F.collect_list(F.struct("_block", *[f"_bn{i}" for i in range(len(columns))],
                                   *[f"_bd{i}" for i in range(len(columns))])).over(ordered)
    carried = blocks.withColumn("_past", past)

    def carry(name: str):
        return F.aggregate(
            "_past", F.lit(0.0),
            lambda acc, b: acc + b[name] * F.pow(log_a, (F.col("_block") - 1 - b["_block"]) * block_days))

    carried = carried.select(*keys, "_block", *[carry(f"_b{k}{i}").alias(f"_c{k}{i}")
                                                for i in range(len(columns)) for k in "nd"])
    joined = rows.withColumns(sums).join(carried, [*keys, "_block"], "left")
    out = {}
    for i, c in enumerate(columns):
        age = F.col("_day") - F.col("_block") * block_days
        own = F.pow(log_a, age)
        num = F.coalesce(F.col(f"_n{i}"), F.lit(0.0)) * own + F.coalesce(F.col(f"_cn{i}"), F.lit(0.0)) * own * alpha
        den = F.coalesce(F.col(f"_d{i}"), F.lit(0.0)) * own + F.coalesce(F.col(f"_cd{i}"), F.lit(0.0)) * own * alpha
        out[f"smoothed_{c}"] = F.when(den > 0, num / den)
    return joined.withColumns(out).select(*daily.columns, *out)


def chronological_split(
    daily: DataFrame, train_share: float = 0.8, *, day: str = "day", subject_cols: Sequence[str] = (),
) -> DataFrame:
    """``is_train`` for the earliest ``train_share`` of the rows."""
    w = subject_window(day, subject_cols)
    whole = Window.partitionBy(*(list(subject_cols) or [F.lit(0)]))
    cut = F.floor(F.count(F.lit(1)).over(whole) * train_share)
    return daily.withColumn("is_train", F.row_number().over(w) <= cut)


def expanding_folds(daily: DataFrame, n_splits: int = 5, *, day: str = "day",
                    subject_cols: Sequence[str] = ()) -> DataFrame:
    """``fold`` 0..n: fold f is tested by a model of all earlier folds; fold 0 only trains."""
    w = subject_window(day, subject_cols)
    whole = Window.partitionBy(*(list(subject_cols) or [F.lit(0)]))
    n = F.count(F.lit(1)).over(whole)
    size = F.floor(n / (n_splits + 1))
    from_end = n - F.row_number().over(w)
    fold = F.greatest(F.lit(0), n_splits - F.floor(from_end / size)).cast("int")
    return daily.withColumn("fold", fold)
