"""Which range of a habit goes with the best score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.functions.quantiles import quantiles
from dayloom.operators.prep import intensity_minutes
from dayloom.session import cut_lineage


def _edges(df: DataFrame, value: str, bins: int, subject_cols: Sequence[str], mode: str, few_groups: bool = False) -> DataFrame:
    """Inner quantiles, and the least and largest value from the counters."""
    probs = [i / bins for i in range(1, bins)]
    q = quantiles(df, subject_cols, value, probs, mode=mode, moments=True, few_groups=few_groups)
    return q.select(*subject_cols, "n", F.array_distinct(F.concat(F.array("min"), "q", F.array("max"))).alias("edges"))


def with_bin(df: DataFrame, value: str, edges: DataFrame, subject_cols: Sequence[str]) -> DataFrame:
    """Right-closed bin of each value; the lowest edge belongs to the first bin."""
    if subject_cols:
        joined = df.join(edges, list(subject_cols))
    else:
        joined = df.withColumn("edges", edges.select("edges").scalar())
    above = F.size(F.filter("edges", lambda e: e < F.col(value)))
    return (
        joined.withColumn("bin", F.greatest(above, F.lit(1)))
        .withColumn("bin_low", F.get("edges", F.col("bin") - 1))
        .withColumn("bin_high", F.get("edges", F.col("bin")))
        .where(F.size("edges") >= 2)
    )


def quantile_bins(
    daily: DataFrame, value: str, score: str = "score", *, bins: int = 5, min_samples: int = 3,
    subject_cols: Sequence[str] = (), mode: str = "exact", few_groups: bool = False,
) -> DataFrame:
    """Mean, count and deviation of the score per quantile bin of the value; the pairs of both are made once."""
    valid = daily.select(*subject_cols, F.col(value).cast("double").alias("_v"), F.col(score).alias("_s")).na.drop(
        subset=["_v", "_s"])
    valid = cut_lineage(valid)
    edges = _edges(valid, "_v", bins, subject_cols, mode, few_groups).where(F.col("n") >= min_samples).drop("n")
    return (
        with_bin(valid, "_v", edges, subject_cols)
        .groupBy(*subject_cols, "bin", "bin_low", "bin_high")
        .agg(F.avg("_s").alias("mean"), F.count("_s").alias("count"), F.stddev_samp("_s").alias("std"))
    )


def best_range(binned: DataFrame, *, min_samples: int = 3, subject_cols: Sequence[str] = ()) -> DataFrame:
    """The bin with the highest mean, if any bin has enough days."""
    # of equal means the lowest bin
    best = F.max_by(F.struct("bin_low", "bin_high", "mean"), F.struct(F.col("mean"), -F.col("bin")))
    picked = binned.groupBy(*subject_cols).agg(best.alias("_b"), F.max("count").alias("_most"))
    return picked.where(F.col("_most") >= min_samples).select(
        *subject_cols, F.col("_b.bin_low").alias("low"), F.col("_b.bin_high").alias("high"),
        F.col("_b.mean").alias("best_mean"))


def optimal_ranges(
    daily: DataFrame, *, score: str = "score", steps: str = "steps", bins: int = 5, min_samples: int = 3,
    subject_cols: Sequence[str] = (), mode: str = "exact",
) -> DataFrame:
    """Best steps range and best intensity-minutes range with a message each; both habits share the passes."""
    intensity = intensity_minutes(daily)
    habits: dict[str, Column] = {}
    if steps in daily.columns:
        habits["steps"] = F.col(steps)
    if intensity is not None:
        habits["intensity"] = intensity
    if not habits:
        raise ValueError("neither steps nor intensity columns in the table")
    pairs = daily.select(*subject_cols, F.col(score), F.explode(F.create_map(*[
        x for h, e in habits.items() for x in (F.lit(h), e.cast("double"))])).alias("habit", "_habit"))
    keys = [*subject_cols, "habit"]
    binned = quantile_bins(pairs, "_habit", score, bins=bins, min_samples=min_samples, subject_cols=keys, mode=mode, few_groups=not subject_cols)
    out = best_range(binned, min_samples=min_samples, subject_cols=keys)
    low, high = F.bround("low").cast("long"), F.bround("high").cast("long")
    label = F.when(F.col("habit") == "steps", "steps").otherwise("intensity minutes")
    text = F.format_string("Your best sleep occurs when %s are between %s–%s", label,
                           F.when(F.col("habit") == "steps", F.format_number(low, 0)).otherwise(low.cast("string")),
                           F.when(F.col("habit") == "steps", F.format_number(high, 0)).otherwise(high.cast("string")))
    return out.withColumn("message", text)


def quartile_spread(df: DataFrame, value: str, target: str, *, labels: Sequence[str] = ("Q1", "Q2", "Q3", "Q4"),
                    mode: str = "exact") -> DataFrame:
    """Five-number summary of the target in each quantile group of the value.

    No rows if the value has fewer distinct values than groups.
    """
    rows = df.select(F.col(value).cast("double").alias("_v"), F.col(target).cast("double").alias("_t")).na.drop()
    edges = _edges(rows, "_v", len(labels), (), mode).where(F.size("edges") == len(labels) + 1).drop("n")
    name = F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("bin"))
    grouped = with_bin(rows, "_v", edges, ()).select(name.alias("group"), "_t")
    q = quantiles(grouped, ["group"], "_t", [0, 0.25, 0.5, 0.75, 1.0], mode=mode, few_groups=True)
    return q.select("group", "n", *[F.col("q")[i].alias(c) for i, c in enumerate(
        ("minimum", "q1", "median", "q3", "maximum"))])
