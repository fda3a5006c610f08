"""Stored results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.operators.quality import quality_score
from dayloom.session import cut_lineage


def join_quality(daily: DataFrame, quality: DataFrame, *, day: str = "day", subject_cols: Sequence[str] = ()) -> DataFrame:
    """Quality columns beside the daily ones; columns the daily table has already are not repeated."""
    keys = [*subject_cols, day]
    new = [c for c in quality.columns if c not in daily.columns]
    return daily.join(quality.select(*keys, *new), keys, "left")


def write_csv(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, *, quality: DataFrame | None = None, partition_by: Sequence[str] = (),
                  subject_cols: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Daily table as Parquet, with its quality columns if given."""
    out = join_quality(df, quality, subject_cols=subject_cols) if quality is not None else df
    out.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_results(frames: Mapping[str, DataFrame], folder: str, *, fmt: str = "json", mode: str = "overwrite") -> None:
    """One folder per result frame."""
    for name, frame in frames.items():
        frame.write.mode(mode).format(fmt).save(f"{folder}/{name}")


def publish(df: DataFrame, name: str = "master", *, stored: bool = False, partition_by: Sequence[str] = (),
            buckets: int | None = None, bucket_by: Sequence[str] = (), path: str | None = None) -> None:
    """Make a frame queryable by name, in this session or in the catalog.

    A stored table bucketed by subject and day joins other tables of the same
    buckets without a shuffle.  ``path`` keeps it outside the warehouse.
    """
    if stored:
        writer = df.write.mode("overwrite").partitionBy(*partition_by)
        if buckets:
            writer = writer.bucketBy(buckets, *bucket_by).sortBy(*bucket_by)
        if path:
            writer = writer.option("path", path)
        writer.saveAsTable(name)
    else:
        df.createOrReplaceTempView(name)


def write_quality(daily: DataFrame, path: str, *, subject_cols: Sequence[str] = ()) -> None:
    quality_score(daily, subject_cols=subject_cols).write.mode("overwrite").parquet(path)


def _by_month(daily: DataFrame, day: str) -> DataFrame:
    return daily.withColumn("month", F.date_format(day, "yyyy-MM")).repartition("month")


def store_days(daily: DataFrame, path: str, *, day: str = "day") -> None:
    """Daily rows in one folder per month, so that late samples touch the folders of their months only."""
    _by_month(daily, day).write.mode("overwrite").partitionBy("month").parquet(path)


def repair_days(changed: DataFrame, path: str, *, day: str = "day", subject_cols: Sequence[str] = ()) -> None:
    """Put ``changed`` rows into the stored days they belong to; all other rows stay.

    Only the folders of the touched months are read, merged by key, stored beside
    and then replaced.
    """
    spark, keys = changed.sparkSession, [*subject_cols, day]
    now = spark.read.parquet(path)
    months = [r[0] for r in changed.select(F.date_format(day, "yyyy-MM")).distinct().collect()]     # a calendar's length at most
    kept = now.where(F.col("month").cast("string").isin(months)).drop("month").join(changed.select(*keys), keys, "left_anti")
    merged = cut_lineage(kept.unionByName(changed.select(*kept.columns)))
    _by_month(merged, day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
