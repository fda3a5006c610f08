"""Stream queries: the shared events arrive as a stream and the emitted result is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayloom.catalog import inputs
from dayloom.catalog.base import Query, table
from dayloom.catalog.samples import coverage_sql
from dayloom.session import ensure_checkpoint_dir
from dayloom.streaming import incremental

SUBJECT = ("subject",)


def arriving(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).select(
        F.col("user_id").alias("subject"), "ts", F.col("value").alias("stress"), F.col("value").alias("heart_rate"))


def emitted(spark: SparkSession, stream: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(spark)
    # results go beside the checkpoints, in the folder all executors share
    base = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    incremental.run_available(stream, f"{base}/out", f"{base}/state")
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def stress(spark, sf):
    return emitted(spark, incremental.daily_stress_stream(arriving(spark, sf), subject_cols=SUBJECT))


def coverage(spark, sf):
    worn = arriving(spark, sf).where(F.col("heart_rate").between(20, 250))
    return emitted(spark, incremental.daily_coverage_stream(worn, max_gap_minutes=20, edge_minutes=10))


def hourly(spark, sf):
    moments = emitted(spark, incremental.hourly_moments_stream(arriving(spark, sf)))
    return incremental.hourly_profile_from_moments(moments)


def hourly_far(spark, sf):
    """Values far from zero, whose squares leave no digits for the deviation."""
    far = arriving(spark, sf).withColumn("stress", F.col("stress") + 1e9)
    return incremental.hourly_profile_from_moments(emitted(spark, incremental.hourly_moments_stream(far)))


# a day is out once the watermark, one day behind the newest sample, has passed its end
QUERIES = [
    Query("stream_daily_stress", stress,
          f"""WITH {inputs.SAMPLES_SQL} SELECT subject, CAST(ts AS DATE) AS day, avg(stress) AS stress_avg,
  max(stress) AS stress_max, count(CASE WHEN stress > 0 THEN 1 END) AS stress_duration FROM samples
WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM samples) GROUP BY 1, 2""", ("stress_avg",)),
    Query("stream_coverage", coverage,
          f"""WITH {inputs.SAMPLES_SQL}, {coverage_sql(False, 20, 10)}
SELECT day, coverage_hours, coverage_pct, gap_count, total_missing_minutes, has_24h_coverage FROM cover
WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM valid)""",
          ("coverage_hours", "coverage_pct", "total_missing_minutes")),
    Query("stream_hourly", hourly,
          f"""WITH {inputs.SAMPLES_SQL} SELECT hour(ts) AS hour, avg(stress) AS mean, stddev_samp(stress) AS std,
  min(stress) AS min, max(stress) AS max, count(stress) AS count FROM samples
WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM samples) GROUP BY 1""",
          ("mean", "std")),
    Query("stream_hourly_large_mean", hourly_far,
          f"""WITH {inputs.SAMPLES_SQL}, m AS (SELECT ts, stress + 1e9 AS stress FROM samples)
SELECT hour(ts) AS hour, avg(stress) AS mean, stddev_samp(stress) AS std, min(stress) AS min, max(stress) AS max, count(stress) AS count
FROM m WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM m) GROUP BY 1""", ("mean", "std"), 3),
]
