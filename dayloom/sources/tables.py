"""Source tables: declared schemas, scans, and the read-or-build master."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Source tables and the columns the jobs rely on; files may hold more.
SCHEMAS: dict[str, str] = {
    "daily_summary": "day date, steps double, calories_total double",
    "sleep": "day date, total_sleep string, deep_sleep string, rem_sleep string, score double",
    "stress": "timestamp timestamp_ntz, stress double",
    "resting_hr": "day date, resting_heart_rate double",
    "days_summary": "day date, calories_bmr_avg double",
    "activities": "activity_id string, sport string, name string, description string, start_time timestamp_ntz, "
                  "elapsed_time string, training_effect double, anaerobic_training_effect double, calories double",
    "steps_activities": "activity_id string, avg_pace string, vo2_max double",
    "monitoring_hr": "timestamp timestamp_ntz, heart_rate double",
}
CORE_TABLES = ("daily_summary", "sleep", "stress", "resting_hr")


def declared(name: str, subject_cols: Sequence[str] = ()) -> T.StructType:
    subject = "".join(f"{c} string, " for c in subject_cols)
    return T.StructType.fromDDL(subject + SCHEMAS[name])


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, *, fmt: str = "parquet",
               **options: str) -> DataFrame:
    """Scan a table; a path that does not exist gives an empty frame of the schema."""
    reader = spark.read.format(fmt).options(**options)
    try:
        return (reader.schema(schema) if schema is not None and fmt in ("csv", "json") else reader).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND" or schema is None:
            raise
        return spark.createDataFrame([], schema)


def read_bundle(spark: SparkSession, folder: str, names: Sequence[str] = CORE_TABLES, *,
                subject_cols: Sequence[str] = ()) -> dict[str, DataFrame]:
    return {n: read_table(spark, f"{folder}/{n}.parquet", declared(n, subject_cols)) for n in names}


def read_samples(table: DataFrame, *, ts: str = "timestamp", value: str = "stress",
                 subject_cols: Sequence[str] = ()) -> DataFrame:
    """Time and value of samples that have one; projection and filter reach the scan."""
    return table.select(*subject_cols, ts, value).where(F.col(value).isNotNull())


def read_sessions(table: DataFrame) -> DataFrame:
    """Sessions with a start and a sport, earliest first."""
    return (table.select("activity_id", "start_time", "sport")
            .where(F.col("start_time").isNotNull() & F.col("sport").isNotNull()).orderBy("start_time"))


def read_master_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return read_table(spark, path, schema, fmt="csv", header="true", mode="PERMISSIVE")


def read_quality(spark: SparkSession, path: str, *, subject_cols: Sequence[str] = ()) -> DataFrame:
    subject = "".join(f"{c} string, " for c in subject_cols)
    return read_table(spark, path, T.StructType.fromDDL(
        subject + "day date, data_quality_score double, coverage_score double, completeness_score double, "
        "key_metrics_count int, key_metrics_total int"))


def is_stored(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` has been finished: its job leaves a marker, a broken one does not."""
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def read_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The stored master, or the freshly built one after storing it.

    What a broken build has left is written over, never read.
    """
    if not is_stored(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


MAPPING_SCHEMA = T.StructType([
    T.StructField("unknown_activity_mappings", T.MapType(T.StringType(), T.StructType([
        T.StructField("display_name", T.StringType()), T.StructField("description", T.StringType()),
        T.StructField("category", T.StringType()), T.StructField("color", T.StringType())]))),
])


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """Sport mapping from its JSON file, one row per sport; a missing file gives no rows."""
    raw = read_table(spark, path, MAPPING_SCHEMA, fmt="json", multiLine="true")
    return raw.select(F.explode("unknown_activity_mappings").alias("sport", "_m")).select("sport", "_m.*")


def mapping_from(spark: SparkSession, entries: Mapping[str, Mapping[str, str]]) -> DataFrame:
    rows = [(s, e.get("display_name"), e.get("description"), e.get("category"), e.get("color"))
            for s, e in entries.items()]
    return spark.createDataFrame(rows, "sport string, display_name string, description string, category string, color string")
