"""Session settings and lineage cutting."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of all executors; nodes that have it installed use the same code."""
    sc = spark.sparkContext
    if getattr(sc, "_dayloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")      # on the driver; Spark hands the file out
    archive = f"{folder}/dayloom_package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    sc.addPyFile(archive)
    sc._dayloom_shipped = True


def build_session(app_name: str = "dayloom", **extra: str) -> SparkSession:
    """Session for jobs; master and memory come from spark-submit."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; make one only where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    cluster = not sc.master.startswith("local")
    if configured is None and cluster:
        raise ValueError("set spark.checkpoint.dir to a shared folder before iterative jobs")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


#: Folders of the tables that this driver has stored and not yet removed.
_STORED: list[str] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the tables that jobs inside have stored; what they return has to be written or collected by then."""
    before = len(_STORED)
    try:
        yield
    finally:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        for path in _STORED[before:]:
            folder = hadoop.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        del _STORED[before:]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store ``df`` as a table in the checkpoint folder and read it back.

    Unlike a checkpointed frame, the table brings its real size to later plans
    and none of the old plan's constraints, which pile up in iterations.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    _STORED.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
