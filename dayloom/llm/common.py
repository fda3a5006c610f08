"""Intermediate tables, document keys and seeded order shared by the operators of this package."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayloom.session import ensure_checkpoint_dir

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs inside go when their job is done; its rows are in a table by then."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


class Tables:
    """Tables of one operator run in the shared folder that ``spark.checkpoint.dir`` names.

    They replace lineage: a lost executor costs the running job's tasks only.
    ``drop`` removes those that no later plan reads.
    """

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark = spark
        self.root = f"{spark.sparkContext.getCheckpointDir()}/llm-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        with shuffles_removed(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


def text_check(text: str = "text") -> Column:
    """32 bits that tell rows of one id with different texts apart."""
    return (F.coalesce(F.crc32(F.col(text)), F.lit(0)) - F.lit(1 << 31)).cast("int")


def fold_of(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col(doc_id).cast("string")) % parts


def bounded_sample(df: DataFrame, keys: list[str], rows: int, seed: str) -> DataFrame:
    """At most ``rows`` rows, those least by a seeded hash of ``keys``: the same on every run and layout."""
    order = F.xxhash64(F.lit(seed), *keys)
    return df.orderBy(order, *keys).limit(rows)


def one_row_of_each(rows: DataFrame, ids: DataFrame, further: list[str]) -> DataFrame:
    """Of ``rows`` (doc_id, text, ``further`` columns) one for each of few ``ids``: least check of the text, then least ``further``.

    Checks are made of the rows of these ids only, and reduced to one for each id
    before texts are taken; an id may have any number of rows.
    """
    met = rows.join(F.broadcast(ids.select("doc_id")), "doc_id").withColumn("tk", text_check("text"))
    least = met.groupBy("doc_id").agg(F.min("tk").alias("tk"))
    met = met.join(F.broadcast(least), ["doc_id", "tk"])
    if further:
        order = met.groupBy("doc_id", "tk").agg(F.min(F.struct(*further)).alias("f")).select("doc_id", "tk", "f.*")
        met = met.join(F.broadcast(order), ["doc_id", "tk", *further])
    return met.dropDuplicates(["doc_id"]).drop("tk")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held_out: int, rows: int,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, label) of at most ``rows`` documents that may be learned from.

    Those are documents with a non-null label whose fold, crc32 of the id modulo
    ``parts``, is not ``held_out``.  Of several labels of a document the largest
    counts, of several texts of an id that with the least check.  The chosen ids
    are at most ``rows``, so they are broadcast.
    """
    ids = F.col(doc_id).cast("long")
    known = (labels.select(ids.alias("doc_id"), F.col(label).cast("int").alias("label"))
             .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (fold_of("doc_id", parts) != held_out))
             .groupBy("doc_id").agg(F.max("label").alias("label")))
    chosen = bounded_sample(known, ["doc_id"], rows, label)
    texts = docs.select(ids.alias("doc_id"), F.col(text).cast("string").alias("text"))
    return one_row_of_each(texts, chosen, []).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")


def logistic(z):
    import numpy as np

    return 1.0 / (1.0 + np.exp(-np.clip(z, -30.0, 30.0)))
