"""From documents to token shards: filter, deduplicate, decontaminate, mix and encode.

Each stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept; its result is written as Parquet and read again for the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayloom.llm.common import Tables, text_check
from dayloom.llm.decontamination import decontamination
from dayloom.llm.jaccard_join import jaccard_join
from dayloom.llm.mixing import mix_sources
from dayloom.llm.token_output import token_digest
from dayloom.llm.toxicity import toxicity_score, train_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _of_rows(docs: DataFrame, other: DataFrame, keep: Column, how: str = "inner") -> DataFrame:
    """Rows of ``docs`` whose (doc_id, tk) has a row in ``other``, unique by these."""
    left = docs.withColumn("tk", text_check("text"))
    on = left["doc_id"].eqNullSafe(other["doc_id"]) & (left["tk"] == other["tk"])
    return left.join(other.hint("merge"), on, how).where(keep).select(*(left[c] for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5, learned from the labels of those that came in."""
    model = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity_score(F.col("text").cast("string"), model, docs) < 0.5)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near duplicates; documents without words or id stay.

    Of several texts of a group with the least id that with the least check stays, and of equal rows one.
    """
    tables = Tables(spark)
    joined = tables.keep(jaccard_join(docs).select("doc_id", "tk", "component_id", "root", "n_shingles"), "joined")
    linked = joined.where("n_shingles > 0 and doc_id = component_id").groupBy("root", "doc_id", "tk").agg(F.count("*").alias("n"))
    chosen = linked.groupBy("root", "doc_id").agg(F.min("tk").alias("tk"), F.min_by("n", "tk").alias("n"))
    chosen = tables.keep(chosen.select("doc_id", "tk", "n"), "chosen")
    many = chosen.where("n > 1").select("doc_id", "tk").distinct()
    free = joined.where("n_shingles = 0 or doc_id is null").select("doc_id", "tk").distinct()
    rows = _of_rows(docs, chosen.where("n = 1").select("doc_id", "tk").union(free), F.lit(True))
    return rows if many.isEmpty() else rows.union(_of_rows(docs, many, F.lit(True)).dropDuplicates(["doc_id", "text"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    found = decontamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = found.where("size(hits) > 0").select("doc_id", "tk").distinct()
    left = docs.withColumn("tk", text_check("text"))
    on = left["doc_id"].eqNullSafe(hit["doc_id"]) & (left["tk"] == hit["tk"])
    return left.join(hit.hint("merge"), on, "left_anti").drop("tk")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; equal rows as often as the one taken most."""
    taken = mix_sources(docs).groupBy("doc_id", "tk").agg(F.max("copies").alias("copies")).where("copies > 0")
    left = docs.withColumn("tk", text_check("text"))
    on = left["doc_id"].eqNullSafe(taken["doc_id"]) & (left["tk"] == taken["tk"])
    rows = left.join(taken.hint("merge"), on).select(*(left[c] for c in docs.columns), "copies")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*docs.columns)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, read back from the shards."""
    return token_digest(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix),
    ("token_output", token_shards),
]

#: Learned models and tokenizers are no SQL; the tests run a brute-force version of every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tables = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS), Tables(spark)
    for i, (name, stage) in enumerate(STAGES[:-1]):
        docs = tables.keep(stage(spark, docs, sf_dir), f"{i}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
