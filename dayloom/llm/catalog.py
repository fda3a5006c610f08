"""Queries of this package on the shared test tables, with equivalent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from dayloom.llm import sql
from dayloom.llm.ann import nearest
from dayloom.llm.conversation_repair import conversation_digest
from dayloom.llm.decontamination import decontamination_digest
from dayloom.llm.filter_audit import filter_audit
from dayloom.llm.jaccard_join import jaccard_digest
from dayloom.llm.langid import langid
from dayloom.llm.line_dedup import SHORT_WORDS, line_dedup_digest
from dayloom.llm.mixing import mixing_digest
from dayloom.llm.quality import quality
from dayloom.llm.quality_rules import quality_rules_digest
from dayloom.llm.substring_dedup import substring_dedup_digest
from dayloom.llm.token_output import token_digest
from dayloom.llm.toxicity import toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup_digest(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid(_table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup_digest(_table(spark, sf_dir, "documents"))


def short_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4 with repeated runs of fewer lines that are long in words or whole documents."""
    return line_dedup_digest(_table(spark, sf_dir, "documents"), SHORT_WORDS)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_digest(_table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_digest(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination_digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(_table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules_digest(_table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_digest(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_substring_dedup, op2_toxicity, op3_langid, op4_line_dedup, op5_quality, op6_ann, op7_mixing, op8_jaccard_join, op9_decontamination, op10_token_output,
                              op11_filter_audit, op12_quality_rules, op13_conversation_repair)}
QUERIES["short_line_dedup"] = short_line_dedup
QUERIES["pipeline"] = corpus_pipeline.run
ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": sql.SUBSTRING_DEDUP,
    "op4_line_dedup": sql.LINE_DEDUP,
    "short_line_dedup": sql.SHORT_LINE_DEDUP,
    "op7_mixing": sql.MIXING,
    "op8_jaccard_join": sql.JACCARD,
    "op9_decontamination": sql.DECONTAMINATION,
    "op11_filter_audit": sql.FILTER_AUDIT,
    "op12_quality_rules": sql.QUALITY_RULES,
    "op13_conversation_repair": sql.CONVERSATION_REPAIR,
}
