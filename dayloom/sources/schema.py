"""Schemas as data: extraction, drift, required tables, audit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_DDL = "`table` string, position int, `column` string, type string"


def extract_schema(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    rows = [(t, i, f.name, f.dataType.simpleString()) for t, df in sorted(tables.items())
            for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, SCHEMA_DDL)


def schema_from(spark: SparkSession, spec: Mapping[str, Sequence[tuple[str, str]]]) -> DataFrame:
    rows = [(t, i, c, k) for t, cols in sorted(spec.items()) for i, (c, k) in enumerate(cols)]
    return spark.createDataFrame(rows, SCHEMA_DDL)


def schema_drift(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Missing, extra and re-typed columns; type names compare without case."""
    e = expected.select("table", "column", F.col("type").alias("expected_type"), F.lit(True).alias("_e"))
    a = actual.select("table", "column", F.col("type").alias("actual_type"), F.lit(True).alias("_a"))
    same = F.upper(F.coalesce("expected_type", F.lit(""))) == F.upper(F.coalesce("actual_type", F.lit("")))
    kind = (F.when(F.col("_a").isNull(), "missing_column").when(F.col("_e").isNull(), "extra_column")
            .when(~same, "type_mismatch"))
    return (e.join(a, ["table", "column"], "full_outer").withColumn("kind", kind).where(F.col("kind").isNotNull())
            .select("table", "kind", "column", "expected_type", "actual_type"))


def drift_report(drift: DataFrame) -> DataFrame:
    """One row per table with its three lists."""
    def listed(kind: str, what) -> F.Column:
        return F.sort_array(F.collect_list(F.when(F.col("kind") == kind, what)))

    return drift.groupBy("table").agg(      # lists are as long as a table is wide
        listed("missing_column", F.col("column")).alias("missing_columns"),
        listed("extra_column", F.col("column")).alias("extra_columns"),
        listed("type_mismatch", F.struct("column", "expected_type", "actual_type")).alias("type_mismatches"))


def missing_tables(required: DataFrame, actual: DataFrame) -> DataFrame:
    """Required tables (``source``, ``table``) that are not there."""
    return required.join(actual.select("table").distinct(), "table", "left_anti").select("source", "table")


def audit_tables(spark: SparkSession, tables: Mapping[str, DataFrame | None]) -> DataFrame:
    """Row count and a status per table: ok, empty or all null, not found."""
    out = None
    for name, df in tables.items():
        if df is None:
            row = spark.createDataFrame([(name, None, "not found")], "`table` string, rows long, status string")
        else:
            filled = F.coalesce(*[F.when(F.col(f"`{c}`").isNotNull(), F.lit(True)) for c in df.columns], F.lit(False))
            row = df.agg(F.count("*").alias("rows"), F.coalesce(F.bool_or(filled), F.lit(False)).alias("_any")).select(
                F.lit(name).alias("table"), "rows", F.when(F.col("_any"), "ok").otherwise("all null or empty").alias("status"))
        out = row if out is None else out.unionByName(row)
    return out


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def preview(df: DataFrame, columns: Sequence[str] | None = None, rows: int = 3, *, order_by: Sequence[str] = ()) -> DataFrame:
    """The first rows of the columns that exist; without ``order_by`` in no particular order."""
    found = [c for c in (columns or df.columns) if c in df.columns]
    return (df.orderBy(*order_by) if order_by else df).select(*found).limit(rows)
