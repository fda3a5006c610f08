"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.functions.quantiles import lookup_by_frequency
from dayloom.llm.common import Tables


def _with_least(edges: DataFrame, directed: DataFrame, tables: Tables, name: str) -> DataFrame:
    """``edges`` (a, b) with m, the least of a and its neighbours in ``directed``.

    A table of least neighbours also counts them.  Nodes with over a thousandth
    of all edges, at most 1000, are looked up by broadcast, so that the edges of
    a hub stay where they are.
    """
    least = directed.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    return lookup_by_frequency(edges, tables.keep(least.withColumn("m", F.least("a", "m")), name), ["a"], "n")


def components(edges: DataFrame, tables: Tables, name: str) -> DataFrame:
    """(node, root): the least node that each node of ``edges`` (a, b) is connected with.

    Large-star and small-star steps in turn (Kiveris et al., 2014).  Least
    neighbours are aggregates with map-side combination, and come back by
    broadcast to nodes with very many edges and by a join to all others, so no
    task holds all edges of a hub.  Each step is a table.
    """
    now = tables.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    step = 0
    while True:
        both = now.union(now.select("b", "a"))
        # larger neighbours go to the least one
        large = _with_least(both.where("b > a"), both, tables, f"{name}-{step}-least")
        large = tables.keep(large.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), f"{name}-{step}-large")
        # smaller ones, and the node itself, too; all of ``large`` points to smaller nodes
        small = _with_least(large, large, tables, f"{name}-{step}-smaller")
        small = small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        new = tables.keep(small.where("a <> b").distinct(), f"{name}-{step + 1}")
        tables.drop(*(f"{name}-{step}{x}" for x in ("-large", "-least", "-smaller", "")))
        # settled: every node has one edge, and roots have none
        row = new.agg(F.count("*").alias("n"), F.countDistinct("a").alias("d")).first()
        if row.n == row.d and new.select("a").join(new.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count() == 0:
            return new.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                new.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        now, step = new, step + 1
