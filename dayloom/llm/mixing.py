"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayloom.llm.common import Tables, text_check

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Parts of each source's shuffled order, by the top 12 of 60 bits: prefix sums are made inside a part and over parts.
_PART_BITS, _KEY_BITS = 12, 60


def _shuffle_key(doc_id: str) -> Column:
    """60 bits of the MD5 of the id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """no_source, source, source_size, target: a share of all words by weight, at most ``epochs`` times the source's own.

    A source is full if its limit per weight is below the common level.  In the
    order of these limits, the first number of full sources that leaves a level
    below the next limit is the one.
    """
    per = sizes.groupBy("no_source", "source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("rank", F.row_number().over(Window.orderBy("no_source", "source")) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    ranked = ranked.withColumn("weight", weight).withColumn("limit", F.col("source_size") * epochs)
    every = Window.partitionBy()
    before = Window.orderBy(F.col("limit") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    level = ((F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0))).cast("double")
             / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("double"))
    ranked = ranked.withColumn("level", level)
    fits = F.col("level") * F.col("weight") <= F.col("limit")
    ranked = ranked.withColumn("common", F.min_by(F.when(fits, F.col("level")), F.when(fits, F.col("limit") / F.col("weight"))).over(every))
    target = F.least(F.coalesce(F.col("common"), F.lit(float("inf"))) * F.col("weight"), F.col("limit").cast("double"))
    return ranked.select("no_source", "source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per row of ``docs``: doc_id, tk (check of the text), size, source_size, target, taken, copies.

    A document's size is its number of words (runs of other than ASCII white
    space; null text: 0).  Sources, by code point and null last, weigh ``weights``
    in turn and share all words; a target above ``epochs`` times its source's size
    stops there and the excess goes to the others by weight.

    Each source is put into the order of the MD5 of the ids and repeated
    ``epochs`` times.  A copy's virtual finish time is the number of its source's
    words up to its end, divided by the source's target.  All copies are sorted
    by that time, by range, and taken until the budget, the words of all
    documents, is used up.

    Documents without words are never taken.  Ties go to the smaller key, then
    id, then copy.  Equal rows are documents of their own; which of them is taken
    more often is not defined.  Other columns are not looked at.
    """
    tables = Tables(docs.sparkSession)
    words = F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    sizes = tables.keep(docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(source).isNull().alias("no_source"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), text_check(text).alias("tk"), words.alias("size"),
        _shuffle_key(doc_id).alias("key")), "sizes")
    keys = ["no_source", "source"]
    targets = tables.keep(source_targets(sizes, weights, epochs), "targets")

    sizes = sizes.withColumn("part", F.shiftright("key", _KEY_BITS - _PART_BITS))
    parts = sizes.groupBy(*keys, "part").agg(F.sum("size").alias("part_size"))
    in_order = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*keys, "part", F.coalesce(F.sum("part_size").over(in_order), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(*keys, "part").orderBy("key", "doc_id", "size", "tk").rowsBetween(Window.unboundedPreceding, 0)
    ended = (sizes.join(offsets, [*keys, "part"]).withColumn("end", F.col("offset") + F.sum("size").over(inside))
             .join(F.broadcast(targets) if targets.limit(10_001).count() <= 10_000 else targets, keys))
    ended = tables.keep(ended.select("doc_id", "tk", "size", "key", "source_size", "target", "end"), "ended")

    copies = (ended.where("size > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("copy"))
              .select("size", _finish(F.col("copy")).alias("finish"), "key", "doc_id", "copy"))
    order = ["finish", "key", "doc_id", "copy"]
    line = tables.keep(copies.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "line")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = line.groupBy("range").agg(F.sum("size").alias("words"))
    ranges = ranges.withColumn("done", F.coalesce(F.sum("words").over(before), F.lit(0)))
    budget = targets.agg(F.sum("source_size").alias("budget"))
    # only the range in which the budget ends has to be summed row by row
    edge = ranges.join(F.broadcast(budget)).where("done <= budget and budget < done + words")
    running = F.col("done") + F.sum("size").over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    cut = (line.join(F.broadcast(edge), "range").withColumn("running", running).where("running > budget")
           .agg(F.min(F.struct(*order)).alias("cut")))
    place = lambda e: F.struct(_finish(F.lit(e)).alias("finish"), "key", "doc_id", F.lit(e).alias("copy"))
    taken = sum((F.when(F.col("cut").isNull() | (place(e) < F.col("cut")), 1).otherwise(0) for e in range(epochs)), F.lit(0))
    taken = F.when(F.col("size") > 0, taken).otherwise(0).cast("long")
    return ended.join(F.broadcast(tables.keep(cut, "cut"))).select(
        "doc_id", "tk", "size", "source_size", "target", (taken * F.col("size")).alias("taken"), taken.alias("copies"))


def _finish(copy: Column) -> Column:
    return F.try_divide((copy * F.col("source_size") + F.col("end")).cast("double"), F.col("target"))


def mixing_digest(docs: DataFrame) -> DataFrame:
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")
