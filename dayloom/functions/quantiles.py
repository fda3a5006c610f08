"""Exact quantiles and ranks without bringing a group together in one task.

The built-in ``percentile`` keeps one counter per distinct value of a group in
memory, so a group with a third of all rows ends in one reducer.  Here each
wanted rank is narrowed down in three counting passes instead:

1. a monotone logarithmic bucket of the value,
2. a linear split of the one bucket that holds the rank,
3. the distinct values of what is left.

A pass is a map-side combined count, and the passes shuffle counters, not rows.
The number of counters per group and pass has a fixed bound whatever the row
count (a bucket spans 1/4096 of an e-fold, its parts at most 2^20 doubles).
Passes 2 and 3 see only rows of the buckets that hold a wanted rank, and are
skipped at run time when a bucket holds a single value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayloom.session import cut_lineage

LOG_BUCKETS_PER_E = 4096
LINEAR_BUCKETS = 1 << 20
_SHIFT = 4_000_000          # above 4096 * 746, so magnitudes stay positive
_INF_BUCKET = 9_000_000


def log_bucket(v: Column) -> Column:
    """Monotone integer bucket of any double; zero and infinities get their own."""
    size = F.abs(v)
    magnitude = (
        F.when(size == float("inf"), F.lit(_INF_BUCKET))
        .otherwise(F.floor(F.log(F.when(size > 0, size).otherwise(1.0)) * LOG_BUCKETS_PER_E) + _SHIFT)
    )
    return F.when(v == 0, F.lit(0).cast("bigint")).otherwise(
        F.when(v < 0, -magnitude).otherwise(magnitude).cast("bigint"))


def linear_bucket(v: Column, low: Column, high: Column) -> Column:
    return F.when(high > low, F.floor((v - low) / (high - low) * LINEAR_BUCKETS)).otherwise(0).cast("bigint")


def _narrowed(source: DataFrame, target: DataFrame, on: Sequence[str], few: bool) -> DataFrame:
    """Inner join that also matches null group keys and adds the target's other columns."""
    right = target.withColumnsRenamed({c: f"_t{c}" for c in on})
    cond = F.lit(True)
    for c in on:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_t{c}"))
    return source.join(F.broadcast(right) if few else right, cond).drop(*[f"_t{c}" for c in on])


def _hits(counts: DataFrame, part: Sequence[str], order: str, *, keep_all: bool = False) -> DataFrame:
    """Keep the counter rows that contain a wanted rank, with the rank made local; ``keep_all`` keeps the others without ranks."""
    upto = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        counts.withColumn("_end", F.sum("_c").over(upto))
        .withColumn("_beg", F.col("_end") - F.col("_c"))
        .withColumn("_want", F.filter("_want", lambda w: (w["off"] >= F.col("_beg")) & (w["off"] < F.col("_end"))))
        .where(F.lit(keep_all) | (F.size("_want") > 0))
        .withColumn("_want", F.transform(
            "_want", lambda w: F.struct(w["rank"].alias("rank"), (w["off"] - F.col("_beg")).alias("off"))))
        .drop("_end", "_beg")
    )


def quantiles(
    df: DataFrame,
    group_cols: Sequence[str],
    value_col: str,
    probs: Sequence[float],
    *,
    mode: str = "exact",
    few_groups: bool = False,
    moments: bool = False,
    store: bool = False,
) -> DataFrame:
    """Linearly interpolated quantiles: ``group_cols``, ``n``, ``q`` (array in the order of ``probs``).

    ``moments`` adds ``mean``, ``std`` (of a sample), ``min`` and ``max`` from the
    counters of the first pass, so that they cost no scan of their own.  ``store``
    writes groups and values once, for sources that are dearer to make than to
    read again.

    ``mode="exact"`` has no group-size limit; ``"bounded"`` uses the built-in
    aggregate and may be named for groups the calendar bounds, such as the days
    of one subject; ``"approx"`` uses the mergeable sketch.  Nothing is chosen by
    the size of the input.  ``few_groups`` states that
    the number of groups is fixed by construction (hours, weekdays, columns), so
    the wanted buckets may be broadcast.  ``df`` is read once per pass, or once
    in all with ``store``.
    """
    probs = [float(p) for p in probs]
    keys = list(group_cols)
    value = F.col(value_col).cast("double")
    rows = df.select(*keys, value.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    if mode not in ("exact", "bounded", "approx"):
        raise ValueError(f"no mode {mode!r}")
    if mode != "exact":
        wanted = F.array(*[F.lit(p) for p in probs])
        agg = F.percentile("_v", wanted) if mode == "bounded" else F.percentile_approx("_v", probs, 10_000)
        further = [F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("std"), F.min("_v").alias("min"), F.max("_v").alias("max")]
        return rows.groupBy(*keys).agg(F.count("_v").alias("n"), agg.alias("q"), *(further if moments else []))

    if store:
        rows = cut_lineage(rows)
    parts = keys or ["_all"]
    few_groups = few_groups or not keys
    if not keys:
        rows = rows.withColumn("_all", F.lit(0))
    rows = rows.withColumn("_b1", log_bucket(F.col("_v")))

    span = [F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    n = F.sum("_c").over(Window.partitionBy(*parts))
    ranks = F.array_distinct(F.flatten(F.array(*[
        F.array(F.floor((n - 1) * F.lit(p)).cast("bigint"), F.ceil((n - 1) * F.lit(p)).cast("bigint"))
        for p in probs])))
    inner = [F.avg("_v").alias("_m"), F.var_pop("_v").alias("_s")] if moments else []
    level1 = (
        rows.groupBy(*parts, "_b1").agg(F.count("_v").alias("_c"), *span, *inner)
        .withColumn("_n", n)
        .withColumn("_want", F.transform(ranks, lambda r: F.struct(r.alias("rank"), r.alias("off"))))
    )
    def settled(d: DataFrame, v: str) -> DataFrame:
        return d.select(*parts, "_n", F.explode("_want").alias("_w"), F.col(v).alias("_v")).select(
            *parts, "_n", F.col("_w.rank").alias("_r"), "_v")

    # the few counters of each pass are stored, so that no later part of the plan counts again
    all1 = cut_lineage(_hits(level1, parts, "_b1", keep_all=moments))
    at1 = all1.where(F.size("_want") > 0)
    found = settled(at1.where(F.col("_lo") == F.col("_hi")), "_lo")
    open1 = at1.where(F.col("_lo") < F.col("_hi")).select(
        *parts, "_b1", "_n", "_want", F.col("_lo").alias("_l1"), F.col("_hi").alias("_h1"))
    if not open1.isEmpty():
        # only the counters meet the wanted ranks again, so that rows are hash-aggregated
        rows2 = _narrowed(rows, open1, [*parts, "_b1"], few_groups).withColumn(
            "_b2", linear_bucket(F.col("_v"), F.col("_l1"), F.col("_h1")))
        counts2 = rows2.groupBy(*parts, "_b1", "_b2").agg(F.count("_v").alias("_c"), *span)
        level2 = _narrowed(counts2, open1.drop("_l1", "_h1"), [*parts, "_b1"], few_groups)
        at2 = cut_lineage(_hits(level2, [*parts, "_b1"], "_b2"))
        found = found.unionByName(settled(at2.where(F.col("_lo") == F.col("_hi")), "_lo"))
        open2 = at2.where(F.col("_lo") < F.col("_hi")).select(
            *parts, "_b1", "_b2", "_n", "_want", F.col("_lo").alias("_l2"), F.col("_hi").alias("_h2"))
        if not open2.isEmpty():
            # buckets are disjoint intervals, so the ends of a part pick out exactly its rows
            rows3 = _narrowed(rows, open2, [*parts, "_b1"], few_groups).where(F.col("_v").between(F.col("_l2"), F.col("_h2")))
            counts3 = rows3.groupBy(*parts, "_b1", "_b2", "_v").agg(F.count("_v").alias("_c"))
            level3 = _narrowed(counts3, open2.drop("_l2", "_h2"), [*parts, "_b1", "_b2"], few_groups)
            found = found.unionByName(settled(_hits(level3, [*parts, "_b1", "_b2"], "_v"), "_v"))
    by_rank = found.groupBy(*parts).agg(
        F.first("_n").alias("n"),
        F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("_m"))   # at most 2 per quantile

    def interpolated(p: float) -> Column:
        h = (F.col("n") - 1) * F.lit(p)
        low = F.element_at("_m", F.floor(h).cast("bigint"))
        high = F.element_at("_m", F.ceil(h).cast("bigint"))
        return F.when(low == high, low).otherwise(low + (high - low) * (h - F.floor(h)))

    out = by_rank.select(*parts, "n", F.array(*[interpolated(p) for p in probs]).alias("q"))
    if moments:
        mean = F.sum(F.col("_c") * F.col("_m")).over(Window.partitionBy(*parts)) / F.col("_n")
        around = F.sum(F.col("_c") * (F.col("_s") + F.pow(F.col("_m") - F.col("_mean"), 2)))
        own = all1.withColumn("_mean", mean).groupBy(*parts).agg(
            F.first("_mean").alias("mean"), F.when(F.first("_n") > 1, F.sqrt(around / (F.first("_n") - 1))).alias("std"),
            F.min("_lo").alias("min"), F.max("_hi").alias("max"))
        out = _narrowed(out, own, parts, few_groups)
    return out.select(*keys, "n", "q", *(["mean", "std", "min", "max"] if moments else []))


def average_ranks(df: DataFrame, group_cols: Sequence[str], value_col: str) -> DataFrame:
    """Average 1-based rank of every distinct value: groups, ``value_col``, ``n_equal``, ``rank``.

    Ranks are sums of three bounded running counts (bucket, part of bucket,
    value in part), so no window ever spans a whole group.
    """
    keys = list(group_cols)
    counts = (
        df.select(*keys, F.col(value_col).cast("double").alias("_v"))
        .where(F.col("_v").isNotNull() & ~F.isnan("_v"))
        .groupBy(*keys, "_v").agg(F.count("_v").alias("_c"))
        .withColumn("_b1", log_bucket(F.col("_v")))
    )
    parts = keys or ["_all"]
    if not keys:
        counts = counts.withColumn("_all", F.lit(0))

    def before(d: DataFrame, part: Sequence[str], order: str, out: str) -> DataFrame:
        w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return d.withColumn(out, F.sum("_c").over(w) - F.col("_c"))

    first = before(
        counts.groupBy(*parts, "_b1").agg(
            F.sum("_c").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")),
        parts, "_b1", "_o1").drop("_c")
    split = counts.join(first, [*parts, "_b1"]).withColumn(
        "_b2", linear_bucket(F.col("_v"), F.col("_lo"), F.col("_hi")))
    second = before(
        split.groupBy(*parts, "_b1", "_b2").agg(F.sum("_c").alias("_c")),
        [*parts, "_b1"], "_b2", "_o2").drop("_c")
    third = before(split.join(second, [*parts, "_b1", "_b2"]), [*parts, "_b1", "_b2"], "_v", "_o3")
    rank = F.col("_o1") + F.col("_o2") + F.col("_o3") + (F.col("_c") + 1) / 2
    return third.select(*keys, F.col("_v").alias(value_col), F.col("_c").alias("n_equal"), rank.alias("rank"))


def dense_number(values: DataFrame, by: str, out: str) -> DataFrame:
    """Number the distinct values of ``by`` from 0 in their order, whatever the layout.

    Values are sorted by range; a value's number is its place in its range plus
    the sizes of the ranges before, of which there are as many as tasks.
    """
    sorted_ = cut_lineage(values.select(by).distinct().repartitionByRange(by).withColumn("_range", F.spark_partition_id()))
    sizes = sorted_.groupBy("_range").agg(F.count("*").alias("_c"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(by)) - 1
    return sorted_.join(offsets, "_range").select(by, (F.col("_before") + place).alias(out))


def lookup_by_frequency(
    rows: DataFrame, table: DataFrame, on: Sequence[str], count_col: str, *, heavy_share: float = 0.001
) -> DataFrame:
    """Inner join on a table that says how often each key occurs in ``rows``.

    Keys above ``heavy_share`` of all rows number at most ``1 / heavy_share``, so
    they can be broadcast whatever the data; the rest holds no hot key and is
    shuffled.
    """
    total = table.agg(F.sum(count_col)).scalar()
    values = [c for c in table.columns if c not in on and c != count_col]
    marked = table.withColumn("_heavy", F.col(count_col) > total * heavy_share)

    def side(rows_of: DataFrame, mark: str) -> DataFrame:
        return rows_of.select(*[F.col(c).alias(f"{mark}{c}") for c in on],
                              F.struct(*values).alias(f"{mark}_value"))

    heavy, light = side(marked.where("_heavy"), "_h_"), side(marked.where(~F.col("_heavy")), "_l_")
    found = F.col("_h__value").isNotNull()
    # rows settled by the broadcast get a key that matches nothing and spreads them evenly
    spread = F.when(found, F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(9973)) + 1).otherwise(0)
    met = rows.join(F.broadcast(heavy), [F.col(c) == F.col(f"_h_{c}") for c in on], "left").withColumn("_spread", spread)
    both = met.join(light.withColumn("_l_spread", F.lit(0).cast("long")),
                    [*[F.when(~found, F.col(c)) == F.col(f"_l_{c}") for c in on],
                     F.col("_spread") == F.col("_l_spread")], "left")
    value = F.coalesce("_h__value", "_l__value")
    return (both.withColumn("_value", value).where(F.col("_value").isNotNull())
            .select(*rows.columns, *[F.col(f"_value.{c}").alias(c) for c in values]))
