"""Anomaly detectors and their vote.  Labels: 1 normal, -1 anomaly."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.functions.quantiles import lookup_by_frequency, quantiles
from dayloom.functions.sums import summed
from dayloom.operators.neighbors import BLOCK_ROWS, as_array, build_cells, in_tiles, local_outlier_factor
from dayloom.session import cut_lineage


#: Draws are 28 bits of an MD5, so that other engines can repeat them.
_DRAW_BITS, _DRAW_PRIME = 28, 268_435_399


def _bits(text: Column, first: int) -> Column:
    return F.conv(F.substring(F.md5(text), first, _DRAW_BITS // 4), 16, 10).cast("long")


def draw_samples(df: DataFrame, id_cols: Sequence[str], vec: str, trees: int, size: int, seed: int, *, n: int | None = None) -> DataFrame:
    """``tree``, ``vec``: a sample of ``size`` rows per tree, repeatable on any layout.

    One hash of the row gives two numbers a and b; its draw for tree t is
    (a + (t + 1) b) modulo a prime, and the rows with the least draws are taken.
    Rows with larger draws are thinned out before they are sorted into trees, so
    the trim to ``size`` sees a few hundred rows per tree.  ``n`` is the number of
    rows, if known.
    """
    n = df.count() if n is None else n
    rate = min(1.0, (size + 8 * size ** 0.5) / max(n, 1))
    key = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in id_cols])
    drawn = df.select(F.col(vec).alias("vec"), _bits(key, 1).alias("_a"), _bits(key, 9).alias("_b"))
    draws = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(
        t.alias("tree"), ((F.col("_a") + (t + 1) * F.col("_b")) % _DRAW_PRIME).alias("u")))
    low = F.filter(draws, lambda d: d["u"] < F.lit(int(rate * _DRAW_PRIME) + 1))
    picked = drawn.select("vec", F.explode(low).alias("d")).select("d.tree", "d.u", "vec")
    chosen = F.slice(F.array_sort(F.collect_list(F.struct("u", "vec"))), 1, size)
    return picked.groupBy("tree").agg(chosen.alias("s")).select("tree", F.explode("s.vec").alias("vec"))


NODE_SCHEMA = "tree int, node int, feature int, cut double, left int, right int, depth double"


def _average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of ``n`` rows."""
    n = np.asarray(n, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        deep = 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n
    return np.where(n > 2, deep, np.where(n == 2, 1.0, 0.0))


def _node_draws(seed: int, tree: int, node: int) -> tuple[float, float]:
    digest = hashlib.md5(f"{seed}:{tree}:{node}".encode()).hexdigest()
    return int(digest[:7], 16) / 2**_DRAW_BITS, int(digest[8:15], 16) / 2**_DRAW_BITS


def grow_trees(samples: DataFrame, size: int, seed: int) -> DataFrame:
    """One random isolation tree per sample, as node rows; the children of node i are 2 i and 2 i + 1.

    Feature and cut of a node come from the MD5 of seed, tree and node: one of the
    features that vary in it, and a point between its least and largest value.
    """
    limit = int(np.ceil(np.log2(max(size, 2))))

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["vec"].to_numpy()).astype(float)
        tree, nodes, todo = int(key[0]), [], [(1, np.arange(len(x)), 0)]
        while todo:
            at, rows, depth = todo.pop()
            low, high = x[rows].min(0), x[rows].max(0)
            varying = np.flatnonzero(high > low)
            if depth >= limit or len(rows) <= 1 or not len(varying):
                nodes.append((tree, at, -1, 0.0, -1, -1, depth + float(_average_path(len(rows)))))
                continue
            which, where = _node_draws(seed, tree, at)
            f = int(varying[int(which * len(varying))])
            cut = float(low[f] + where * (high[f] - low[f]))
            left = x[rows, f] <= cut
            nodes.append((tree, at, f, cut, 2 * at, 2 * at + 1, 0.0))
            todo += [(2 * at, rows[left], depth + 1), (2 * at + 1, rows[~left], depth + 1)]
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "cut", "left", "right", "depth"])

    return samples.groupBy("tree").applyInPandas(grow, NODE_SCHEMA)


def isolation_nodes(df: DataFrame, id_cols: Sequence[str], features: Sequence[str], *, trees: int = 100, sample_size: int = 256,
                    seed: int = 42) -> DataFrame:
    """The forest as a table of nodes."""
    rows = as_array(df, features, "_vec")
    return grow_trees(draw_samples(rows, id_cols, "_vec", trees, sample_size, seed), sample_size, seed)


def isolation_scores(df: DataFrame, id_cols: Sequence[str], features: Sequence[str], *, trees: int = 100,
                     sample_size: int = 256, seed: int = 42, store: bool = True) -> DataFrame:
    """Anomaly score in (0, 1] per row; larger is more isolated.

    The forest is at most ``trees * (2 * sample_size - 1)`` nodes whatever the
    number of rows, so it is sent to every task, where all rows walk it.  Rows
    are read for the count, the samples and the scores; ``store`` writes them
    once, for sources that are dearer to make than to read again.
    """
    rows = as_array(df, features, "_vec")
    rows = cut_lineage(rows) if store else rows
    drawn = rows.count()
    nodes = grow_trees(draw_samples(rows, id_cols, "_vec", trees, sample_size, seed, n=drawn), sample_size, seed).toPandas()
    forest = []
    for _, g in nodes.sort_values(["tree", "node"]).groupby("tree"):
        place = {n: i for i, n in enumerate(g["node"])}
        to = lambda c: np.array([place.get(n, -1) for n in c])
        forest.append((g["feature"].to_numpy(), g["cut"].to_numpy(), to(g["left"]), to(g["right"]), g["depth"].to_numpy()))
    shared = df.sparkSession.sparkContext.broadcast(forest)
    norm = max(float(_average_path(min(sample_size, drawn))), 1e-12)

    @F.pandas_udf("double")
    def score(vec: pd.Series) -> pd.Series:
        x = np.stack(vec.to_numpy()).astype(float)
        total = np.zeros(len(x))
        every = np.arange(len(x))
        for feature, cut, left, right, depth in shared.value:
            at = np.zeros(len(x), dtype=int)
            inner = feature[at] >= 0
            while inner.any():
                i, n = every[inner], at[inner]
                at[i] = np.where(x[i, feature[n]] <= cut[n], left[n], right[n])
                inner = feature[at] >= 0
            total += depth[at]
        return pd.Series(2.0 ** (-total / len(shared.value) / norm))

    return rows.withColumn("score", score("_vec")).drop("_vec")


def label_by_share(scored: DataFrame, score: str, share: float, *, label: str = "label", mode: str = "exact") -> DataFrame:
    """-1 for rows above the (1 - share) quantile of the score."""
    cut = quantiles(scored, [], score, [1 - share], mode=mode).select(F.col("q")[0]).first()[0]
    return scored.withColumn(label, F.when(F.col(score) > cut, -1).otherwise(1))


def label_by_shares(scored: Mapping[str, tuple[DataFrame, float]]) -> dict[str, DataFrame]:
    """:func:`label_by_share` of ``score`` for several detectors, each with its share, by one run of quantiles over all of them."""
    long = reduce(DataFrame.unionByName, [frame.select(F.lit(name).alias("detector"), "score") for name, (frame, _) in scored.items()])
    shares = sorted({1 - share for _, share in scored.values()})
    found = {r["detector"]: dict(zip(shares, r["q"])) for r in quantiles(long, ["detector"], "score", shares, few_groups=True).collect()}
    return {name: frame.withColumn("label", F.when(F.col("score") > F.lit(found.get(name, {}).get(1 - share)), -1).otherwise(1))
            for name, (frame, share) in scored.items()}


def isolation_forest(df: DataFrame, id_cols: Sequence[str], features: Sequence[str], *, contamination: float | None = 0.05,
                     trees: int = 100, sample_size: int = 256, seed: int = 42, store: bool = True) -> DataFrame:
    """Isolation score and label per row; without labels where ``contamination`` is None."""
    scored = isolation_scores(df, id_cols, features, trees=trees, sample_size=sample_size, seed=seed, store=store)
    # the score is used twice, so it is stored once
    scored = cut_lineage(scored.select(*id_cols, "score"))
    return scored if contamination is None else label_by_share(scored, "score", contamination)


def lof(df: DataFrame, id_cols: Sequence[str], features: Sequence[str], *, k: int = 20, contamination: float | None = 0.05,
        block_rows: int = BLOCK_ROWS, nearest_blocks: int | None = None) -> DataFrame:
    """Local outlier factor per row; exact unless ``nearest_blocks`` limits the search; without labels where ``contamination`` is None.

    A vector of one row keeps that row's ids; only rows of copies are looked up by their vector.
    """
    rows = as_array(df, features, "_vec").select(*id_cols, "_vec")
    only = {f"_only{i}": c for i, c in enumerate(id_cols)}
    points = rows.groupBy(F.col("_vec").alias("vec")).agg(F.count("*").alias("weight"), *[F.first(c).alias(o) for o, c in only.items()])
    cells = build_cells(points, block_rows=block_rows, boxed_blocks=not in_tiles(len(features), nearest_blocks))
    copied = F.col("weight") > 1
    scored = cut_lineage(cells.points.select("id", F.when(copied, F.col("vec")).alias("_vec"), "weight", *only).join(local_outlier_factor(
        cells, k, block_rows=block_rows, nearest_blocks=nearest_blocks), "id").withColumnRenamed("lof", "score").drop("id"))
    back = scored.where(~copied).select(*[F.col(o).alias(c) for o, c in only.items()], "score")
    copies = scored.where(copied).select("_vec", "weight", "score")
    if not copies.isEmpty():
        back = cut_lineage(back.unionByName(lookup_by_frequency(rows, copies, ["_vec"], "weight").drop("_vec")))
    return back if contamination is None else label_by_share(back, "score", contamination)


def mahalanobis(df: DataFrame, id_cols: Sequence[str], features: Sequence[str], *, share: float | None = 0.1) -> DataFrame:
    """Distance from the mean in units of the covariance, over rows that have all features; without labels where ``share`` is None.

    Two scans: means, and products of the centred features as one matrix per task.
    The distance is the length of the centred row after it was multiplied by a
    root of the inverse covariance; directions without spread do not count.
    """
    whole = df.na.drop(subset=list(features))
    numbers, d = whole.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(features)]), len(features)
    first = summed(numbers, lambda x: np.concatenate([[len(x)], x.sum(0)]), d + 1)
    n, mean = first[0], first[1:] / max(first[0], 1.0)

    def products(x: np.ndarray) -> np.ndarray:
        z = x - mean
        return (z.T @ z).ravel()

    covariance = summed(numbers, products, d * d).reshape(d, d) / max(n - 1.0, 1.0)
    scale = np.sqrt(np.where(np.diag(covariance) > 0, np.diag(covariance), 1.0))
    value, vector = np.linalg.eigh(covariance / np.outer(scale, scale))
    kept = value > 1e-12 * max(value.max(), 1e-300)
    root = (vector[:, kept] / np.sqrt(value[kept])) / scale[:, None]

    @F.pandas_udf("double")
    def distance(*columns: pd.Series) -> pd.Series:
        z = (np.stack([c.to_numpy(dtype=float) for c in columns], axis=1) - mean) @ root
        return pd.Series(np.sqrt((z * z).sum(1)))

    scored = whole.select(*id_cols, distance(*[F.col(c).cast("double") for c in features]).alias("score"))
    scored = cut_lineage(scored)
    return scored if share is None else label_by_share(scored, "score", share)


def ensemble(labels: Mapping[str, DataFrame], id_cols: Sequence[str]) -> DataFrame:
    """One label column per detector and ``ensemble``: normal if more than half say so."""
    out = None
    for name, frame in labels.items():
        one = frame.select(*id_cols, F.col("label").alias(name))
        out = one if out is None else out.join(one, list(id_cols))
    normal = sum(((F.col(n) == 1).cast("int") for n in labels), F.lit(0))
    return out.withColumn("ensemble", F.when(normal / len(labels) > 0.5, 1).otherwise(-1))


def detector_rates(votes: DataFrame, detectors: Sequence[str]) -> DataFrame:
    """Anomalies, normals and anomaly rate per detector."""
    long = votes.select(*detectors).unpivot([], list(detectors), "detector", "label")
    return long.groupBy("detector").agg(
        F.count_if(F.col("label") == -1).alias("n_anomalies"), F.count_if(F.col("label") == 1).alias("n_normal"),
        F.avg((F.col("label") == -1).cast("double")).alias("anomaly_rate"))
