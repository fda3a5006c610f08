"""Random forests of regression trees, grown level by level for all trees and folds at once.

Each level is one scan: every task adds up counts and sums of the target by tree,
node, feature and bin, and the best split of every node is chosen from these
sums.  A tree that is cut off at a smaller depth, or a forest of its first trees,
is the one that would have been grown so, so that one growth answers all depths
and numbers of trees of a grid.  Sums are whole numbers and bootstrap weights come
from MD5 digests: the layout of the rows changes nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dayloom.functions.quantiles import average_ranks
from dayloom.operators.anomaly import _DRAW_PRIME, _bits
from dayloom.session import cut_lineage

BINS = 32
#: The target is kept in units of a thousandth.
SCALE = 1000
#: Least gain of a split, in squared units; smaller ones are rounding.
MIN_GAIN = 1e-3
#: Nodes of all trees that a driver and a task hold, at about 40 bytes each.
MAX_NODES = 5_000_000
#: Chances of a bootstrap weight of at most 0, 1, ...: Poisson with mean 1, in draws below the prime.
WEIGHT_LIMITS = tuple(int(_DRAW_PRIME * math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1))) for k in range(8))


@dataclass
class Tree:
    """Nodes in the order of their making; the right child follows the left one."""

    node: np.ndarray = field(default_factory=lambda: np.ones(1, np.int64))      # children of i are 2 i and 2 i + 1
    feature: np.ndarray = field(default_factory=lambda: np.full(1, -1, np.int16))
    bin: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int16))
    left: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int32))
    rows: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    total: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    gain: np.ndarray = field(default_factory=lambda: np.zeros(1))
    new: int = 0        # first node of the last level

    def walk(self, bins: np.ndarray, depth: int) -> np.ndarray:
        at, every = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(depth):
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                break
            at = np.where(inner, self.left[at] + (bins[every, f] > self.bin[at]), at)
        return at

    def split(self, at: np.ndarray, feature: np.ndarray, bin_: np.ndarray, gain: np.ndarray) -> None:
        first, n = len(self.node), len(at)
        self.feature[at], self.bin[at], self.gain[at] = feature, bin_, gain
        self.left[at] = first + 2 * np.arange(n)
        children = np.stack([2 * self.node[at], 2 * self.node[at] + 1], axis=1).ravel()
        self.node = np.concatenate([self.node, children])
        for name, value in (("feature", -1), ("bin", 0), ("left", 0), ("rows", 0), ("total", 0), ("gain", 0)):
            old = getattr(self, name)
            setattr(self, name, np.concatenate([old, np.full(2 * n, value, old.dtype)]))
        self.new = first


@dataclass
class Forest:
    features: list[str]
    cuts: list[np.ndarray]      # of each feature; bin b holds what is above b - 1 cuts and at most the next
    trees: list[list[Tree]]     # by fit: fit 0 learns from all training rows, fit f from folds before f
    depth: int


def feature_cuts(df: DataFrame, features: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """At most ``bins`` cuts of each feature with about equally many rows between them; equal values stay together."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("at"), F.col(c).cast("double").alias("v")) for i, c in enumerate(features)])).alias("s")).select("s.at", "s.v")
    ranks = cut_lineage(average_ranks(long, ["at"], "v"))
    n = ranks.groupBy("at").agg(F.sum("n_equal").alias("n"))
    last = F.col("rank") + (F.col("n_equal") - 1) / 2        # rank of the last row of a value
    cuts = (ranks.join(F.broadcast(n), "at").withColumn("bin", F.floor((last - 1) * bins / F.col("n")))
            .groupBy("at", "bin").agg(F.max("v").alias("cut")).collect())       # at most bins rows per feature
    return [np.sort(np.array([r.cut for r in cuts if r["at"] == i], float)) for i in range(len(features))]


def _binned(df: DataFrame, features: Sequence[str], cuts: Sequence[np.ndarray], keys: Sequence[str], target: str, seed: int) -> DataFrame:
    """``keys``, bins, target ``y`` in whole units, two draws, ``fold`` (0 if there is none)."""
    def place(name: str, own: np.ndarray):
        v = F.col(name).cast("double")
        return F.coalesce(F.size(F.filter(F.array(*[F.lit(float(c)) for c in own]), lambda c: c < v)) if len(own) else F.lit(0), F.lit(0))

    key = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in keys])
    fold = F.col("fold").cast("int") if "fold" in df.columns else F.lit(0)
    return df.where(F.col(target).isNotNull()).select(
        *keys, F.array(*[place(c, own).cast("int") for c, own in zip(features, cuts)]).alias("bins"),
        F.floor(F.col(target).cast("double") * SCALE + 0.5).cast("long").alias("y"), _bits(key, 1).alias("a"), _bits(key, 9).alias("b"),
        fold.alias("fold"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    lists = batch.column("bins")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _learns(fold: np.ndarray, fit: int) -> np.ndarray:
    return (fold >= 0) & ((fit == 0) | (fold < fit))


def _histograms(shared, bins: int):
    """Counts and sums of the nodes of the last level; each batch is added up before it is sent."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest: Forest = shared.value
        wide = np.arange(len(forest.features)) * (bins + 1)
        for batch in batches:
            x, fold = _matrix(batch), batch.column("fold").to_numpy()
            y, a, b = (batch.column(c).to_numpy() for c in "yab")
            for fit, trees in enumerate(forest.trees):
                for t, tree in enumerate(trees):
                    if tree.new >= len(tree.node):
                        continue
                    w = np.searchsorted(WEIGHT_LIMITS, (a + (t + 1) * b) % _DRAW_PRIME, "right")
                    some = np.flatnonzero((w > 0) & _learns(fold, fit))
                    at = tree.walk(x[some], forest.depth)
                    some, at = some[at >= tree.new], at[at >= tree.new]
                    if not len(some):
                        continue
                    code = (at[:, None] * (len(wide) * (bins + 1)) + wide[None, :] + x[some]).ravel()
                    cell, place = np.unique(code, return_inverse=True)
                    n = np.bincount(place, np.repeat(w[some], len(wide))).astype(np.int64)
                    s = np.zeros(len(cell), np.int64)
                    np.add.at(s, place, np.repeat(w[some] * y[some], len(wide)))
                    node, rest = np.divmod(cell, len(wide) * (bins + 1))
                    yield pa.record_batch({
                        "fit": pa.array(np.full(len(cell), fit, np.int32)), "tree": pa.array(np.full(len(cell), t, np.int32)),
                        "node": pa.array(node.astype(np.int32)), "feature": pa.array((rest // (bins + 1)).astype(np.int32)),
                        "bin": pa.array((rest % (bins + 1)).astype(np.int32)), "n": pa.array(n), "s": pa.array(s)})

    return run


def _best_splits(cells: DataFrame, min_rows: int) -> DataFrame:
    """One row per node: its count and sum, and feature, bin and gain of its best split (ties: least feature, then bin)."""
    group = ["fit", "tree", "node"]
    whole = Window.partitionBy(*group, "feature")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)      # at most the bins of a feature
    sums = cells.select(*group, "feature", "bin", F.sum("n").over(upto).alias("nl"), F.sum("s").over(upto).alias("sl"),
                        F.sum("n").over(whole).alias("rows"), F.sum("s").over(whole).alias("total"))
    nr, sr = F.col("rows") - F.col("nl"), F.col("total") - F.col("sl")
    part = lambda s, n: s.cast("double") * s.cast("double") / n
    gain = F.when((F.col("nl") >= min_rows) & (nr >= min_rows),
                  part(F.col("sl"), F.col("nl")) + part(sr, nr) - part(F.col("total"), F.col("rows")))
    order = Window.partitionBy(*group).orderBy(F.desc_nulls_last("gain"), "feature", "bin")
    return sums.withColumn("gain", gain).withColumn("_at", F.row_number().over(order)).where("_at = 1").drop("_at", "nl", "sl")


def grow_forest(
    df: DataFrame, features: Sequence[str], target: str = "score", *, keys: Sequence[str] = ("day",), trees: int = 100, depth: int = 10,
    min_rows: int = 2, folds: int = 0, bins: int = BINS, seed: int = 42,
) -> tuple[Forest, DataFrame]:
    """The forest, and the rows of ``df`` in the form that ``evaluate`` reads.

    With ``folds``, ``df`` has ``fold`` (-1: only tested), and a forest is grown
    for the rows before each fold beside that of all training rows.  Rows without
    target go; a missing feature goes left at every split.  Equal ``keys`` draw
    equal weights.  A forest over ``MAX_NODES`` nodes is refused.
    """
    spark = df.sparkSession
    train = df.where("fold >= 0") if "fold" in df.columns else df
    cuts = feature_cuts(train.where(F.col(target).isNotNull()), features, bins)
    data = cut_lineage(_binned(df, features, cuts, keys, target, seed))
    forest = Forest(list(features), cuts, [[Tree() for _ in range(trees)] for _ in range(folds + 1)], depth)
    for level in range(depth + 1):
        shared = spark.sparkContext.broadcast(forest)
        cells = data.mapInArrow(_histograms(shared, bins), "fit int, tree int, node int, feature int, bin int, n long, s long")
        cells = cells.groupBy("fit", "tree", "node", "feature", "bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        found = _best_splits(cells, min_rows).toPandas()      # one row per node of a level, see MAX_NODES
        shared.destroy()
        for one in (t for fit in forest.trees for t in fit):
            one.new = len(one.node)
        for (fit, t), rows in found.sort_values("node").groupby(["fit", "tree"]):
            tree = forest.trees[fit][t]
            tree.rows[rows["node"]], tree.total[rows["node"]] = rows["rows"], rows["total"]
            rows = rows[rows["gain"] > MIN_GAIN]
            if level < depth and len(rows):
                tree.split(*(rows[c].to_numpy() for c in ("node", "feature", "bin", "gain")))
        made = sum(len(t.node) for fit in forest.trees for t in fit)
        if made > MAX_NODES:
            raise ValueError(f"{made} nodes; fewer trees, less depth or larger leaves are needed")
        if all(t.new >= len(t.node) for fit in forest.trees for t in fit):
            break
    return forest, data


NODE_DDL = "tree int, node long, feature int, cut double, rows long, mean double, gain double"


def forest_nodes(spark: SparkSession, forest: Forest) -> DataFrame:
    """The forest of all training rows as a table; ``feature`` is -1, ``cut`` and ``gain`` null in leaves; gains are in squared units of the target."""
    rows = []
    for t, tree in enumerate(forest.trees[0]):
        for i in np.flatnonzero(tree.rows > 0):
            f = int(tree.feature[i])
            rows.append((t, int(tree.node[i]), f, float(forest.cuts[f][tree.bin[i]]) if f >= 0 else None, int(tree.rows[i]),
                         int(tree.total[i]) / int(tree.rows[i]) / SCALE, float(tree.gain[i]) / SCALE**2 if f >= 0 else None))
    return spark.createDataFrame(rows, NODE_DDL)


def forest_importance(nodes: DataFrame, features: Sequence[str]) -> DataFrame:
    """``feature, importance``: gains by feature, each tree scaled to 1, their mean scaled to 1."""
    gains = nodes.where("feature >= 0").groupBy("tree", "feature").agg(F.sum("gain").alias("g"))
    share = gains.withColumn("g", F.col("g") / F.sum("g").over(Window.partitionBy("tree")))      # one row per tree and feature
    names = nodes.sparkSession.createDataFrame(list(enumerate(features)), "at int, name string")
    summed = share.groupBy(F.col("feature").alias("at")).agg(F.sum("g").alias("g"))
    out = names.join(summed, "at", "left").select(F.col("name").alias("feature"), F.coalesce("g", F.lit(0.0)).alias("g"))
    return out.select("feature", F.try_divide("g", F.sum("g").over(Window.partitionBy())).alias("importance"))


def _errors(shared, settings: Sequence[tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest: Forest = shared.value
        for batch in batches:
            x, fold, y = _matrix(batch), batch.column("fold").to_numpy(), batch.column("y").to_numpy() / SCALE
            out = []
            for fit, trees in enumerate(forest.trees):
                roles = [("train", fold >= 0), ("test", fold < 0)] if fit == 0 else [("fold", fold == fit)]
                for depth in sorted({d for _, d in settings}):
                    sums = np.zeros(len(x))
                    for t, tree in enumerate(trees):
                        at = tree.walk(x, depth)
                        sums += tree.total[at] / np.maximum(tree.rows[at], 1) / SCALE
                        for n in {n for n, d in settings if d == depth and n == t + 1}:
                            e = y - sums / n
                            out += [(fit, role, n, depth, float((e[m] ** 2).sum()), float(np.abs(e[m]).sum()), float(y[m].sum()),
                                     float((y[m] ** 2).sum()), int(m.sum())) for role, m in roles if m.any()]
            if out:
                names = ("fit", "role", "trees", "depth", "sse", "sae", "sy", "syy", "n")
                types = (pa.int32(), pa.string(), pa.int32(), pa.int32(), *[pa.float64()] * 4, pa.int64())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return run


def evaluate(forest: Forest, data: DataFrame, settings: Sequence[tuple[int, int]]) -> DataFrame:
    """``trees, depth, role, mse, mae, r2, n`` of each (trees, depth); one scan for all.

    ``role``: ``train``, ``test`` (fold -1), or ``cv``, the mean over folds of what
    a forest of the earlier folds leaves.
    """
    if not all(1 <= n <= len(forest.trees[0]) and 0 <= d <= forest.depth for n, d in settings):
        raise ValueError("settings have more trees or depth than were grown")
    shared = data.sparkSession.sparkContext.broadcast(forest)
    sums = data.mapInArrow(_errors(shared, list(settings)), "fit int, role string, trees int, depth int, sse double, sae double, "
                           "sy double, syy double, n long")
    keys = ["fit", "role", "trees", "depth"]
    one = sums.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("sse", "sae", "sy", "syy", "n")])
    spread = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    each = one.select(*keys, "n", (F.col("sse") / F.col("n")).alias("mse"), (F.col("sae") / F.col("n")).alias("mae"),
                      (1 - F.try_divide("sse", spread)).alias("r2"))
    role = F.when(F.col("role") == "fold", "cv").otherwise(F.col("role"))
    return each.groupBy("trees", "depth", role.alias("role")).agg(
        F.avg("mse").alias("mse"), F.avg("mae").alias("mae"), F.avg("r2").alias("r2"), F.sum("n").alias("n"))


def forest_grid(
    df: DataFrame, features: Sequence[str], target: str = "score", *, keys: Sequence[str] = ("day",), trees: Sequence[int] = (100, 200),
    depths: Sequence[int] = (10, 20, 30), min_rows: Sequence[int] = (1, 2), folds: int = 3, bins: int = BINS, seed: int = 42,
) -> DataFrame:
    """``evaluate`` of every combination; only the numbers of rows of a leaf are grown apart.  ``best``: least ``cv`` error."""
    out = None
    for least in min_rows:
        forest, data = grow_forest(df, features, target, keys=keys, trees=max(trees), depth=max(depths), min_rows=least, folds=folds,
                                   bins=bins, seed=seed)
        some = evaluate(forest, data, [(n, d) for n in trees for d in depths]).withColumn("min_rows", F.lit(least))
        out = some if out is None else out.unionByName(some)
    out = cut_lineage(out)
    order = Window.partitionBy("role").orderBy("mse", "trees", "depth", "min_rows")     # a row per combination
    return out.withColumn("best", (F.row_number().over(order) == 1) & (F.col("role") == "cv"))
