"""Distances between rows of a feature table, exactly and in bounded tasks.

Recursive median splits of a sample make at most ``CELLS`` cells; each cell is
split on in its own task, down to blocks of about ``block_rows`` rows.  Every
block and cell has the box of its rows.  A row can only have a neighbour within
``radius`` in a block whose box is within that radius, so it visits just those
blocks, and inside them it is compared with the rows of those leaves (``LEAF``
rows, again with their boxes) that are near enough.  Nearest neighbours take
three steps with ever smaller radius: the row's own group, the few blocks that
are nearest, the rest within reach.  A task holds one block and one part of its
visitors.  Copies of a vector are one row with a weight.

Cost: in few dimensions a row is compared with its surroundings only (the tests
state shares); in many, or where most of the table is within the radius, exact
results need most of the table, whatever the layout.  Above ``WIDE`` columns
nearest neighbours are therefore found by tiles of many cells and matrix
products, which bound all distances of a tile and a strip of rows at once; only
pairs within these bounds are measured.  Pairs still grow with the square of the
table there, at a small cost each: a task holds one tile and its neighbours so
far, and the table streams past it in strips.  ``nearest_blocks`` bounds
the work: neighbours are then those of that many blocks, and recall is
what the tests measure.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayloom.functions.quantiles import dense_number, lookup_by_frequency
from dayloom.session import cut_lineage

#: Cells, and sampled rows per cell, that the first splits are made of on the driver, at most.
CELLS, SAMPLE_PER_CELL = 2048, 32
BLOCK_ROWS, LEAF = 256, 4
#: Blocks that a row visits before its radius is settled.
FIRST_BLOCKS = 4
_CHUNK = 2_000_000      # numbers in one array of differences
#: More columns than these are searched in tiles, of so many rows at least and at most; a large table has about this many of them or more.
WIDE = 16
TILE_ROWS, TILES = (4096, 32_768), 24
_STRIP = 8192           # rows that are in one product with a tile, at most


def as_array(df: DataFrame, features: Sequence[str], out: str = "vec") -> DataFrame:
    return df.withColumn(out, F.array(*[F.col(c).cast("double") for c in features]))


def distinct_vectors(df: DataFrame, vec: str = "vec") -> DataFrame:
    """``vec``, ``weight``: copies of a vector as one row, counted with map-side combine."""
    return df.groupBy(F.col(vec).alias("vec")).agg(F.count("*").alias("weight"))


def median_splits(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Rows of ``x`` in groups of at most ``most``: halved at the median of the column that varies most, again and again."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            if len(rows):
                out.append(rows)
            continue
        column = x[rows].var(0).argmax()
        rows = rows[np.argsort(x[rows, column], kind="stable")]
        todo += [rows[len(rows) // 2:], rows[:len(rows) // 2]]
    return out


@dataclass
class Router:
    """Splits of the sample as arrays; a leaf has feature -1 and its cell in ``left``."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray

    @staticmethod
    def of(x: np.ndarray, cells: int) -> Router:
        nodes: list[list] = [[-1, 0.0, 0, 0]]
        leaves, todo = 0, [(0, np.arange(len(x)), cells)]
        while todo:
            at, rows, share = todo.pop()
            column = x[rows].var(0).argmax() if len(rows) else 0
            cut = np.median(x[rows, column]) if len(rows) else 0.0
            low = x[rows, column] <= cut
            if share < 2 or low.all() or not low.any():
                nodes[at] = [-1, 0.0, leaves, 0]
                leaves += 1
                continue
            nodes[at] = [int(column), float(cut), len(nodes), len(nodes) + 1]
            todo += [(len(nodes) + 1, rows[~low], share - share // 2), (len(nodes), rows[low], share // 2)]
            nodes += [[-1, 0.0, 0, 0], [-1, 0.0, 0, 0]]
        columns = list(zip(*nodes))
        return Router(np.array(columns[0]), np.array(columns[1]), np.array(columns[2]), np.array(columns[3]))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        open_ = np.flatnonzero(self.feature[at] >= 0)
        while len(open_):
            node = at[open_]
            at[open_] = np.where(x[open_, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
            open_ = open_[self.feature[at[open_]] >= 0]
        return self.left[at]


@dataclass
class Cells:
    low: np.ndarray             # boxes of the cells
    high: np.ndarray
    weight: np.ndarray          # rows of each cell, copies counted
    points: DataFrame           # id, vec, weight, cell, block, and the further columns of the given points
    blocks: DataFrame | None    # cell, block, low, high: boxes of the blocks


def exact_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances without the cancellation of the product form; equal rows are at exactly 0."""
    out = np.empty((len(a), len(b)))
    step = max(1, _CHUNK // max(1, len(b) * a.shape[1]))
    for i in range(0, len(a), step):
        diff = a[i:i + step, None, :] - b[None, :, :]
        out[i:i + step] = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
    return out


def box_distance(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least distance of each row from any point of each box."""
    total = np.zeros((len(x), len(low)))
    for j in range(x.shape[1]):
        gap = np.maximum(np.maximum(low[:, j][None] - x[:, j][:, None], x[:, j][:, None] - high[:, j][None]), 0.0)
        total += gap * gap
    return np.sqrt(total)


def _far_corner(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    total = np.zeros((len(x), len(low)))
    for j in range(x.shape[1]):
        total += np.maximum(np.abs(x[:, j][:, None] - low[:, j][None]), np.abs(high[:, j][None] - x[:, j][:, None])) ** 2
    return np.sqrt(total)


def _wide(radius: np.ndarray) -> np.ndarray:
    """A radius with room for rounding."""
    return radius * (1 + 1e-9) + 1e-9


def _vectors(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    column = table.column("vec")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def build_cells(points: DataFrame, *, block_rows: int = BLOCK_ROWS, cells: int = CELLS, seed: int = 42, boxed_blocks: bool = True) -> Cells:
    """Every distinct vector with an id, its cell and its block.

    Cells are joined with their neighbours until each has half a block of rows;
    a cell has about a ``cells``-th of the rows and is split on in one task.
    Without ``boxed_blocks`` only cells have boxes, which is all that tiles need.
    """
    points = cut_lineage(points)
    n = points.count()
    wanted = int(min(cells, max(1, -(-n // block_rows))))
    order = F.xxhash64(F.lit(seed), "vec")
    rate = min(1.0, 2.0 * wanted * SAMPLE_PER_CELL / max(n, 1))
    thinned = points.select("vec").where(F.pmod(order, F.lit(1 << 30)) < int(rate * (1 << 30)))
    sampled = thinned.orderBy(order, "vec").limit(wanted * SAMPLE_PER_CELL).collect() if wanted > 1 else []
    router = Router.of(np.array([r["vec"] for r in sampled], dtype=float) if sampled else np.zeros((0, 1)), wanted if sampled else 1)

    @F.pandas_udf("int")
    def route(vec: pd.Series) -> pd.Series:
        return pd.Series(router(np.stack(vec.to_numpy()).astype(float)).astype("int32"))

    placed = cut_lineage(points.withColumn("_leaf", route("vec")))
    counts = {r["_leaf"]: r["count"] for r in placed.groupBy("_leaf").count().collect()}      # one row per leaf
    cell_of, held, cell = [], 0, 0
    for leaf in range(int(router.left[router.feature < 0].max()) + 1):
        if held >= max(1, block_rows // 2):
            cell, held = cell + 1, 0
        cell_of.append(cell)
        held += counts.get(leaf, 0)
    if held < block_rows // 2 and cell:         # the last one has too few
        cell_of = [min(c, cell - 1) for c in cell_of]

    further = [f for f in points.schema.fields if f.name not in ("vec", "weight")]

    def split(table: pa.Table) -> pa.Table:
        x, at = _vectors(table), table.column("_leaf")[0].as_py()
        order = np.lexsort(x.T[::-1])       # the same whatever order the rows come in
        groups = median_splits(x[order], block_rows)
        rows = order[np.concatenate(groups)]
        block = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
        own = {"id": pa.array((at << 32) + np.arange(len(rows))), "vec": table.column("vec").take(pa.array(rows)),
               "weight": table.column("weight").take(pa.array(rows)), "cell": pa.array(np.full(len(rows), at, "int32")), "block": pa.array(block.astype("int32"))}
        return pa.table(own | {f.name: table.column(f.name).take(pa.array(rows)) for f in further})

    number = F.element_at(F.lit(cell_of), F.col("_leaf") + 1).cast("int")
    schema = T.StructType(T._parse_datatype_string("id long, vec array<double>, weight long, cell int, block int").fields + further)
    points = cut_lineage(placed.withColumn("_leaf", number).groupBy("_leaf").applyInArrow(split, schema))

    if not boxed_blocks:
        def box(table: pa.Table) -> pa.Table:
            x = _vectors(table)
            return pa.table({"cell": table.column("cell")[:1], "low": pa.array([x.min(0)], pa.list_(pa.float64())),
                             "high": pa.array([x.max(0)], pa.list_(pa.float64())), "weight": pa.array([sum(table.column("weight").to_pylist())], pa.int64())})

        return _cells(points.select("cell", "vec", "weight").groupBy("cell").applyInArrow(
            box, "cell int, low array<double>, high array<double>, weight long"), points, None)

    def boxes(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for block, group in pdf.groupby("block"):
            x = _matrix(group)
            parts.append((int(group["cell"].iloc[0]), int(block), x.min(0).tolist(), x.max(0).tolist(), int(group["weight"].sum())))
        return pd.DataFrame(parts, columns=["cell", "block", "low", "high", "weight"])

    blocks = cut_lineage(points.groupBy("cell").applyInPandas(boxes, "cell int, block int, low array<double>, high array<double>, weight long"))
    return _cells(blocks.groupBy("cell").applyInPandas(lambda g: pd.DataFrame({
        "cell": [int(g["cell"].iloc[0])], "low": [np.stack(g["low"].to_numpy()).min(0).tolist()],
        "high": [np.stack(g["high"].to_numpy()).max(0).tolist()], "weight": [int(g["weight"].sum())]}),
        "cell int, low array<double>, high array<double>, weight long"), points, blocks.drop("weight"))


def _cells(boxes: DataFrame, points: DataFrame, blocks: DataFrame | None) -> Cells:
    ends = sorted(boxes.collect(), key=lambda r: r["cell"])         # one row per cell
    width = len(ends[0]["low"]) if ends else 0
    return Cells(np.array([r["low"] for r in ends], dtype=float).reshape(-1, width), np.array([r["high"] for r in ends], dtype=float).reshape(-1, width),
                 np.array([r["weight"] for r in ends], dtype=np.int64), points, blocks)


def _box_column() -> Column:
    """Distance of ``vec`` from the box ``low``, ``high`` of its row."""
    outside = F.zip_with(F.zip_with("low", "vec", lambda a, v: a - v), F.zip_with("vec", "high", lambda v, b: v - b),
                         lambda a, b: F.greatest(a, b, F.lit(0.0)))
    return F.sqrt(F.aggregate(outside, F.lit(0.0), lambda acc, g: acc + g * g))


def visit(
    cells: Cells, visitors: DataFrame, kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str,
    *, data: DataFrame | None = None, block_rows: int = BLOCK_ROWS, first: int = 0, last: int | None = None,
) -> DataFrame:
    """Run ``kernel(visitors, data)`` on every block a visitor may have neighbours in.

    ``visitors`` has id, vec, weight and ``radius``; ``data`` defaults to all
    points.  Of the cells within its radius, nearest first, a row visits those
    from number ``first`` to before ``last``.
    """
    low, high = cells.low, cells.high
    data = cells.points if data is None else data

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def reachable(vec: pd.Series, radius: pd.Series) -> pd.Series:
        out, x, r = [], np.stack(vec.to_numpy()).astype(float), _wide(radius.to_numpy(dtype=float))
        step = max(1, _CHUNK // max(1, len(low)))
        for i in range(0, len(x), step):
            d = box_distance(x[i:i + step], low, high)
            order = np.argsort(d, axis=1, kind="stable")
            near = np.take_along_axis(d, order, 1) <= r[i:i + step, None]
            out += [o[n][first:last].astype("int32").tolist() for o, n in zip(order, near)]
        return pd.Series(out, dtype=object)

    asking = (
        visitors.select("id", "vec", "weight", "radius").withColumn("cell", F.explode(reachable("vec", "radius")))
        .join(cells.blocks, "cell").where(_box_column() <= F.col("radius") * (1 + 1e-9) + 1e-9).drop("low", "high")
    )
    # how many parts the visitors of a block are cut into
    parts = asking.groupBy("cell", "block").agg(F.ceil(F.count("*") / (4 * block_rows)).cast("int").alias("parts"))
    asking = asking.join(parts, ["cell", "block"]).withColumn(
        "part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts").withColumn("_asks", F.lit(True))
    held = data.join(parts, ["cell", "block"]).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts").withColumn("_asks", F.lit(False))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        asks = group["_asks"].to_numpy(dtype=bool)
        return kernel(group[asks], group[~asks])

    return asking.unionByName(held, allowMissingColumns=True).groupBy("cell", "block", "part").applyInPandas(run, schema)


def _matrix(rows: pd.DataFrame) -> np.ndarray:
    return np.stack(rows["vec"].to_numpy()).astype(float)


@dataclass
class Close:
    """Pairs of a visitor and a data row that are near enough, and how many pairs had to be measured for each visitor."""

    visitor: np.ndarray
    row: np.ndarray
    distance: np.ndarray
    measured: np.ndarray


def close_pairs(x: np.ndarray, y: np.ndarray, radius: np.ndarray) -> Close:
    """All pairs within the visitors' radius; only leaves whose box is within it are measured."""
    leaves = median_splits(y, LEAF)
    order = np.concatenate(leaves)
    size = np.array([len(g) for g in leaves])
    start = np.cumsum(size) - size
    sorted_ = y[order]
    low, high = np.minimum.reduceat(sorted_, start), np.maximum.reduceat(sorted_, start)
    found, measured = [], np.zeros(len(x), np.int64)
    step = max(1, _CHUNK // max(1, len(leaves)))
    for i in range(0, len(x), step):
        v, leaf = np.nonzero(box_distance(x[i:i + step], low, high) <= _wide(radius[i:i + step])[:, None])
        at = np.repeat(start[leaf] - np.cumsum(size[leaf]) + size[leaf], size[leaf]) + np.arange(size[leaf].sum())
        v = np.repeat(v, size[leaf]) + i
        measured += np.bincount(v, minlength=len(x))
        for j in range(0, len(v), max(1, _CHUNK // x.shape[1])):
            some = slice(j, j + max(1, _CHUNK // x.shape[1]))
            diff = x[v[some]] - sorted_[at[some]]
            d = np.sqrt(np.einsum("ij,ij->i", diff, diff))
            near = d <= radius[v[some]]
            found.append((v[some][near], order[at[some][near]], d[near]))
    if not found:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    return Close(*(np.concatenate(c) for c in zip(*found)), measured)


def _nearest(visitors: pd.DataFrame, data: pd.DataFrame, k: int) -> pd.DataFrame:
    """The nearest data rows of each visitor within its radius until their weights reach ``k``; its own copies count once less."""
    if not len(visitors) or not len(data):
        return pd.DataFrame({"id": pd.Series(dtype="int64"), "other": pd.Series(dtype="int64"), "distance": pd.Series(dtype=float),
                             "weight": pd.Series(dtype="int64")})
    me, ids = visitors["id"].to_numpy(dtype=np.int64), data["id"].to_numpy(dtype=np.int64)
    radius = visitors["radius"].to_numpy(dtype=float)
    found = close_pairs(_matrix(visitors), _matrix(data), np.where(np.isinf(radius), radius, _wide(radius)))
    v, other = found.visitor, ids[found.row]
    weight = data["weight"].to_numpy(dtype=np.int64)[found.row] - (other == me[v])
    order = np.lexsort((other, found.distance, v))
    order = order[weight[order] > 0]
    v, other, d, weight = v[order], other[order], found.distance[order], weight[order]
    before = np.cumsum(weight) - weight
    starts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)
    before -= np.repeat(before[starts], np.diff(np.append(starts, len(v)))) if len(v) else 0
    keep = before < k
    return pd.DataFrame({"id": me[v[keep]], "other": other[keep], "distance": d[keep], "weight": weight[keep]})


NEIGHBOR_SCHEMA = "id long, other long, distance double, weight long"


def _own_bound(k: int):
    """Distance within which each row of a block has ``k`` others: that of its group of a few times ``k`` neighbours in the splits."""
    def kernel(block: pd.DataFrame) -> pd.DataFrame:
        x, ids, weight = _matrix(block), block["id"].to_numpy(dtype=np.int64), block["weight"].to_numpy(dtype=np.int64)
        out = np.full(len(x), np.inf)
        for rows in median_splits(x, 4 * (k + 1)):
            d = exact_distances(x[rows], x[rows])
            order = np.argsort(d, axis=1)
            total = np.cumsum(weight[rows][order], axis=1)
            enough = total >= k + 1                     # the row itself is one
            at = enough.argmax(1)
            bound = np.take_along_axis(np.take_along_axis(d, order, 1), at[:, None], 1)[:, 0]
            out[rows] = np.where(enough.any(1), bound, np.inf)
        return pd.DataFrame({"id": ids, "radius": out})
    return kernel


def bounded_radius(cells: Cells, k: int) -> DataFrame:
    """The points with a ``radius`` that holds ``k`` other rows, or infinity if the table has not so many.

    Rows whose group is too small take the far corners of the nearest cells that have enough.
    """
    low, high, held = cells.low, cells.high, cells.weight

    @F.pandas_udf("double")
    def reach(vec: pd.Series) -> pd.Series:
        x = np.stack(vec.to_numpy()).astype(float)
        out = np.empty(len(x))
        for i, row in enumerate(x):
            far = _far_corner(row[None], low, high)[0]
            order = np.argsort(far)
            total = np.cumsum(held[order])
            out[i] = far[order[np.searchsorted(total, k + 1)]] if total[-1] > k else np.inf
        return pd.Series(out)

    own = cells.points.groupBy("cell", "block").applyInPandas(_own_bound(k), "id long, radius double")
    met = cut_lineage(cells.points.join(own, "id"))
    few = met.where(F.col("radius") == float("inf"))
    return met.where(F.col("radius") < float("inf")).unionByName(few.withColumn("radius", reach("vec")))


def _first_k(found: DataFrame, k: int) -> DataFrame:
    """Of (id, other, distance, weight) the nearest until weights reach ``k``; ranks are limited before and after the shuffle."""
    order = Window.partitionBy("id").orderBy("distance", "other")
    near = found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    before = F.coalesce(F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (near.withColumn("_before", before).where(F.col("_before") < k)
            .select("id", "other", "distance", F.least("weight", F.lit(k) - F.col("_before")).cast("long").alias("weight")))


def _products(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Single-precision factors a, b and numbers c: a row of x and one of y are within r only if ``a @ b.T >= c - r * r / 2``.

    Products of centred rows lose at most a share of their squared lengths, which is taken off the lengths before.
    """
    center = y.mean(0)
    x, y = x - center, y - center
    keep = 1 - 4 * (x.shape[1] + 8) * np.finfo(np.float32).eps
    x2, y2 = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
    a = np.concatenate([x, np.ones((len(x), 1))], axis=1).astype(np.float32)
    b = np.concatenate([y, (-keep / 2 * y2)[:, None]], axis=1).astype(np.float32)
    return a, b, keep / 2 * x2


class _Search:
    """The ``k`` nearest of all rows met so far for each row of a tile, for many columns: products bound the distances from below, pairs that
    may be near enough are measured.  A row's radius shrinks to its k-th neighbour whenever the pairs found since are merged."""

    def __init__(self, me: np.ndarray, x: np.ndarray, k: int):
        self.me, self.x, self.k, self.radius = me, x, k, np.full(len(x), np.inf)
        self.found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
        self.pending = 0

    def meet(self, ids: np.ndarray, weights: np.ndarray, y: np.ndarray) -> None:
        r = _wide(self.radius)
        rows = np.flatnonzero(box_distance(self.x, np.fmin.reduce(y)[None], np.fmax.reduce(y)[None])[:, 0] <= r)
        if not len(rows):
            return
        x, r = self.x[rows], r[rows]
        scale = max(np.abs(x).max(), np.abs(y).max()) or 1.0        # keeps squares finite in single precision
        a, b, c = _products(x / scale, y / scale)
        open_ = np.isinf(r).any() and len(y) > self.k
        step = max(1, _CHUNK // len(y))
        for i in range(0, len(x), step):
            some = slice(i, i + step)
            dot, reach = a[some] @ b.T, r[some]
            if open_:               # k rows besides its own are within the k + 1 largest products
                at = np.argpartition(dot, len(y) - self.k - 1, axis=1)[:, -self.k - 1:]
                far = np.array([np.sqrt(((y[o] - row) ** 2).sum(1).max()) for o, row in zip(at, x[some])])
                reach = np.minimum(reach, _wide(far))
            with np.errstate(over="ignore"):
                near = dot >= (c[some] - (reach / scale) ** 2 / 2 - 1e-35)[:, None].astype(np.float32)      # less what underflows
            v, o = np.divmod(np.flatnonzero(near), len(y))          # flat, as few are near: np.nonzero takes longer than the product
            for j in range(0, len(v), max(1, _CHUNK // x.shape[1])):
                part = slice(j, j + max(1, _CHUNK // x.shape[1]))
                diff = x[i + v[part]] - y[o[part]]
                d = np.sqrt(np.einsum("ij,ij->i", diff, diff))
                near = d <= reach[v[part]]
                at, row = o[part][near], rows[i + v[part][near]]
                self.found.append((row, ids[at], d[near], weights[at] - (ids[at] == self.me[row])))
                self.pending += len(row)
            if self.pending > 2 * self.k * len(self.x) + 4 * step * self.k:
                self.merge()
                r = np.minimum(r, _wide(self.radius[rows]))
        if self.pending >= self.k * len(self.x) // 2:
            self.merge()

    def merge(self) -> None:
        v, other, d, weight = (np.concatenate(p) for p in zip(*self.found))
        order = np.lexsort((other, d, v))
        order = order[weight[order] > 0]
        v, other, d, weight = v[order], other[order], d[order], weight[order]
        before = np.cumsum(weight) - weight
        before = before - before[np.searchsorted(v, v, side="left")]
        keep = before < self.k
        v, other, d, weight = v[keep], other[keep], d[keep], weight[keep]
        self.found, self.pending = [(v, other, d, np.minimum(weight, self.k - before[keep]))], 0
        held = np.bincount(v, self.found[0][3], len(self.x))
        farthest = np.zeros(len(self.x))
        farthest[v] = d             # the last one of a row is the farthest
        self.radius = np.where(held >= self.k, np.minimum(self.radius, farthest), self.radius)

    def nearest(self) -> pa.RecordBatch:
        self.merge()
        v, other, distance, weight = self.found[0]
        return pa.record_batch({"id": pa.array(self.me[v]), "other": pa.array(other), "distance": pa.array(distance), "weight": pa.array(weight.astype(np.int64))})


def _strips(table: pa.Table) -> pa.Table:
    """The rows of a tile as a row per strip."""
    x, ids, weight = _vectors(table), table.column("id").to_numpy(), table.column("weight").to_numpy()
    order = np.argsort(ids)
    parts = np.array_split(order, -(-len(order) // _STRIP))
    return pa.table({"tile": pa.array([table.column("tile")[0].as_py()] * len(parts), pa.int32()), "strip": pa.array(range(len(parts)), pa.int32()), **{
        name: pa.array([np.ascontiguousarray(c[p]).tobytes() for p in parts], pa.binary()) for name, c in (("ids", ids), ("weights", weight), ("rows", x))}})


def _nearest_in_tiles(cells: Cells, k: int) -> DataFrame:
    """k nearest rows by tiles of neighbouring cells: all strips of the table stream past each tile, its own first, then those of the nearest tiles."""
    counts = {r["cell"]: r["count"] for r in cells.points.groupBy("cell").count().collect()}     # one row per cell
    number = np.array([counts.get(c, 0) for c in range(len(cells.low))])
    rows = min(max(TILE_ROWS[0], -(-int(number.sum()) // TILES)), TILE_ROWS[1])
    tile = ((np.cumsum(number) - number) // rows).astype(int)
    tile = np.unique(tile, return_inverse=True)[1]
    tiles = int(tile.max(initial=0)) + 1
    strips = cut_lineage(cells.points.select("id", "vec", "weight", F.element_at(F.lit(tile.tolist()), F.col("cell") + 1).cast("int").alias("tile"))
                         .groupBy("tile").applyInArrow(_strips, "tile int, strip int, ids binary, weights binary, rows binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple[np.ndarray, ...]] = []
        asks = search = None
        for batch in batches:
            for one in batch.to_pylist():
                if one["asks"] != asks:
                    if own:
                        yield (search or _begin(own, k)).nearest()
                    asks, own, search = one["asks"], [], None
                ids = np.frombuffer(one["ids"], np.int64)
                strip = ids, np.frombuffer(one["weights"], np.int64), np.frombuffer(one["rows"]).reshape(len(ids), -1)
                if one["tile"] == asks:
                    own.append(strip)
                    continue
                search = search or _begin(own, k)
                search.meet(*strip)
        if own:
            yield (search or _begin(own, k)).nearest()

    asked = strips.withColumn("asks", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    return asked.repartitionById(tiles, F.col("asks")).sortWithinPartitions(
        "asks", F.abs(F.col("tile") - F.col("asks")), "tile", "strip").mapInArrow(run, NEIGHBOR_SCHEMA)


def _begin(own: Sequence[tuple[np.ndarray, ...]], k: int) -> _Search:
    ids, _, x = (np.concatenate(c) for c in zip(*own))
    search = _Search(ids, x, k)
    for strip in own:
        search.meet(*strip)
        search.merge()
    return search


def in_tiles(columns: int, nearest_blocks: int | None = None) -> bool:
    """Whether nearest neighbours are found by tiles, which need no boxes of blocks."""
    return columns > WIDE and nearest_blocks is None


def nearest_neighbors(cells: Cells, k: int, *, block_rows: int = BLOCK_ROWS, nearest_blocks: int | None = None) -> DataFrame:
    """k nearest rows of every distinct vector: ``id, other, distance, weight``.

    Exact, unless ``nearest_blocks`` limits the cells that a row visits to that many.
    """
    if in_tiles(cells.low.shape[1], nearest_blocks):
        return _nearest_in_tiles(cells, k)
    visitors = bounded_radius(cells, k)
    kernel = lambda v, d: _nearest(v, d, k)
    first = min(FIRST_BLOCKS, nearest_blocks or FIRST_BLOCKS)
    found = cut_lineage(_first_k(visit(cells, visitors, kernel, NEIGHBOR_SCHEMA, block_rows=block_rows, last=first), k))
    if len(cells.low) <= first or nearest_blocks == first:
        return found
    settled = found.groupBy("id").agg(F.max("distance").alias("_far"), F.sum("weight").alias("_got"))
    again = visitors.join(settled, "id", "left").withColumn(
        "radius", F.when(F.col("_got") >= k, F.least("radius", "_far")).otherwise(F.col("radius"))).drop("_far", "_got")
    rest = visit(cells, again, kernel, NEIGHBOR_SCHEMA, block_rows=block_rows, first=first, last=nearest_blocks)
    return _first_k(found.unionByName(rest), k)


def measured_pairs(cells: Cells, k: int, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``id``, ``n``: pairs whose distance the exact search makes for each row, by step."""
    def kernel(v: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        radius = v["radius"].to_numpy(dtype=float)
        n = close_pairs(_matrix(v), _matrix(d), radius).measured if len(v) and len(d) else np.zeros(len(v), np.int64)
        return pd.DataFrame({"id": v["id"].to_numpy(dtype=np.int64), "n": n})

    visitors = bounded_radius(cells, k)
    far = nearest_neighbors(cells, k, block_rows=block_rows, nearest_blocks=FIRST_BLOCKS).groupBy("id").agg(F.max("distance").alias("_far"), F.sum("weight").alias("_got"))
    again = visitors.join(far, "id", "left").withColumn("radius", F.when(F.col("_got") >= k, F.least("radius", "_far")).otherwise(F.col("radius")))
    own = cells.points.select("id", F.lit(4 * (k + 1)).cast("long").alias("n"))
    return own.unionByName(visit(cells, visitors, kernel, "id long, n long", block_rows=block_rows, last=FIRST_BLOCKS)).unionByName(
        visit(cells, again, kernel, "id long, n long", block_rows=block_rows, first=FIRST_BLOCKS)).groupBy("id").agg(F.sum("n").alias("n"))


def local_outlier_factor(cells: Cells, k: int = 20, *, block_rows: int = BLOCK_ROWS, nearest_blocks: int | None = None) -> DataFrame:
    """``id``, ``lof``: density of the neighbours over the row's own density."""
    near = cut_lineage(nearest_neighbors(cells, k, block_rows=block_rows, nearest_blocks=nearest_blocks))
    k_distance = near.groupBy("id").agg(F.max("distance").alias("k_distance"))
    reached = near.join(k_distance.withColumnRenamed("id", "other"), "other").withColumn(
        "reach", F.greatest("distance", "k_distance"))
    # Fixed value: 1e-10 keeps copies of one row finite.
    density = reached.groupBy("id").agg(
        (1 / (F.sum(F.col("reach") * F.col("weight")) / F.sum("weight") + 1e-10)).alias("lrd"))
    of_others = near.join(density.select(F.col("id").alias("other"), F.col("lrd").alias("_o")), "other")
    mean = of_others.groupBy("id").agg((F.sum(F.col("_o") * F.col("weight")) / F.sum("weight")).alias("_mean"))
    return mean.join(density, "id").select("id", (F.col("_mean") / F.col("lrd")).alias("lof"))


def _within(visitors: pd.DataFrame, data: pd.DataFrame, eps: float) -> Close:
    if not len(visitors) or not len(data):
        return Close(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(len(visitors), np.int64))
    return close_pairs(_matrix(visitors), _matrix(data), np.full(len(visitors), eps))


def _count_within(eps: float):
    def kernel(visitors: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        found = _within(visitors, data, eps)
        n = np.bincount(found.visitor, data["weight"].to_numpy(dtype=np.int64)[found.row], len(visitors))
        return pd.DataFrame({"id": visitors["id"].to_numpy(dtype=np.int64), "n": n.astype(np.int64)})
    return kernel


def _components(eps: float):
    """Connected parts of one block and its visitors: ``group`` (unique per block) and the core rows in it."""
    def kernel(visitors: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        found = _within(visitors, data, eps)
        if not len(found.visitor):
            return pd.DataFrame({"group": pd.Series(dtype=object), "id": pd.Series(dtype="int64")})
        v_ids, d_ids = visitors["id"].to_numpy(dtype=np.int64), data["id"].to_numpy(dtype=np.int64)
        ids, both = np.unique(np.concatenate([v_ids[found.visitor], d_ids[found.row]]), return_inverse=True)
        a, b = both[:len(found.visitor)], both[len(found.visitor):]
        label = np.arange(len(ids))
        while True:
            new = label.copy()
            np.minimum.at(new, a, label[b])
            np.minimum.at(new, b, label[a])
            np.minimum.at(new, label, new.copy())       # a hook for the whole part
            new = new[new]
            if (new == label).all():
                break
            label = new
        block = "-".join(str(data[c].iloc[0]) for c in ("cell", "block", "part"))
        return pd.DataFrame({"group": [f"{block}-{g}" for g in label], "id": ids})
    return kernel


def _lowest_number(eps: float):
    def kernel(visitors: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        found = _within(visitors, data, eps)
        lowest = np.full(len(visitors), np.iinfo(np.int64).max)
        np.minimum.at(lowest, found.visitor, data["label"].to_numpy(dtype=np.int64)[found.row] if len(found.row) else np.zeros(0, np.int64))
        some = lowest < np.iinfo(np.int64).max
        return pd.DataFrame({"id": visitors["id"].to_numpy(dtype=np.int64)[some], "label": lowest[some]})
    return kernel


def merge_groups(members: DataFrame, *, max_rounds: int = 100) -> DataFrame:
    """``id``, ``label`` from (group, id) memberships: lowest id of everything linked.

    In a round every label hooks onto the lowest label that any of its ids meets
    in a group; hooks are followed to their end before ids are relabelled, so at
    least half of the labels that still have a lower neighbour go.  Groups and
    the groups of one id are bounded by the blocks; labels shared by many ids are
    looked up by frequency.
    """
    links = cut_lineage(members)
    labels = cut_lineage(links.select("id").distinct().withColumn("label", F.col("id")))
    for _ in range(max_rounds):
        linked = links.join(labels, "id")
        by_group = linked.groupBy("group").agg(F.min("label").alias("_g"))
        hooks = cut_lineage(linked.join(by_group, "group").groupBy("label").agg(
            F.min("_g").alias("onto"), F.count("*").alias("_n")))
        if hooks.where(F.col("onto") < F.col("label")).isEmpty():
            return labels
        ends = _follow(hooks, max_rounds)
        labels = cut_lineage(lookup_by_frequency(labels, ends, ["label"], "_n").select("id", F.col("onto").alias("label")))
    raise RuntimeError(f"labels still move after {max_rounds} rounds")


def _follow(hooks: DataFrame, max_rounds: int) -> DataFrame:
    """Pointer jumping: every label straight onto the end of its chain of hooks."""
    for _ in range(max_rounds):
        ahead = hooks.select(F.col("label").alias("onto"), F.col("onto").alias("_next"))
        met = hooks.groupBy("onto").agg(F.count("*").alias("_m")).join(ahead, "onto")
        jumped = cut_lineage(lookup_by_frequency(hooks, met, ["onto"], "_m"))
        if jumped.where(F.col("_next") < F.col("onto")).isEmpty():
            return hooks
        hooks = jumped.select("label", F.col("_next").alias("onto"), "_n")
    raise RuntimeError(f"hooks still move after {max_rounds} rounds")


def dbscan(cells: Cells, eps: float = 0.5, min_samples: int = 10, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``id``, ``label`` (null for noise), ``is_core``.

    Clusters are numbered from 0 in the order of their least core vectors; a row
    that is near cores of several belongs to the first.
    """
    asking = cells.points.drop("block", "cell").withColumn("radius", F.lit(float(eps)))
    counts = visit(cells, asking, _count_within(eps), "id long, n long", block_rows=block_rows)
    core = counts.groupBy("id").agg((F.sum("n") >= min_samples).alias("is_core"))
    marked = cut_lineage(cells.points.join(core, "id"))
    core_points = marked.where("is_core").drop("is_core")
    members = visit(cells, core_points.drop("block", "cell").withColumn("radius", F.lit(float(eps))), _components(eps),
                    "group string, id long", data=core_points, block_rows=block_rows)
    linked = cut_lineage(core_points.join(merge_groups(members), "id"))
    least = linked.groupBy("label").agg(F.min("vec").alias("vec"), F.count("*").alias("_n"))
    numbered = cut_lineage(least.join(dense_number(least, "vec", "number"), "vec").select("label", "_n", F.col("number").cast("long").alias("number")))
    labelled = cut_lineage(lookup_by_frequency(linked, numbered, ["label"], "_n").drop("label").withColumnRenamed("number", "label"))
    border = visit(cells, marked.where(~F.col("is_core")).drop("is_core", "block", "cell").withColumn("radius", F.lit(float(eps))),
                   _lowest_number(eps), "id long, label long", data=labelled, block_rows=block_rows)
    border = border.groupBy("id").agg(F.min("label").alias("label"))
    known = labelled.select("id", "label").withColumn("is_core", F.lit(True)).unionByName(border.withColumn("is_core", F.lit(False)))
    return cells.points.select("id").join(known, "id", "left").select(
        "id", "label", F.coalesce("is_core", F.lit(False)).alias("is_core"))
