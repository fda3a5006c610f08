"""k-means for every number of clusters at once: each round is one scan, however many k there are.

Centres start from one farthest-first sequence: the row that is farthest from
the mean, then again and again the row that is farthest from all chosen ones.
Its first k members are the start for k clusters, so that nothing is drawn by
chance and all k share the same scans.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.functions.sums import held, matrices, pack, summed, summed_blocks
from dayloom.session import cut_lineage

MAX_ROUNDS = 100
#: A k is settled when no centre moves further than this share of the data's spread.
SETTLED = 1e-9


@dataclass
class Centers:
    """Centres by number of clusters, and the sum of squared distances to the nearest one."""

    centers: dict[int, np.ndarray]
    inertia: dict[int, float]
    rounds: int


def squared(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances, by differences: equal rows are at exactly 0 and ties are ties."""
    out = np.empty((len(x), len(centers)))
    for i, c in enumerate(centers):
        diff = x - c
        out[:, i] = np.einsum("ij,ij->i", diff, diff)
    return out


def nearest(x: np.ndarray, sets: Sequence[np.ndarray]) -> list[np.ndarray]:
    """``squared(x, c).argmin(1)`` for every set of centres: one product for all, and differences where it can not tell two centres apart."""
    every = np.concatenate(sets)
    middle = every.mean(0)
    z, e = x - middle, every - middle
    e2 = np.einsum("ij,ij->i", e, e)
    near = e2 - 2 * (z @ e.T)
    slack = 16 * (x.shape[1] + 8) * np.finfo(float).eps * (np.einsum("ij,ij->i", z, z) + e2.max())
    out, at = [], 0
    for c in sets:
        some = near[:, at:at + len(c)]
        at += len(c)
        own = some.argmin(1)
        least = some[np.arange(len(x)), own]
        alike = ~((some <= (least + slack)[:, None]).sum(1) == 1)
        if alike.any():
            own[alike] = squared(x[alike], c).argmin(1)
        out.append(own)
    return out


def farthest_first(rows: DataFrame, mean: np.ndarray, k: int) -> np.ndarray:
    """Up to ``k`` rows, each the farthest from those before it, the first from the mean; the least of equally far rows."""
    chosen: list[np.ndarray] = []
    schema = "d double, x array<double>"
    while len(chosen) < k:
        given = np.array(chosen) if chosen else mean[None]

        def far(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            best: tuple[float, list[float]] | None = None
            for batch in batches:
                for x in matrices(batch):
                    d = squared(x, given).min(1)
                    one = min(x[d == d.max()].tolist())
                    if best is None or (d.max(), [-v for v in one]) > (best[0], [-v for v in best[1]]):
                        best = (float(d.max()), one)
            if best is not None:
                yield pa.record_batch({"d": pa.array([best[0]]), "x": pa.array([best[1]], pa.list_(pa.float64()))})

        top = rows.mapInArrow(far, schema).orderBy(F.desc("d"), "x").limit(1).collect()
        if not top or chosen and top[0]["d"] == 0:
            break
        chosen.append(np.array(top[0]["x"]))
    return np.array(chosen) if chosen else np.zeros((0, len(mean)))


def fit_all(df: DataFrame, features: Sequence[str], ks: Sequence[int], *, rounds: int = MAX_ROUNDS) -> Centers:
    """Lloyd's rounds for all ``ks`` over rows that have all features.

    A centre without rows stays where it is.  ks above the number of different rows are left out.
    """
    rows = cut_lineage(pack(df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(features)]).na.drop()))
    d = len(features)
    with held(rows) as blocks:
        first = summed_blocks(blocks, lambda x: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]), 2 * d + 1)
        n = max(first[0], 1.0)
        mean = first[1:d + 1] / n
        spread = float(np.sqrt(max((first[d + 1:] / n - mean**2).sum(), 0.0))) or 1.0
        start = farthest_first(rows, mean, max(ks, default=0))
        centers = {k: start[:k].copy() for k in sorted(set(ks)) if 0 < k <= len(start)}
        moving, done = set(centers), 0
        for done in range(1, rounds + 1):
            now = {k: centers[k] for k in sorted(moving)}
            size = [k * (d + 1) for k in now]

            def step(x: np.ndarray, now=now) -> np.ndarray:
                owned = [own[:, None] == np.arange(k) for k, own in zip(now, nearest(x, list(now.values())))]
                return (np.concatenate(owned, axis=1).T.astype(float) @ np.concatenate([np.ones((len(x), 1)), x], axis=1)).ravel()

            if not moving:
                break
            for (k, old), table in zip(now.items(), np.split(summed_blocks(blocks, step, sum(size)), np.cumsum(size)[:-1])):
                table = table.reshape(k, d + 1)
                new = np.where(table[:, :1] > 0, table[:, 1:] / np.maximum(table[:, :1], 1.0), old)
                centers[k] = new
                if np.sqrt(((new - old) ** 2).sum(1)).max() <= SETTLED * spread:
                    moving.discard(k)
        found = list(centers)
        total = summed_blocks(blocks, lambda x: np.array([squared(x, centers[k]).min(1).sum() for k in found]), len(found)) if found else []
    return Centers(centers, dict(zip(found, map(float, total))), done)


def assigned(df: DataFrame, features: Sequence[str], centers: np.ndarray, out: str = "cluster") -> DataFrame:
    """The number of the nearest centre of each row, the first of equally near ones; null where a feature is missing."""
    @F.pandas_udf("int")
    def nearest(*columns: pd.Series) -> pd.Series:
        x = np.stack([c.to_numpy(dtype=float) for c in columns], axis=1)
        number = pd.Series(squared(x, centers).argmin(1), dtype="Int32")
        return number.mask(np.isnan(x).any(1))

    return df.withColumn(out, nearest(*[F.col(c).cast("double") for c in features]))


def qualities(df: DataFrame, features: Sequence[str], centers: dict[int, np.ndarray]) -> list[tuple]:
    """(k, silhouette, Calinski-Harabasz, Davies-Bouldin) of every k: two scans for all of them.

    The silhouette is that of squared distances, which needs sizes, centres and
    spreads of the clusters only.  Centres must be the means of their clusters.
    """
    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(features)]).na.drop()
    ks = list(centers)
    size = [3 * k for k in ks]

    def spreads(x: np.ndarray) -> np.ndarray:
        parts = []
        for k in ks:
            d = squared(x, centers[k])
            own = d.argmin(1)
            least = d[np.arange(len(x)), own]
            parts.append(np.concatenate([np.bincount(own, minlength=k), np.bincount(own, least, k), np.bincount(own, np.sqrt(least), k)]))
        return np.concatenate(parts)

    tables = {k: t.reshape(3, k) for k, t in zip(ks, np.split(summed(rows, spreads, sum(size)), np.cumsum(size)[:-1]))} if ks else {}

    def silhouettes(x: np.ndarray) -> np.ndarray:
        out = []
        for k in ks:
            n, ss, _ = tables[k]
            some = n > 0
            d = squared(x, centers[k])
            own = d.argmin(1)
            mean = np.where(some, d + np.where(some, ss / np.maximum(n, 1.0), 0.0), np.inf)
            at = np.arange(len(x))
            a = mean[at, own] * n[own] / np.maximum(n[own] - 1, 1.0)
            mean[at, own] = np.inf
            b = mean.min(1)
            top = np.maximum(a, b)
            out.append(np.where((n[own] > 1) & (top > 0) & np.isfinite(b), (b - a) / np.where(top > 0, top, 1.0), 0.0).sum())
        return np.array(out)

    total = summed(rows, silhouettes, len(ks)) if ks else []
    out = []
    for k, s in zip(ks, total):
        (n, ss, far), c = tables[k], centers[k]
        some = n > 0
        n, ss, far, c = n[some], ss[some], far[some] / n[some], c[some]
        rows_n, clusters = n.sum(), len(n)
        if clusters < 2:
            out.append((k, -1.0, -1.0, -1.0))
            continue
        overall = (n[:, None] * c).sum(0) / rows_n
        between = float((n * ((c - overall) ** 2).sum(1)).sum())
        apart = np.sqrt(((c[:, None] - c[None]) ** 2).sum(-1))
        ratio = np.where(apart > 0, (far[:, None] + far[None]) / np.where(apart > 0, apart, 1.0), -np.inf)
        calinski = between * (rows_n - clusters) / (ss.sum() * (clusters - 1)) if ss.sum() > 0 else 1.0
        out.append((k, float(s / rows_n), float(calinski), float(ratio.max(1).mean())))
    return out
