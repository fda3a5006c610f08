"""Gaussian mixtures by expectation-maximisation over merged moments.

A round is one scan: each task adds up responsibilities, responsibility-weighted
rows and their products as arrays, and the sums of all tasks give the next
means and covariances, of whichever of the four types.  Nothing is drawn by
chance: rounds start from the clusters of k-means.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.functions.sums import summed
from dayloom.operators import lloyd
from dayloom.session import cut_lineage

TYPES = ("full", "tied", "diag", "spherical")
# Fixed value: 1e-6 keeps covariances positive.
RIDGE = 1e-6


@dataclass
class Mixture:
    """Parts of ``kind`` with a mean and a covariance each (tied: the same one)."""

    kind: str
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray     # parts x d x d
    log_likelihood: float = float("nan")
    rounds: int = 0
    rows: float = 0.0

    @property
    def free(self) -> int:
        """Number of free parameters."""
        k, d = self.means.shape
        spread = {"full": k * d * (d + 1) // 2, "tied": d * (d + 1) // 2, "diag": k * d, "spherical": k}[self.kind]
        return k * d + spread + k - 1

    @property
    def bic(self) -> float:
        return -2 * self.log_likelihood + self.free * np.log(max(self.rows, 1.0))

    def log_density(self, x: np.ndarray) -> np.ndarray:
        """Log of weight times density, rows x parts."""
        out = np.empty((len(x), len(self.weights)))
        for i, (w, m, c) in enumerate(zip(self.weights, self.means, self.covariances)):
            root = np.linalg.cholesky(c)
            z = np.linalg.solve(root, (x - m).T)
            out[:, i] = (np.log(max(w, 1e-300)) - 0.5 * (z * z).sum(0) - np.log(np.diag(root)).sum() - 0.5 * len(m) * np.log(2 * np.pi))
        return out


def _moments(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Sums of responsibilities, of weighted rows and of weighted products."""
    return np.concatenate([r.sum(0), (r.T @ x).ravel(), *[((x * r[:, [i]]).T @ x).ravel() for i in range(r.shape[1])]])


def _likelihood(log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = log.max(1, keepdims=True)
    whole = top[:, 0] + np.log(np.exp(log - top).sum(1))
    return whole, np.exp(log - whole[:, None])


def from_moments(sums: np.ndarray, k: int, d: int, kind: str, ridge: float = RIDGE) -> Mixture:
    """The maximisation step: weights, means and covariances of a type from the sums of :func:`_moments`."""
    n, first, second = sums[:k], sums[k:k + k * d].reshape(k, d), sums[k + k * d:].reshape(k, d, d)
    some = np.maximum(n, 1e-300)
    means = first / some[:, None]
    scatter = second - some[:, None, None] * means[:, :, None] * means[:, None, :]
    own = scatter / some[:, None, None]
    if kind == "tied":
        own = np.broadcast_to(scatter.sum(0) / max(n.sum(), 1e-300), own.shape)
    elif kind == "diag":
        own = own * np.eye(d)
    elif kind == "spherical":
        own = np.einsum("kii->k", own)[:, None, None] / d * np.eye(d)
    elif kind != "full":
        raise ValueError(f"covariance type must be one of {TYPES}, not {kind!r}")
    return Mixture(kind, n / max(n.sum(), 1e-300), means, own + ridge * np.eye(d), rows=float(n.sum()))


def fit_mixtures(df: DataFrame, features: Sequence[str], k: int = 3, kinds: Sequence[str] = TYPES, *, rounds: int = 100,
                 tol: float = 1e-3) -> dict[str, Mixture]:
    """Mixtures of all ``kinds`` at once: each round is one scan for those that still move.

    A type is settled when the mean log-likelihood of a row grows by less than
    ``tol``.  Rows with a missing feature take no part.
    """
    rows = cut_lineage(df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(features)]).na.drop())
    d = len(features)
    start = lloyd.fit_all(df, features, [k]).centers
    if k not in start:
        raise ValueError(f"fewer than {k} different rows")
    center = start[k].mean(0)       # sums of products stay small around it
    width = k + k * d + k * d * d

    def hard(x: np.ndarray) -> np.ndarray:
        return _moments(x - center, np.eye(k)[lloyd.squared(x, start[k]).argmin(1)])

    sums = summed(rows, hard, width)
    now = {kind: from_moments(sums, k, d, kind) for kind in kinds}
    moving = list(kinds)
    for turn in range(1, rounds + 1):
        models = [now[kind] for kind in moving]

        def step(x: np.ndarray, models=models) -> np.ndarray:
            parts = []
            for model in models:
                whole, r = _likelihood(model.log_density(x - center))
                parts.append(np.concatenate([[whole.sum()], _moments(x - center, r)]))
            return np.concatenate(parts)

        for kind, part in zip(list(moving), summed(rows, step, len(models) * (width + 1)).reshape(len(models), -1)):
            before, model = now[kind].log_likelihood, now[kind]
            model.log_likelihood, model.rounds = float(part[0]), turn
            if np.isfinite(before) and (part[0] - before) / max(model.rows, 1.0) < tol or turn == rounds:
                moving.remove(kind)
            else:
                now[kind] = from_moments(part[1:], k, d, kind)
                now[kind].log_likelihood = float(part[0])
        if not moving:
            break
    for model in now.values():
        model.means = model.means + center
    return now


def assigned(df: DataFrame, features: Sequence[str], model: Mixture, out: str = "cluster") -> DataFrame:
    """The likeliest part of each row; null where a feature is missing."""
    @F.pandas_udf("int")
    def likeliest(*columns: pd.Series) -> pd.Series:
        x = np.stack([c.to_numpy(dtype=float) for c in columns], axis=1)
        gone = np.isnan(x).any(1)
        number = pd.Series(model.log_density(np.where(gone[:, None], 0.0, x)).argmax(1), dtype="Int32")
        return number.mask(gone)

    return df.withColumn(out, likeliest(*[F.col(c).cast("double") for c in features]))


def mixture_of_labels(df: DataFrame, features: Sequence[str], label: str | Column, k: int, kinds: Sequence[str] = TYPES) -> DataFrame:
    """``kind, part, i, j, covariance``: covariances of each type for given parts 0 to k - 1, from one scan of their moments."""
    given = F.col(label) if isinstance(label, str) else label
    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(features)], given.cast("double").alias("label")).na.drop()
    d = len(features)
    sums = summed(rows, lambda x: _moments(x[:, :d], np.eye(k)[x[:, d].astype(int)]), k + k * d + k * d * d)
    table = []
    for kind in kinds:
        model = from_moments(sums, k, d, kind, 0.0)
        table += [(kind, p, i, j, float(model.covariances[p, i, j])) for p in range(k) for i in range(d) for j in range(d)]
    return df.sparkSession.createDataFrame(table, "kind string, part int, i int, j int, covariance double")


def compare_mixtures(df: DataFrame, features: Sequence[str], ks: Sequence[int], kinds: Sequence[str] = TYPES, *, rounds: int = 100) -> DataFrame:
    """The grid of numbers of parts and types: ``k, kind, log_likelihood, bic, rounds, best`` (least BIC)."""
    table = []
    for k in ks:
        for kind, m in fit_mixtures(df, features, k, kinds, rounds=rounds).items():
            table.append((int(k), kind, m.log_likelihood, float(m.bic), m.rounds))
    best = min((r[3] for r in table), default=None)
    return df.sparkSession.createDataFrame([(*r, r[3] == best) for r in table], "k int, kind string, log_likelihood double, bic double, rounds int, best boolean")
