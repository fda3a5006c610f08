"""Linear, ridge, lasso and elastic-net models of every expanding fold from one scan of second moments.

A row enters as (1, u, v, y): u are the centred features with 0 where one is
missing, v marks the missing ones.  Filling gaps with any value m is then a
linear map, u + (m - centre) v, so the moments of all rows of a fold, summed
once, give the normal equations of every model on every prefix of folds for
whatever fills the prefix has, and the squared error of it on any other fold.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.functions.quantiles import quantiles


@dataclass(frozen=True)
class Penalty:
    """Half the mean squared error + ``reg`` * (l1 * sum |w| + (1 - l1) / 2 * sum w^2); ``per_row``: ``reg`` is on the sum of squares."""

    reg: float = 0.0
    l1: float = 0.0
    per_row: bool = False

    def weight(self, n: float) -> float:
        return self.reg / max(n, 1.0) if self.per_row else self.reg


# The four penalties.
PENALTIES: Mapping[str, Penalty] = {
    "linear": Penalty(), "ridge": Penalty(1.0, per_row=True), "lasso": Penalty(0.1, 1.0), "elastic_net": Penalty(0.1, 0.5)}


def fold_moments(rows: DataFrame, features: Sequence[str], target: str, group: str) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """Sums of products of (1, u, v, y) for each value of ``group``, and the centres of features and target.

    Two scans: one for the centres, one in which each task adds up one matrix per
    group.  A matrix has (2 d + 2)^2 numbers, whatever the number of rows.
    """
    d = len(features)
    numbers = rows.select(F.col(group).cast("int").alias("g"), *(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate([*features, target])))
    numbers = numbers.where(F.col(f"c{d}").isNotNull() & F.col("g").isNotNull())
    centers = np.array([m or 0.0 for m in numbers.agg(*[F.avg(f"c{i}") for i in range(d + 1)]).first()])
    width = 2 * d + 2
    upper = np.triu_indices(width)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1).astype(float) - centers
            gone = np.isnan(x[:, :d])
            z = np.concatenate([np.ones((len(x), 1)), np.where(gone, 0.0, x[:, :d]), gone, x[:, d:]], axis=1)
            g = batch.column(0).to_numpy()
            for one in np.unique(g):
                part = z[g == one]
                total[int(one)] = total.get(int(one), 0.0) + part.T @ part
        for one, matrix in total.items():
            values = matrix[upper]
            yield pa.record_batch({"g": pa.array(np.full(len(values), one, np.int32)), "at": pa.array(np.arange(len(values), dtype=np.int32)),
                                   "s": pa.array(values)})

    found = numbers.mapInArrow(sums, "g int, at int, s double").groupBy("g", "at").agg(F.sum("s").alias("s")).collect()
    out: dict[int, np.ndarray] = {}
    for r in found:
        matrix = out.setdefault(r["g"], np.zeros((width, width)))
        matrix[upper[0][r["at"]], upper[1][r["at"]]] = matrix[upper[1][r["at"]], upper[0][r["at"]]] = r["s"]
    return out, centers


@dataclass
class Fitted:
    """y = intercept + sum of weights * filled features."""

    fills: np.ndarray
    weights: np.ndarray
    intercept: float
    standard: np.ndarray        # weights of standardised features

    def error(self, moments: np.ndarray, centers: np.ndarray) -> tuple[float, float]:
        """Sum of squared errors and sum of squares around the mean, over the rows that ``moments`` sums up."""
        d = len(self.weights)
        n = moments[0, 0]
        if not n:
            return 0.0, 0.0
        q = np.concatenate([[centers[d] - self.intercept - self.weights @ centers[:d]], -self.weights,
                            -self.weights * (self.fills - centers[:d]), [1.0]])
        return float(max(q @ moments @ q, 0.0)), float(max(moments[-1, -1] - moments[0, -1]**2 / n, 0.0))


def solve(a: np.ndarray, b: np.ndarray, reg: float, l1: float, *, sweeps: int = 20_000, tol: float = 1e-12) -> np.ndarray:
    """Weights that minimise w'Aw / 2 - b'w + penalty: closed form without l1, else cyclic coordinate descent."""
    if not reg or not l1:
        return np.linalg.lstsq(a + reg * np.eye(len(a)), b, rcond=1e-12)[0] if len(a) else np.zeros(0)
    w, gradient = np.zeros(len(b)), b.copy()        # b - A w
    scale = np.diag(a) + reg * (1 - l1)
    for _ in range(sweeps):
        moved = 0.0
        for j in range(len(b)):
            if scale[j] <= 0:
                continue
            free = gradient[j] + a[j, j] * w[j]
            new = np.sign(free) * max(abs(free) - reg * l1, 0.0) / scale[j]
            if new != w[j]:
                gradient -= a[:, j] * (new - w[j])
                moved = max(moved, abs(new - w[j]))
                w[j] = new
        if moved <= tol * max(1.0, np.abs(w).max()):
            break
    return w


def fit(moments: np.ndarray, centers: np.ndarray, fills: np.ndarray, penalty: Penalty) -> Fitted:
    """Model of the rows that ``moments`` sums up, on filled and standardised features."""
    d = len(fills)
    n = moments[0, 0]
    to = np.zeros((d + 2, 2 * d + 2))
    to[0, 0] = to[-1, -1] = 1.0
    for j in range(d):
        to[j + 1, j + 1], to[j + 1, d + j + 1] = 1.0, fills[j] - centers[j]
    m = to @ moments @ to.T
    mean = m[0] / max(n, 1.0)
    co = m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) / max(n, 1.0)
    raw = np.diag(m)[1:-1]
    var = np.where(np.diag(co)[:-1] > 1e-12 * np.maximum(raw, 1e-300), np.diag(co)[:-1], 0.0)     # what rounding leaves of a constant is none
    std = np.sqrt(var / max(n - 1.0, 1.0))
    used = std > 0
    a = co[:-1, :-1][np.ix_(used, used)] / np.outer(std[used], std[used]) / max(n, 1.0)
    b = co[:-1, -1][used] / std[used] / max(n, 1.0)
    standard = np.zeros(d)
    standard[used] = solve(a, b, penalty.weight(n), penalty.l1)
    weights = np.where(used, standard / np.where(used, std, 1.0), 0.0)
    intercept = mean[-1] + centers[d] - weights @ (mean[1:-1] + centers[:d])
    return Fitted(fills, weights, float(intercept), standard)


def prefix_fills(rows: DataFrame, features: Sequence[str], group: str, last: int, how: str) -> dict[int, np.ndarray]:
    """Median or mean of each feature over the groups before 1, 2, ... ``last`` + 1; 0 where a feature has no value.

    Groups below 0 take no part.  A row counts in every prefix that it belongs to; one run of the quantile passes serves all.
    """
    long = rows.where(F.col(group) >= 0).select(F.explode(F.sequence(F.col(group).cast("int") + 1, F.lit(last + 1))).alias("upto"), F.posexplode(
        F.array(*[F.col(c).cast("double") for c in features])).alias("column", "value")).where("value is not null")
    found = (quantiles(long, ["upto", "column"], "value", [0.5], few_groups=True).select("upto", "column", F.col("q")[0].alias("v")) if how == "median"
             else long.groupBy("upto", "column").agg(F.avg("value").alias("v"))).collect()      # prefixes x features
    out = {p: np.zeros(len(features)) for p in range(1, last + 2)}
    for r in found:
        out[r["upto"]][r["column"]] = r["v"]
    return out


def expanding_models(rows: DataFrame, features: Sequence[str], target: str, names: Sequence[str], *, folds: int = 5,
                     group: str = "fold", impute: str | None = "median") -> tuple[list[tuple], dict[str, Fitted]]:
    """Result rows of the linear models and the models of all training rows.

    ``group`` numbers the training folds from 0; -1 are the test rows.  A result
    row is (name, train mse, mae, r2, test mse, rmse, mae, r2, cv mse, cv deviation),
    as in ``train_models``.  Absolute errors take one further scan for all models.
    """
    moments, centers = fold_moments(rows, features, target, group)
    fills = prefix_fills(rows, features, group, folds, impute) if impute else {p: np.zeros(len(features)) for p in range(1, folds + 2)}
    zero = np.zeros((2 * len(features) + 2,) * 2)
    upto = {p: sum((moments.get(f, zero) for f in range(p)), zero) for p in range(1, folds + 2)}
    whole = {name: fit(upto[folds + 1], centers, fills[folds + 1], PENALTIES[name]) for name in names}

    def filled(j: int, c: str):
        value = F.col(c).cast("double")
        return F.coalesce(value, F.lit(float(fills[folds + 1][j])))

    errors = [F.avg(F.when(where, F.abs(F.col(target) - F.lit(m.intercept) - sum(
        (filled(j, c) * F.lit(float(m.weights[j])) for j, c in enumerate(features)), F.lit(0.0)))))
        for m in whole.values() for where in (F.col(group) >= 0, F.col(group) < 0)]
    mae = rows.agg(*[e.alias(f"e{i}") for i, e in enumerate(errors)]).first()

    def mse(model: Fitted, part: np.ndarray) -> tuple[float, float]:
        n = part[0, 0]
        if not n:
            return float("nan"), float("nan")
        squared, around = model.error(part, centers)
        r2 = 1 - squared / around if around > 0 else (1.0 if squared == 0 else 0.0)
        return squared / n, r2

    out = []
    for i, (name, model) in enumerate(whole.items()):
        (train, train_r2), (test, test_r2) = mse(model, upto[folds + 1]), mse(model, moments.get(-1, zero))
        losses = [mse(fit(upto[p], centers, fills[p], PENALTIES[name]), moments.get(p, zero))[0] for p in range(1, folds + 1)]
        numbers = (train, mae[2 * i], train_r2, test, test ** 0.5, mae[2 * i + 1], test_r2, np.mean(losses), np.std(losses))
        out.append((name, *(float("nan") if v is None else float(v) for v in numbers)))
    return out, whole
