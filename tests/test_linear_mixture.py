"""Linear models from moments, k-means for all k, mixtures and node tables against numpy."""

import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dayloom.functions import sums
from dayloom.operators import anomaly, clustering, linear, lloyd, mixture, prediction

ABC = ["a", "b", "c"]


@pytest.fixture(scope="module")
def days():
    rng = np.random.default_rng(8)
    n = 600
    x = rng.normal(size=(n, 3)) * [1, 40, 0.01] + [5, 8000, 0.2]
    y = 3 * x[:, 0] - 0.01 * x[:, 1] + rng.normal(size=n)
    out = pd.DataFrame(x, columns=ABC)
    out.loc[rng.random(n) < 0.15, "a"] = np.nan
    out.loc[rng.random(n) < 0.05, "b"] = np.nan
    out["score"], out["subject"] = y, np.arange(n) % 4
    out["day"] = (pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n) // 4, unit="D")).date
    return out


def descend(a, b, reg, l1):
    w = np.zeros(len(b))
    for _ in range(5000):
        for j in range(len(b)):
            free = b[j] - a[j] @ w + a[j, j] * w[j]
            w[j] = np.sign(free) * max(abs(free) - reg * l1, 0) / (a[j, j] + reg * (1 - l1))
    return w


def plain_models(pdf, name):
    """Result row of one model, refitted from the rows of each prefix."""
    penalty = linear.PENALTIES[name]
    folds = []
    for _, g in pdf.sort_values("day").groupby("subject"):
        cut = int(np.floor(len(g) * 0.8))
        size = cut // 6
        folds.append(pd.Series([max(0, 5 - (cut - 1 - i) // size) if i < cut else -1 for i in range(len(g))], index=g.index))
    fold = pd.concat(folds).reindex(pdf.index).to_numpy()

    def model(rows):
        fill = pdf.loc[rows, ABC].median()
        x = pdf[ABC].fillna(fill).to_numpy()
        mean, std = x[rows].mean(0), x[rows].std(0, ddof=1)
        z, y = (x - mean) / std, pdf["score"].to_numpy()
        zt, yt = z[rows], y[rows] - y[rows].mean()
        w = descend(zt.T @ zt / rows.sum(), zt.T @ yt / rows.sum(), penalty.weight(rows.sum()), penalty.l1)
        return y - y[rows].mean() - z @ w

    error = model(fold >= 0)
    cv = [np.mean(model((fold >= 0) & (fold < f))[fold == f] ** 2) for f in range(1, 6)]
    y = pdf["score"].to_numpy()
    train, test = fold >= 0, fold < 0
    mse = lambda m: np.mean(error[m] ** 2)
    return [mse(train), np.abs(error[train]).mean(), 1 - mse(train) / y[train].var(), mse(test), mse(test) ** 0.5, np.abs(error[test]).mean(),
            1 - mse(test) / y[test].var(), np.mean(cv), np.std(cv)]


def test_linear_models_equal_fits_on_rows(spark, days):
    results, importance = prediction.train_models(spark.createDataFrame(days), ABC, models=prediction.LINEAR_MODELS, subject_cols=("subject",))
    rows = {r.model: r for r in results.collect()}
    for name in prediction.LINEAR_MODELS:
        np.testing.assert_allclose([rows[name][i] for i in range(1, 10)], plain_models(days, name), rtol=1e-6, err_msg=name)
    assert sum(r.best for r in rows.values()) == 1
    top = {r.feature for r in importance.where("model = 'lasso' and importance > 0.1").collect()}
    assert top == {"a", "b"}


def test_linear_models_need_few_jobs(spark, days):
    df = spark.createDataFrame(days)
    group = "linear-jobs"
    spark.sparkContext.setJobGroup(group, group)
    try:
        prediction.train_models(df, ABC, models=prediction.LINEAR_MODELS, subject_cols=("subject",))
    finally:
        spark.sparkContext.setJobGroup("", "")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) < 40


def test_odd_columns_and_empty_tables(spark, days):
    odd = days.assign(a=7.0, b=np.nan)
    results, _ = prediction.train_models(spark.createDataFrame(odd.astype({"b": float})), ABC, models=("linear", "lasso"), subject_cols=("subject",))
    assert all(np.isfinite(r.train_mse) for r in results.collect())
    with pytest.raises(ValueError, match="no models"):
        prediction.train_models(spark.createDataFrame(days), ABC, models=("other",))


def plain_lloyd(x, k):
    chosen = [x[((x - x.mean(0)) ** 2).sum(1).argmax()]]
    while len(chosen) < k:
        chosen.append(x[((x[:, None] - np.array(chosen)) ** 2).sum(-1).min(1).argmax()])
    c = np.array(chosen)
    for _ in range(200):
        own = ((x[:, None] - c) ** 2).sum(-1).argmin(1)
        c = np.array([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(k)])
    return c, ((x[:, None] - c) ** 2).sum(-1).min(1).sum()


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(3)
    return np.concatenate([rng.normal([0, 0, 5], 1, (200, 3)), rng.normal([6, 0, 0], [2, 1, 1], (150, 3)), rng.normal([0, 7, 0], [1, 2, 0.5], (100, 3))])


def test_all_k_at_once(spark, cloud):
    df = spark.createDataFrame(pd.DataFrame(cloud, columns=ABC))
    model = lloyd.fit_all(df, ABC, range(2, 7))
    for k in range(2, 7):
        centers, inertia = plain_lloyd(cloud, k)
        np.testing.assert_allclose(model.centers[k], centers, rtol=1e-9)
        assert model.inertia[k] == pytest.approx(inertia)
    by_ml = clustering.clustering_quality(clustering.kmeans(df, ABC, 3)).first()
    by_moments = next(q for q in lloyd.qualities(df, ABC, model.centers) if q[0] == 3)
    np.testing.assert_allclose(by_moments[1:], [by_ml.silhouette, by_ml.calinski_harabasz, by_ml.davies_bouldin], rtol=1e-9)
    assert {r.k for r in clustering.choose_k(df, ABC, max_k=5).where("array_contains(chosen_by, 'silhouette')").collect()} == {3}


def test_few_different_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0), (3.0, 1.0), (None, 1.0)], "a double, b double")
    assert sorted(lloyd.fit_all(df, ["a", "b"], [2, 3]).centers) == [2]
    with pytest.raises(ValueError):
        clustering.kmeans(df.na.drop(), ["a", "b"], 3)
    none = df.limit(0)
    assert lloyd.fit_all(none, ["a", "b"], [2]).centers == {} and clustering.choose_k(none, ["a", "b"]).count() == 0


def plain_mixture(x, k, kind, rounds):
    centers, _ = plain_lloyd(x, k)
    r = np.eye(k)[((x[:, None] - centers) ** 2).sum(-1).argmin(1)]
    d = x.shape[1]
    for _ in range(rounds):
        n = r.sum(0)
        means = r.T @ x / n[:, None]
        covs = np.array([((x - m) * r[:, [j]]).T @ (x - m) / n[j] for j, m in enumerate(means)])
        if kind == "tied":
            covs = np.array([(covs * n[:, None, None]).sum(0) / n.sum()] * k)
        if kind in ("diag", "spherical"):
            covs = np.array([np.diag(np.diag(c)) if kind == "diag" else np.eye(d) * np.trace(c) / d for c in covs])
        covs = covs + 1e-6 * np.eye(d)
        log = np.stack([np.log(n[j] / n.sum()) - 0.5 * np.einsum("ij,jk,ik->i", x - means[j], np.linalg.inv(covs[j]), x - means[j])
                        - 0.5 * np.linalg.slogdet(2 * np.pi * covs[j])[1] for j in range(k)], axis=1)
        whole = np.logaddexp.reduce(log, axis=1)
        r = np.exp(log - whole[:, None])
    return means, covs, whole.sum()


@pytest.mark.parametrize("kind", mixture.TYPES)
def test_mixture_equals_plain_rounds(spark, cloud, kind):
    df = spark.createDataFrame(pd.DataFrame(cloud, columns=ABC))
    model = mixture.fit_mixtures(df, ABC, 3, [kind], rounds=8, tol=0.0)[kind]
    means, covs, likelihood = plain_mixture(cloud, 3, kind, 8)
    np.testing.assert_allclose(model.means, means, rtol=1e-6, atol=1e-8)
    np.testing.assert_allclose(model.covariances, covs, rtol=1e-5, atol=1e-7)
    assert model.log_likelihood == pytest.approx(likelihood) and model.rounds == 8
    with pytest.raises(ValueError):
        mixture.from_moments(np.zeros(39), 3, 3, "other")


def test_mixture_grid(spark, cloud):
    df = spark.createDataFrame(pd.DataFrame(cloud, columns=ABC))
    grid = mixture.compare_mixtures(df, ABC, (2, 3), rounds=20).collect()
    assert len(grid) == 8 and sum(r.best for r in grid) == 1 and next(r.k for r in grid if r.best) == 3


def test_nodes_give_the_predictions_and_importances(spark, days):
    rows = spark.createDataFrame(days.fillna(0.0))
    for build in (prediction.random_forest("score", trees=4, depth=20, min_rows=1), prediction.gradient_boosting("score", rounds=4, depth=6)):
        fitted = prediction.pipeline(ABC, build, scale="standard").fit(rows)
        out = fitted.transform(rows).select("features", "prediction").toPandas()
        nodes = prediction.tree_nodes(fitted.stages[-1], tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/model")
        x, total = np.stack([v.toArray() for v in out["features"]]), np.zeros(len(out))
        for _, g in nodes.toPandas().groupby("tree"):
            table = {r.node: r for r in g.itertuples()}
            for i, row in enumerate(x):
                at = table[0]
                while at.feature >= 0:
                    at = table[at.left if row[at.feature] <= at.cut else at.right]
                total[i] += at.prediction * at.weight
        forest = "Forest" in type(fitted.stages[-1]).__name__
        if forest:
            total /= 4
        np.testing.assert_allclose(total, out["prediction"], rtol=1e-9)
        own = {r.feature: r.importance for r in prediction.importance_of_nodes(nodes, ABC, per_tree=forest).collect()}
        np.testing.assert_allclose([own[c] for c in ABC], prediction.feature_importance(fitted, ABC), atol=1e-6)


def test_deep_models_and_grids_are_reachable(spark, days):
    rows = spark.createDataFrame(days)
    results, _ = prediction.train_models(rows, ABC, models=("gradient_boosting_deep",), subject_cols=("subject",), folds=1)
    assert results.first()["model"] == "gradient_boosting_deep"
    grid = prediction.tuned(rows, ABC, "score", "random_forest", grid={"trees": (5,), "depth": (2, 8)}, subject_cols=("subject",), folds=1)
    assert grid.count() == 2 and set(prediction.GRIDS) == {"random_forest", "gradient_boosting"}


def test_forest_does_not_depend_on_the_layout(spark, cloud):
    df = spark.createDataFrame(pd.DataFrame(cloud, columns=ABC).rename_axis("id").reset_index())
    one = {r.id: r.score for r in anomaly.isolation_scores(df, ["id"], ABC, trees=10, sample_size=64).collect()}
    two = {r.id: r.score for r in anomaly.isolation_scores(df.repartition(7), ["id"], ABC, trees=10, sample_size=64).collect()}
    assert one == two


def test_distances_in_units_of_the_covariance(spark, cloud):
    flat = np.c_[cloud, cloud[:, 0] * 2]        # a column that says nothing new
    df = spark.createDataFrame(pd.DataFrame(flat, columns=[*ABC, "d"]).rename_axis("id").reset_index())
    got = anomaly.mahalanobis(df, ["id"], [*ABC, "d"]).orderBy("id").toPandas()
    z = cloud - cloud.mean(0)
    want = np.sqrt(np.einsum("ij,jk,ik->i", z, np.linalg.inv(np.cov(cloud.T)), z))
    np.testing.assert_allclose(got["score"], want, rtol=1e-9)
    assert (got["label"] == -1).sum() == 45


def test_nearest_centres_by_products_are_those_by_differences(monkeypatch):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(400, 12)) + 1e6, rng.integers(0, 3, (400, 12)).astype(float)])
    sets = [x[:k].copy() for k in (2, 5)] + [x[400:409].copy(), np.repeat(x[400:402], 2, axis=0), x[:1]]
    want = [lloyd.squared(x, c).argmin(1) for c in sets]
    measured, squared = [], lloyd.squared
    monkeypatch.setattr(lloyd, "squared", lambda rows, c: measured.append(len(rows)) or squared(rows, c))
    for got, owner in zip(lloyd.nearest(x, sets), want):
        assert (got == owner).all()
    clear = rng.normal(size=(1000, 12))
    measured.clear()
    lloyd.nearest(clear, [clear[:4]])
    assert not measured         # no row is near the middle of two centres


def test_rounds_read_packed_rows(spark):
    rows = spark.range(20_000).select(F.col("id").cast("double").alias("c0"), (F.col("id") % 7).cast("double").alias("c1"))
    stored = sums.pack(rows)
    assert stored.columns == ["_n", "_block"] and stored.count() < 100
    whole = sums.summed(stored, lambda x: np.concatenate([[len(x)], x.sum(0)]), 3)
    assert whole.tolist() == [20_000, 199_990_000, sum(i % 7 for i in range(20_000))]
