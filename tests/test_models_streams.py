"""Models against brute force or planted structure; streams against batch."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from dayloom.catalog import QUERIES
from dayloom.functions import sums
from dayloom.operators import anomaly, clustering, lloyd, neighbors, prediction
from dayloom.operators.coverage import daily_coverage
from dayloom.plans import modeling, reports
from dayloom.session import cut_lineage
from dayloom.streaming import incremental

XY = ["x", "y"]


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(4)
    a, b = rng.normal([0, 0], 0.4, (150, 2)), rng.normal([6, 6], 0.5, (120, 2))
    copies = np.tile([[3.0, -4.0]], (40, 1))
    far = np.array([[15.0, -9.0], [-12.0, 11.0], [3.0, 14.0]])
    return pd.DataFrame(np.vstack([a, b, copies, far]), columns=XY).rename_axis("id").reset_index()


def brute_lof(p, k):
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    kd = np.take_along_axis(d, order, 1)[:, -1]
    reach = np.maximum(np.take_along_axis(d, order, 1), kd[order])
    lrd = 1 / (reach.mean(1) + 1e-10)
    return lrd[order].mean(1) / lrd


def brute_dbscan(p, eps, m):
    near = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1)) <= eps
    core = near.sum(1) >= m
    label = np.full(len(p), -1)
    for i in range(len(p)):
        if core[i] and label[i] < 0:
            todo = [i]
            while todo:
                j = todo.pop()
                if label[j] < 0:
                    label[j] = i
                    todo += [n for n in np.flatnonzero(near[j] & core) if label[n] < 0]
    return core, label, near


@pytest.mark.parametrize("block_rows", [40, 5000])
def test_lof_equals_brute_force(spark, blobs, block_rows):
    distinct = blobs.drop_duplicates(XY)
    got = anomaly.lof(spark.createDataFrame(distinct), ["id"], XY, k=10, block_rows=block_rows).toPandas().sort_values("id")
    np.testing.assert_allclose(got["score"], brute_lof(distinct[XY].to_numpy(), 10), rtol=1e-9)
    assert (got["label"] == -1).sum() == int(np.ceil(0.05 * len(got)))


def test_lof_with_copies_keeps_every_row(spark, blobs):
    got = anomaly.lof(spark.createDataFrame(blobs), ["id"], XY, k=20, contamination=0.01, block_rows=64).toPandas().sort_values("id")
    assert len(got) == len(blobs)
    assert set(got.loc[got["label"] == -1, "id"]) >= set(blobs["id"].iloc[-3:])
    copies = got[got["id"].between(270, 309)]["score"]
    assert copies.nunique() == 1 and copies.iloc[0] == pytest.approx(1.0)


@pytest.mark.parametrize("block_rows", [40, 5000])
def test_nearest_neighbors_are_exact(spark, blobs, block_rows):
    distinct = blobs.drop_duplicates(XY)
    points = neighbors.distinct_vectors(neighbors.as_array(spark.createDataFrame(distinct), XY))
    cells = neighbors.build_cells(points, block_rows=block_rows)
    near = neighbors.nearest_neighbors(cells, 5, block_rows=block_rows)
    got = near.groupBy("id").agg(F.array_sort(F.collect_list("distance")).alias("d")).join(cells.points, "id").toPandas()
    p = np.stack(got["vec"])
    d = np.sort(np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1)), axis=1)[:, 1:6]
    np.testing.assert_allclose(np.stack(got["d"]), d, rtol=1e-12)


@pytest.mark.parametrize("spread, most", [(None, 0.13), (6.0, 0.07)])
def test_pairs_measured_in_eight_dimensions(spark, spread, most):
    """Share of all pairs that the exact search measures: uniform rows, and rows in twenty clusters."""
    rng = np.random.default_rng(5)
    x = rng.random((8000, 8)) if spread is None else rng.normal(size=(8000, 8)) + spread * rng.normal(size=(20, 8))[rng.integers(0, 20, 8000)]
    columns = [f"x{i}" for i in range(8)]
    cells = neighbors.build_cells(neighbors.distinct_vectors(neighbors.as_array(spark.createDataFrame(pd.DataFrame(x, columns=columns)), columns)))
    share = neighbors.measured_pairs(cells, 20).agg(F.sum("n")).first()[0] / 8000**2
    assert share < most
    got = neighbors.nearest_neighbors(cells, 20).groupBy("id").agg(F.max("distance").alias("d")).join(cells.points, "id").limit(200).toPandas()
    p = np.stack(got["vec"])
    want = np.sort(np.sqrt(((p[:, None] - x[None]) ** 2).sum(-1)), axis=1)[:, 20]
    np.testing.assert_allclose(got["d"], want, rtol=1e-9)


@pytest.mark.parametrize("name", ["ensemble_vote", "detector_rates"])
def test_votes_search_between_tiles(spark, monkeypatch, name):
    monkeypatch.setattr(neighbors, "visit", None)
    got = QUERIES[name].frame(spark, SF_SMALL).toPandas()
    assert len(got) and (got == -1).any(axis=None) if name == "ensemble_vote" else set(got["n_anomalies"] + got["n_normal"]) == {500}


def test_recall_of_a_limited_search(spark):
    """In 64 dimensions an exact search compares everything; few blocks find most neighbours of clustered rows."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 64)) + 2 * rng.normal(size=(30, 64))[rng.integers(0, 30, 3000)]
    columns = [f"x{i}" for i in range(64)]
    cells = neighbors.build_cells(neighbors.distinct_vectors(neighbors.as_array(spark.createDataFrame(pd.DataFrame(x, columns=columns)), columns)), block_rows=128)
    near = neighbors.nearest_neighbors(cells, 10, block_rows=128, nearest_blocks=6).toPandas()
    p = np.stack(cells.points.orderBy("id").toPandas()["vec"])
    ids = cells.points.orderBy("id").toPandas()["id"].to_numpy()
    d = neighbors.exact_distances(p, p)
    np.fill_diagonal(d, np.inf)
    true = {(ids[i], ids[j]) for i in range(len(p)) for j in np.argsort(d[i])[:10]}
    found = set(zip(near["id"], near["other"]))
    assert len(found) == 30_000 and len(found & true) / len(true) > 0.9


def test_too_few_rows_for_k(spark):
    rows = spark.createDataFrame([(i, float(i), 0.0) for i in range(4)], "id long, x double, y double")
    cells = neighbors.build_cells(neighbors.distinct_vectors(neighbors.as_array(rows, XY)), block_rows=2)
    assert neighbors.nearest_neighbors(cells, 20, block_rows=2).count() == 12


@pytest.mark.parametrize("tile_rows", [300, 32_768])
def test_many_columns_are_searched_between_tiles_not_blocks(spark, monkeypatch, tile_rows):
    def visit(*args, **kwargs):
        raise AssertionError("every row visits nearly every block of so many columns")

    monkeypatch.setattr(neighbors, "visit", visit)
    monkeypatch.setattr(neighbors, "TILE_ROWS", (tile_rows, tile_rows))
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 20)) + 1e4
    x[0] *= 1e3
    x = np.concatenate([x, x[:40]])
    columns = [f"x{i}" for i in range(20)]
    cells = neighbors.build_cells(neighbors.distinct_vectors(neighbors.as_array(spark.createDataFrame(pd.DataFrame(x, columns=columns)), columns)))
    got = neighbors.nearest_neighbors(cells, 15).join(cells.points.select("id", "vec"), "id").toPandas()
    d = np.sort(neighbors.exact_distances(x, x), axis=1)[:, 1:16]
    want = {tuple(row): far for row, far in zip(x.tolist(), d)}
    assert got["id"].nunique() == 1500
    for vec, group in got.groupby(got["vec"].map(tuple)):
        group = group.sort_values("distance")
        np.testing.assert_array_equal(np.repeat(group["distance"], group["weight"]), want[vec])


@pytest.mark.parametrize("copies", [0, 60])
def test_factors_of_many_columns_are_settled_by_tile_and_returned_by_id(spark, monkeypatch, copies):
    """Each tile meets all strips in one task, and only rows of copies are looked up by their vector."""
    monkeypatch.setattr(neighbors, "TILE_ROWS", (300, 300))
    monkeypatch.setattr(neighbors, "_STRIP", 100)
    monkeypatch.setattr(neighbors, "_first_k", None)
    looked_up = []
    real = anomaly.lookup_by_frequency
    monkeypatch.setattr(anomaly, "lookup_by_frequency", lambda rows, *args, **kwargs: looked_up.append(1) or real(rows, *args, **kwargs))
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(size=(1000, 20)), 0.1 * rng.normal(size=(200, 20)) + 3])
    x = np.concatenate([x, x[:copies]])
    columns = [f"x{i}" for i in range(20)]
    rows = pd.DataFrame(x, columns=columns).assign(name=[f"n{i}" for i in range(len(x))], part=np.arange(len(x)) % 7)
    got = anomaly.lof(spark.createDataFrame(rows), ["name", "part"], columns, k=10, contamination=None).toPandas().set_index("name")
    assert len(got) == len(x) and (got.loc[rows["name"], "part"].to_numpy() == rows["part"]).all()
    np.testing.assert_allclose(got.loc[rows["name"], "score"], brute_lof(x, 10), rtol=1e-9)
    assert bool(looked_up) == (copies > 0)


def test_votes_find_all_cuts_in_one_run(spark, monkeypatch):
    runs, real = [], anomaly.quantiles
    monkeypatch.setattr(anomaly, "quantiles", lambda *args, **kwargs: runs.append(1) or real(*args, **kwargs))
    assert QUERIES["ensemble_vote"].frame(spark, SF_SMALL).count() == 500 and len(runs) == 1


def test_labels_by_shares_are_those_of_each_share(spark):
    frames = {n: (spark.range(m).select("id", (F.sin("id") * m).alias("score")), s) for n, m, s in (("a", 301, 0.05), ("b", 40, 0.1), ("c", 0, 0.1))}
    got = anomaly.label_by_shares(frames)
    assert got.pop("c").count() == 0
    for name, labelled in got.items():
        want = anomaly.label_by_share(frames[name][0], "score", frames[name][1])
        assert sorted(map(tuple, labelled.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("block_rows", [30, 5000])
def test_dbscan_equals_brute_force(spark, blobs, block_rows):
    got = clustering.dbscan(spark.createDataFrame(blobs), XY, eps=0.6, min_samples=8, block_rows=block_rows).toPandas().sort_values("id")
    core, label, near = brute_dbscan(blobs[XY].to_numpy(), 0.6, 8)
    mine = got["cluster"].to_numpy()
    pairs = set(zip(mine[core], label[core]))
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) == 3
    for i in np.flatnonzero(~core):
        allowed = set(mine[near[i] & core]) or {-1}
        assert mine[i] in allowed


def test_dbscan_follows_a_long_chain(spark):
    line = pd.DataFrame({"id": range(160), "x": np.arange(160) * 0.4, "y": 0.0})
    got = clustering.dbscan(spark.createDataFrame(line), XY, eps=0.5, min_samples=2, block_rows=25)
    assert got.select("cluster").distinct().count() == 1


def test_isolation_forest_finds_planted_points(spark, blobs):
    df = spark.createDataFrame(blobs)
    got = anomaly.isolation_forest(df, ["id"], XY, contamination=0.03).toPandas().sort_values("id")
    assert set(got.loc[got["label"] == -1, "id"]) >= set(blobs["id"].iloc[-3:])
    again = anomaly.isolation_forest(df.repartition(5), ["id"], XY, contamination=0.03).toPandas().sort_values("id")
    np.testing.assert_allclose(again["score"], got["score"])
    assert got["score"].between(0, 1).all() and (got["label"] == -1).sum() <= np.ceil(0.03 * len(got))


def test_large_table_sampling_sizes(spark):
    df = spark.range(300_000).select("id", F.array(F.rand(1), F.rand(2)).alias("v"))
    few = anomaly.draw_samples(df, ["id"], "v", 10, 64, 7).groupBy("tree").count().collect()
    assert len(few) == 10 and all(48 <= r["count"] <= 64 for r in few)
    many = anomaly.draw_samples(df.limit(2000), ["id"], "v", 20, 64, 7).groupBy("tree").count().collect()
    assert len(many) == 20 and all(48 <= r["count"] <= 64 for r in many)


def test_mahalanobis_matches_numpy(spark, blobs):
    got = anomaly.mahalanobis(spark.createDataFrame(blobs), ["id"], XY, share=0.1).toPandas().sort_values("id")
    x = blobs[XY].to_numpy()
    c = x - x.mean(0)
    want = np.sqrt((c @ np.linalg.inv(np.cov(x.T)) * c).sum(1))
    np.testing.assert_allclose(got["score"], want)
    np.testing.assert_array_equal(got["label"] == -1, want > np.quantile(want, 0.9))


def test_vote_needs_more_than_half(spark):
    votes = {n: spark.createDataFrame([(1, a), (2, b)], "id int, label int") for n, a, b in
             (("p", 1, -1), ("q", 1, -1), ("r", -1, 1))}
    out = anomaly.ensemble(votes, ["id"])
    assert {r["id"]: r["ensemble"] for r in out.collect()} == {1: 1, 2: -1}
    even = anomaly.ensemble({k: votes[k] for k in ("p", "r")}, ["id"])
    assert {r["ensemble"] for r in even.collect()} == {-1}
    assert {r["detector"]: r["anomaly_rate"] for r in anomaly.detector_rates(out, ["p", "ensemble"]).collect()} == {"p": 0.5, "ensemble": 0.5}


def test_clusterers_recover_blobs_and_quality(spark, blobs):
    two = blobs.iloc[:270]
    df = spark.createDataFrame(two)
    truth = np.repeat([0, 1], [150, 120])
    for fit in (clustering.kmeans, clustering.gaussian_mixture, clustering.hierarchical):
        mine = fit(df, XY, 2).toPandas().sort_values("id")["cluster"].to_numpy()
        assert (mine == truth).all() or (mine == 1 - truth).all()
    clustered = clustering.kmeans(df, XY, 2)
    q = clustering.clustering_quality(clustered).first()
    x = two[XY].to_numpy()
    centers = np.stack([x[truth == i].mean(0) for i in (0, 1)])
    own = np.linalg.norm(x - centers[truth], axis=1)
    between = sum((truth == i).sum() * ((centers[i] - x.mean(0)) ** 2).sum() for i in (0, 1))
    assert q["calinski_harabasz"] == pytest.approx(between * (270 - 2) / (own ** 2).sum())
    scatter = [own[truth == i].mean() for i in (0, 1)]
    assert q["davies_bouldin"] == pytest.approx(sum(scatter) / np.linalg.norm(centers[0] - centers[1]))
    assert q["silhouette"] > 0.9
    assert clustering.clustering_quality(clustered.withColumn("cluster", F.lit(0))).first()["silhouette"] == -1
    chosen = clustering.choose_k(df, XY, max_k=4).collect()
    assert "silhouette" in next(r["chosen_by"] for r in chosen if r["k"] == 2)
    profile = clustering.cluster_profiles(clustered, XY)
    assert profile.count() == 4 and profile.agg(F.sum("size")).first()[0] == 540
    assert {r["importance"] > 0.9 for r in clustering.cluster_importance(profile).collect()} == {True}


def test_pca_matches_numpy(spark, blobs):
    got = clustering.pca(spark.createDataFrame(blobs), XY).toPandas().sort_values("id")
    x = blobs[XY].to_numpy() - blobs[XY].to_numpy().mean(0)
    _, s, v = np.linalg.svd(x, full_matrices=False)
    np.testing.assert_allclose(np.abs(got[["pc1", "pc2"]].to_numpy()), np.abs(x @ v.T), atol=1e-8)


@pytest.fixture(scope="module")
def history(spark):
    rng = np.random.default_rng(8)
    n = 120
    steps, hr, stress = rng.normal(8000, 2000, n), rng.normal(60, 4, n), rng.normal(30, 6, n)
    score = 20 + 0.005 * steps - 0.3 * hr + rng.normal(0, 0.01, n)
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), float(steps[i]), float(hr[i]), float(stress[i]),
             None if i % 10 == 3 else float(score[i])) for i in range(n)]
    return spark.createDataFrame(rows, "day date, steps double, rhr double, stress_avg double, score double")


def test_linear_models_explain_linear_data(history):
    frame, features = prediction.sleep_features(history)
    assert features == ["rhr", "steps", "stress_avg", "rhr_lag1", "steps_lag1", "stress_avg_lag1"]
    results, importance = prediction.train_models(frame, features, models=["linear", "ridge"], folds=2)
    rows = {r["model"]: r for r in results.collect()}
    assert rows["linear"]["test_r2"] > 0.999 and rows["linear"]["best"] and rows["linear"]["cv_mse"] < 1
    assert rows["ridge"]["test_r2"] < rows["linear"]["test_r2"] and not rows["ridge"]["best"]
    assert prediction.top_features(importance, "linear", 1).first()["feature"] == "steps"


def test_tree_models_and_grid(history):
    frame, features = prediction.sleep_features(history)
    table = prediction.grid_search(frame, features, "score", prediction.random_forest, {"trees": (5,), "depth": (1, 4)}, folds=2)
    best = table.where("best").collect()
    assert len(best) == 1 and best[0]["params"]["depth"] == "4"
    boosted = prediction.grid_search(frame, features, "score", prediction.gradient_boosting, {"rounds": (5,), "rate": (0.1,), "depth": (3,)}, folds=1)
    assert boosted.first()["cv_mse"] > 0


def test_general_features(history):
    frame, features = prediction.general_features(history)
    assert {"steps_lag1", "steps_lag7", "rhr_rolling_30d", "steps_stress_interaction"} <= set(features) and "score" not in features
    assert frame.where("score is null").count() == 0


def test_modeling_run_isolates_failures(history):
    def broken(df, features):
        raise ValueError("no clusters today")

    run = modeling.run_modeling(history, models=["linear"], clusterers={"broken": broken})
    assert run.errors == {"clusters": "no clusters today"}
    assert {"features", "votes", "detectors", "models", "recommendations"} <= set(run.frames)
    assert run.frames["votes"].count() == 120
    assert "prediction_good" in {r["rule"] for r in run.frames["recommendations"].collect()}


def test_reports(history, spark):
    week = reports.weekly_report(history)
    assert week["weeks"].count() == 4 and week["sleep_score"].count() == 4
    full = reports.full_report(history, monthly=True, features=["steps", "rhr"])
    assert full["anomalies"].count() == 31 and full["best_ranges"].count() == 1
    q = reports.quality_report(history)
    assert q["text"].count() == 0
    assert {r["rule"] for r in q["recommendations"].collect()} <= {"few_model_columns", "enough_model_columns"}


EVENTS = "/root/testdata/sf0.001"


def stream(spark):
    schema = spark.read.parquet(f"{EVENTS}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(EVENTS).withColumnRenamed("value", "stress")


def batch(spark):
    return spark.read.parquet(f"{EVENTS}/events.parquet").withColumnRenamed("value", "stress")


def test_streamed_coverage_equals_batch(spark, tmp_path):
    s = incremental.daily_coverage_stream(stream(spark), subject_cols=["event_type"], max_gap_minutes=60, edge_minutes=30)
    incremental.run_available(s, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "out"))
    want = daily_coverage(batch(spark), subject_cols=["event_type"], max_gap_minutes=60, edge_minutes=30)
    same = want.select(*got.columns).join(got.select("event_type", "day"), ["event_type", "day"], "left_semi").select(*got.columns)
    assert got.select("day").distinct().count() == 28
    assert got.exceptAll(same).count() == 0 and same.exceptAll(got).count() == 0


def test_streamed_moments_give_hourly_profile(spark, tmp_path):
    incremental.run_available(incremental.hourly_moments_stream(stream(spark)), str(tmp_path / "out"), str(tmp_path / "ck"))
    moments = spark.read.parquet(str(tmp_path / "out"))
    got = incremental.hourly_profile_from_moments(moments).toPandas().sort_values("hour")
    last = batch(spark).agg(F.max("ts")).first()[0] - dt.timedelta(days=1)
    pdf = batch(spark).toPandas()
    pdf = pdf[pdf["ts"].dt.floor("h") + pd.Timedelta(hours=1) <= last]
    want = pdf.groupby(pdf["ts"].dt.hour)["stress"].agg(["mean", "std", "count"])
    for c in want:
        np.testing.assert_allclose(got[c], want[c])


@pytest.fixture
def one_row_group(tmp_path):
    """Embeddings as a file that a single task reads."""
    rng = np.random.default_rng(9)
    pd.DataFrame({"vec_id": range(400), "embedding": list(rng.normal(size=(400, 64)).astype("float32")), "label": 0}).to_parquet(
        tmp_path / "embeddings.parquet", row_group_size=400)
    return str(tmp_path)


def counting(monkeypatch, spark, operator):
    """How many tasks hold the rows that ``operator`` of anomaly or clustering is given, once its query has run."""
    held = []
    module = anomaly if hasattr(anomaly, operator) else clustering
    real = getattr(module, operator)

    def run(df, *args, **kwargs):
        held.append(df.select(F.spark_partition_id().alias("p")).distinct().count())
        return real(df, *args, **kwargs)

    monkeypatch.setattr(module, operator, run)
    return held


@pytest.mark.parametrize("name", ["detector_rates", "ensemble_vote"])
def test_detectors_read_rows_in_many_tasks(spark, monkeypatch, one_row_group, name):
    held = [counting(monkeypatch, spark, o) for o in ("isolation_forest", "lof", "mahalanobis")]
    got = QUERIES[name].frame(spark, one_row_group)
    assert got.count() == (400 if name == "ensemble_vote" else 4)
    assert all(h and min(h) > 1 for h in held)


def test_importance_reads_rows_in_many_tasks(spark, monkeypatch, one_row_group):
    held = counting(monkeypatch, spark, "kmeans")
    assert QUERIES["cluster_importance"].frame(spark, one_row_group).count() == 64
    assert held and min(held) > 1


def test_profiles_find_clusters_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def cluster(i):
        seen.add(1)
        return i % 3 - 1

    rows = spark.range(300).select(F.udf(cluster, "int")("id").alias("cluster"), F.sin("id").alias("x"), F.cos("id").alias("y"))
    got = {(r["cluster"], r["column"]): r for r in clustering.cluster_profiles(rows, XY).collect()}
    assert seen.value == 300
    assert set(got) == {(c, f) for c in (0, 1) for f in XY}
    x = np.sin(np.arange(1, 300, 3))
    one = got[0, "x"]
    assert one["size"] == 100 and one["pct"] == pytest.approx(100 / 3) and one["median"] == pytest.approx(np.median(x))
    assert (one["mean"], one["std"], one["min"], one["max"]) == pytest.approx((x.mean(), x.std(ddof=1), x.min(), x.max()))
    want = {f: np.var([got[c, f]["mean"] for c in (0, 1)]) for f in XY}
    for r in clustering.cluster_importance(clustering.cluster_statistics(rows, XY)).collect():
        assert r["importance"] == pytest.approx(want[r["column"]] / max(want.values()))


def test_sums_of_few_tasks_need_no_shuffle(spark, monkeypatch):
    packed = sums.pack(spark.range(1000).select(F.col("id").cast("double").alias("a"), F.lit(2.0).alias("b"))).localCheckpoint()
    step = lambda x: x.sum(0)
    shuffled = sums.summed(packed, step, 2)
    monkeypatch.setattr(type(packed), "groupBy", None)
    np.testing.assert_array_equal(sums.summed(packed, step, 2, tasks=8), shuffled)
    np.testing.assert_array_equal(shuffled, [499_500, 2000])


def test_rounds_read_blocks_that_executors_hold(spark, monkeypatch):
    """No round reads the stored table again, and the blocks are given back."""
    seen, real = [], lloyd.summed_blocks
    kept = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    before = kept()
    monkeypatch.setattr(lloyd, "summed", None)
    monkeypatch.setattr(lloyd, "summed_blocks", lambda blocks, *args: seen.append((blocks.is_cached, kept())) or real(blocks, *args))
    found = lloyd.fit_all(spark.range(900).select(F.sin("id").alias("x"), F.cos(F.col("id") * 3).alias("y")), XY, [3])
    assert len(seen) > found.rounds > 4 and set(seen) == {(True, before + 1)}
    assert kept() == before


@pytest.mark.parametrize("direct", [1 << 22, 0])
def test_held_blocks_are_summed_like_their_table(spark, monkeypatch, direct):
    monkeypatch.setattr(sums, "_DIRECT", direct)
    stored = cut_lineage(sums.pack(spark.range(5000).select(F.col("id").cast("double").alias("a"), F.lit(2.0).alias("b"))))
    step = lambda x: np.concatenate([[len(x)], x.sum(0)])
    with sums.held(stored) as blocks:
        np.testing.assert_array_equal(sums.summed_blocks(blocks, step, 3), [5000, 4999 * 2500, 10_000])
    none = cut_lineage(sums.pack(spark.range(0).select(F.col("id").cast("double").alias("a"))))
    with sums.held(none) as blocks:
        np.testing.assert_array_equal(sums.summed_blocks(blocks, step, 2), [0, 0])
