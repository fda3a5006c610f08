"""Forests grown by sums against plain Python."""

import hashlib

import numpy as np
import pandas as pd
import pytest

from dayloom.operators import forest

ABC = ["a", "b", "c"]
SCHEMA = "day int, a double, b double, c double, score double, fold int"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    n = 400
    out = pd.DataFrame({"day": np.arange(n), "a": rng.normal(size=n), "b": rng.integers(0, 5, n).astype(float), "c": rng.uniform(size=n)})
    out["score"] = 3 * (out["a"] > 0) + out["b"] + 0.1 * rng.normal(size=n)
    out["fold"] = np.where(out["day"] >= 320, -1, out["day"] // 80)
    out.loc[rng.random(n) < 0.1, "c"] = np.nan
    return out


def table(spark, rows):
    return spark.createDataFrame([tuple(None if v != v else v for v in r) for r in rows.astype(object).itertuples(index=False)], SCHEMA)


def weight(day, tree, seed=42):
    h = hashlib.md5(f"{seed}|{day}".encode()).hexdigest()
    u = (int(h[:7], 16) + (tree + 1) * int(h[8:15], 16)) % 268_435_399
    return sum(u >= limit for limit in forest.WEIGHT_LIMITS)


def grown(rows, cuts, tree, depth, min_rows):
    """node -> (feature, cut, rows, mean), by trying every cut of every node on all its rows."""
    w = np.array([weight(d, tree) for d in rows["day"]])
    y = np.floor(rows["score"].to_numpy() * forest.SCALE + 0.5).astype(int)
    left = lambda f, c: ~(rows[ABC[f]].to_numpy() > c)
    out, todo = {}, [(1, w > 0, 0)]
    while todo:
        node, inside, level = todo.pop()
        n, s, best = int(w[inside].sum()), int((w * y)[inside].sum()), None
        for f in range(3):
            for c in cuts[f]:
                go = inside & left(f, c)
                nl, sl = int(w[go].sum()), int((w * y)[go].sum())
                if nl >= min_rows and n - nl >= min_rows:
                    gain = float(sl) * sl / nl + float(s - sl) * (s - sl) / (n - nl) - float(s) * s / n
                    if best is None or gain > best[0]:
                        best = (gain, f, float(c), go)
        if level == depth or best is None or best[0] <= forest.MIN_GAIN:
            out[node] = (-1, None, n, s / n / forest.SCALE)
            continue
        out[node] = (best[1], best[2], n, s / n / forest.SCALE)
        todo += [(2 * node, best[3], level + 1), (2 * node + 1, inside & ~best[3], level + 1)]
    return out


def test_trees_equal_plain_growth(spark, rows):
    train = rows[rows["fold"] >= 0]
    made, _ = forest.grow_forest(table(spark, train).repartition(5), ABC, keys=["day"], trees=3, depth=4, min_rows=3, bins=12)
    got = {}
    for r in forest.forest_nodes(spark, made).collect():
        got.setdefault(r.tree, {})[r.node] = (r.feature, r.cut, r.rows, r.mean)
    for t in range(3):
        assert got[t] == grown(train, made.cuts, t, 4, 3)
    assert [len(c) for c in made.cuts] == [12, 5, 12]
    share = {r.feature: r.importance for r in forest.forest_importance(forest.forest_nodes(spark, made), ABC).collect()}
    assert abs(sum(share.values()) - 1) < 1e-9 and share["c"] < 0.05 < share["a"]


def predicted(rows, trees, depth):
    out = np.zeros(len(rows))
    for nodes in trees:
        for i, r in enumerate(rows[ABC].itertuples(index=False)):
            at = 1
            for _ in range(depth):
                f, c = nodes[at][:2]
                if f < 0:
                    break
                at = 2 * at + bool(r[f] > c)
            out[i] += nodes[at][3] / len(trees)
    return out


def test_smaller_forests_of_one_growth(spark, rows):
    made, data = forest.grow_forest(table(spark, rows).repartition(3), ABC, keys=["day"], trees=3, depth=4, min_rows=2, folds=3, bins=8)
    got = {(r.trees, r.depth, r.role): r for r in forest.evaluate(made, data, [(1, 4), (3, 2)]).collect()}
    y = np.floor(rows["score"].to_numpy() * forest.SCALE + 0.5) / forest.SCALE
    for n, depth in ((1, 4), (3, 2)):
        fits = {f: [grown(rows[(rows["fold"] >= 0) & ((f == 0) | (rows["fold"] < f))], made.cuts, t, depth, 2) for t in range(n)] for f in range(4)}
        error = {f: (y - predicted(rows, trees, depth)) ** 2 for f, trees in fits.items()}
        fold = rows["fold"].to_numpy()
        assert got[n, depth, "test"].mse == pytest.approx(error[0][fold < 0].mean())
        assert got[n, depth, "train"].mse == pytest.approx(error[0][fold >= 0].mean())
        assert got[n, depth, "cv"].mse == pytest.approx(np.mean([error[f][fold == f].mean() for f in (1, 2, 3)]))
        assert got[n, depth, "test"].n == 80 and got[n, depth, "test"].r2 > 0.7
    with pytest.raises(ValueError):
        forest.evaluate(made, data, [(4, 2)])


def test_grid_and_odd_tables(spark, rows):
    out = forest.forest_grid(table(spark, rows), ABC, keys=["day"], trees=(1, 4), depths=(2, 3), min_rows=(1, 5), folds=3).collect()
    assert len(out) == 2 * 2 * 2 * 3 and [r.role for r in out if r.best] == ["cv"]
    assert min((r.mse for r in out if r.role == "cv")) == next(r.mse for r in out if r.best)

    none = table(spark, rows).where("day < 0")
    assert forest.forest_nodes(spark, forest.grow_forest(none, ABC, keys=["day"], trees=2, depth=3)[0]).count() == 0
    same = spark.createDataFrame([(1, None, 2.0, None, 5.0, 0)] * 50 + [(2, None, 2.0, None, None, 0)], SCHEMA)
    made = forest.forest_nodes(spark, forest.grow_forest(same, ABC, keys=["day"], trees=4, depth=3)[0]).collect()
    assert all(r.node == 1 and r.feature == -1 and r.mean == 5.0 for r in made)
