import numpy as np
import pandas as pd
import pytest

from dayloom.functions.quantiles import average_ranks, dense_number, lookup_by_frequency, quantiles

PROBS = [0.0, 0.25, 0.5, 0.77, 1.0]


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(7)
    hot = np.concatenate([rng.normal(60, 8, 4000), np.full(2000, 61.5)])
    mixed = np.concatenate([-np.exp(rng.normal(0, 6, 700)), np.exp(rng.normal(0, 6, 700)), np.zeros(100)])
    near = 1000 + np.arange(500) * 1e-12 + rng.integers(0, 3, 500)
    single = np.array([5.0])
    return pd.DataFrame({
        "g": ["hot"] * len(hot) + ["mixed"] * len(mixed) + ["near"] * len(near) + ["single"],
        "v": np.concatenate([hot, mixed, near, single]),
    })


@pytest.mark.parametrize("few", [True, False])
def test_grouped_exact_quantiles(spark, frame, few):
    got = {r["g"]: r for r in quantiles(spark.createDataFrame(frame), ["g"], "v", PROBS, mode="exact", few_groups=few).collect()}
    assert set(got) == set(frame["g"])
    for g, v in frame.groupby("g")["v"]:
        assert got[g]["n"] == len(v)
        np.testing.assert_allclose(got[g]["q"], np.quantile(v, PROBS), rtol=1e-13, atol=1e-300)


@pytest.mark.parametrize("mode", ["exact", "bounded"])
def test_global_quantiles_ignore_null_and_nan(spark, mode):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,), (float("nan"),), (10.0,), (float("inf"),)], "v double")
    row = quantiles(df, [], "v", [0.5, 1.0], mode=mode).first()
    assert row["n"] == 4 and row["q"] == [6.0, float("inf")]


def test_average_ranks(spark, frame):
    got = average_ranks(spark.createDataFrame(frame), ["g"], "v").toPandas()
    frame = frame.assign(rank=frame.groupby("g")["v"].rank())
    want = frame.groupby(["g", "v"]).agg(rank=("rank", "first"), n=("rank", "size")).reset_index()
    got = got.sort_values(["g", "v"]).reset_index(drop=True)
    np.testing.assert_allclose(got["rank"], want["rank"])
    np.testing.assert_array_equal(got["n_equal"], want["n"])


def test_lookup_by_frequency_keeps_every_row(spark):
    rows = spark.createDataFrame([(i, 1 if i % 2 else i) for i in range(4000)], "id long, k long")
    table = rows.groupBy("k").count().withColumnRenamed("count", "n").selectExpr("k", "n", "k * 10 as looked")
    out = lookup_by_frequency(rows, table, ["k"], "n", heavy_share=0.01)
    assert out.count() == 4000
    assert out.where("looked <> k * 10").count() == 0


def test_dense_numbers_do_not_depend_on_the_layout(spark):
    values = spark.range(500).selectExpr("concat('k', lpad(id * 7 % 100, 3, '0')) AS name")
    for parts in (1, 7):
        got = {r["name"]: r["n"] for r in dense_number(values.repartition(parts), "name", "n").collect()}
        assert got == {f"k{i:03d}": i for i in range(100)}
    assert dense_number(values.limit(0), "name", "n").count() == 0


def test_unknown_mode_is_refused(spark):
    with pytest.raises(ValueError):
        quantiles(spark.range(3), [], "id", [0.5], mode="auto")
