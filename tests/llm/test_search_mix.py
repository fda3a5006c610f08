"""Nearest neighbours and source mixing."""

from fractions import Fraction
import random

import numpy as np

from conftest import SF_SMALL
from dayloom.llm.ann import nearest
from dayloom.llm.mixing import mix_sources, mixing_digest


def brute_nearest(rows, k, every):
    good = {i: np.array(v, float) for i, v in rows}
    out = {}
    for q in good:
        if q % every == 0:
            near = sorted(((-(v * good[q]).sum(), i) for i, v in good.items() if i != q))
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def test_nearest_recall_and_scores(spark):
    vectors = spark.read.parquet(f"{SF_SMALL.replace('0.001', '0.01')}/embeddings.parquet")
    want = brute_nearest([(r.vec_id, r.embedding) for r in vectors.collect()], 20, 20)
    rows = nearest(vectors).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
    for q, found in got.items():
        assert len(found) == 20 and found == sorted(found, key=lambda x: (-x[1], x[0]))
        assert all(abs(s - dict(want[q]).get(i, s)) < 1e-12 for i, s in found)


def test_nearest_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]),
            (8, [0.5, 0.5]), (None, [1.0, 0.0]), (9, [1.0, 2.0, 3.0]), (10, [-1.0, 0.0]), (2, [1.0, 0.0]), (40, [0.0, 2.0])]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, id int, v int")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in nearest(frame).collect())
    assert [x[2] for x in got if x[0] == 0] == [1, 2, 8, 40, 10]
    assert [x[2] for x in got if x[0] == 40] == [8, 0, 1, 2, 10]
    assert nearest(frame.where("vec_id = 0")).count() == 0
    assert nearest(frame.where("vec_id < 0")).count() == nearest(frame.where("vec_id = 3")).count() == 0


def test_nearest_many_equal_vectors(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(300)] + [(i, [0.0, 1.0, float(i % 7)]) for i in range(300, 400)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = nearest(frame, k=5, every=20).where("query_id = 280").orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(i, 1.0) for i in range(5)]


def water_level(sizes, weights):
    """Targets by handing out the excess again and again."""
    total, target, full = sum(sizes), [Fraction(0)] * len(sizes), set()
    while True:
        rest = total - sum(3 * sizes[i] for i in full)
        weight = sum(w for i, w in enumerate(weights) if i not in full)
        target = [Fraction(3 * s) if i in full else Fraction(rest * w, weight) for i, (s, w) in enumerate(zip(sizes, weights))]
        over = {i for i, (t, s) in enumerate(zip(target, sizes)) if i not in full and t > 3 * s}
        if not over:
            return target
        full |= over


def test_mixing(spark):
    rng = random.Random(8)
    rows = []
    for s, n in (("a", 5), ("b", 300), ("é", 40), ("z", 80), ("B", 10), (None, 30), ("empty", 2)):
        rows += [(len(rows) + j, " w" * (0 if s == "empty" else rng.randrange(0, 50)), s) for j in range(n)]
    rows += [(9000, None, "a"), (None, "x y", "b"), (9001, "x\ty z", "b"), (9001, "x\ty z", "b")]
    frame = spark.createDataFrame([(i, t, s, 3, "k") for i, t, s in rows], "doc_id long, text string, source string, size int, key string")
    got = mixing_digest(frame).collect()
    assert len(got) == len(rows)
    names = sorted({s for _, _, s in rows if s is not None}) + [None]
    sizes = [sum(len((t or "").split()) for _, t, s in rows if s == x) for x in names]
    want = dict(zip(sizes, water_level(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])))
    for x in names:
        own = [r for r in got if r.source_size == sizes[names.index(x)]]
        assert all(abs(r.target - float(want[r.source_size])) < 1e-6 for r in own)
        assert all(r.taken % r["size"] == 0 and r.taken <= 3 * r["size"] if r["size"] else r.taken == 0 for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= 2 * 50
    assert sum(r.taken for r in got) <= sum(sizes)
    again = mixing_digest(frame.repartition(5)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert mixing_digest(frame.where("doc_id < 0")).count() == 0
    blank = mix_sources(frame.where("source = 'empty'")).collect()
    assert {(r.taken, r.copies, r.target) for r in blank} == {(0, 0, 0.0)}
