"""Nearest neighbours by multiprobe p-stable hashing.

Vectors are put on the unit sphere by one more component, so that the largest
inner product is the smallest distance.  Each table has ``projections`` Gaussian
(2-stable) directions, cut into slots of one width; the slots of a vector are
its bucket.  A query visits the occupied buckets of each table, its own and
those with perturbed slots, in the order of the estimated probability that a
neighbour lies there, until their sum reaches the share that all tables together
need for ``success``.  Candidates of all tables are scored exactly.

The neighbour that the estimate is made for has the similarity which ``k`` of
all rows would exceed if similarities were normal with the middle and spread of
a bounded sample.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dayloom.llm.common import Tables, bounded_sample

TABLES, PROJECTIONS, WIDTH, SUCCESS = 4, 8, 4.0, 0.95
SAMPLE_ROWS = 1000
#: Vectors of a bucket, and queries, that one block of exact scores holds, about.
BLOCK_ROWS, BLOCK_QUERIES = 2048, 1024
#: Slots are cut off at this distance from the middle slot, so a table has at most (2 * MOST + 1) ** projections buckets.
MOST = 7


def _normal(x: np.ndarray) -> np.ndarray:
    """Distribution function of the normal distribution, to about 1e-7."""
    t = 1 / (1 + 0.3275911 * np.abs(x) / math.sqrt(2))
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = 0.5 * tail * np.exp(-x * x / 2)
    return np.where(x > 0, 1 - half, half)


@dataclass
class Hashing:
    directions: np.ndarray      # tables x (dimension + 1) x projections
    shifts: np.ndarray          # tables x projections
    width: float
    largest: float              # norm of the longest vector

    @staticmethod
    def make(dimension: int, largest: float, tables: int, projections: int, width: float) -> Hashing:
        rng = np.random.default_rng(20240607)
        return Hashing(rng.normal(size=(tables, dimension + 1, projections)), rng.uniform(0, width, (tables, projections)), width, largest)

    def sphere(self, x: np.ndarray) -> np.ndarray:
        y = x / self.largest
        return np.concatenate([y, np.sqrt(np.maximum(0.0, 1 - (y * y).sum(axis=1, keepdims=True)))], axis=1)

    def slots(self, x: np.ndarray, table: int) -> np.ndarray:
        at = np.floor((self.sphere(x) @ self.directions[table] + self.shifts[table]) / self.width)
        return np.clip(at, -MOST, MOST).astype(np.int64)

    def success(self, x: np.ndarray, table: int, slots: np.ndarray, similarity: float) -> np.ndarray:
        """Probability that a vector of this similarity to the query lies in each bucket, queries x buckets."""
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        middle = similarity * (unit @ self.directions[table][:-1])
        spread = math.sqrt(1 - similarity**2) * np.linalg.norm(self.directions[table], axis=0) / math.sqrt(self.directions.shape[1])
        out = np.ones((len(x), len(slots)))
        for i in range(slots.shape[1]):
            lo = slots[:, i] * self.width - self.shifts[table, i]
            hi = np.where(slots[:, i] == MOST, np.inf, lo + self.width)
            lo = np.where(slots[:, i] == -MOST, -np.inf, lo)
            out *= _normal((hi - middle[:, i:i + 1]) / spread[i]) - _normal((lo - middle[:, i:i + 1]) / spread[i])
        return out


def _code(slots: np.ndarray) -> np.ndarray:
    return ((slots + MOST) * (2 * MOST + 1) ** np.arange(slots.shape[1])).sum(axis=1)


def _slots(codes: np.ndarray, projections: int) -> np.ndarray:
    return codes[:, None] // (2 * MOST + 1) ** np.arange(projections) % (2 * MOST + 1) - MOST


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1) if len(lists) else np.zeros((0, 1))


def _indexed(hashing: Hashing):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"))
            for t in range(len(hashing.directions)):
                if len(x):
                    yield pa.record_batch({"tab": pa.array(np.full(len(x), t, np.int32)), "bucket": pa.array(_code(hashing.slots(x, t))),
                                           "id": batch.column("id"), "v": batch.column("v")})

    return run


def _probes(hashing: Hashing, buckets: list[np.ndarray], similarity: float, success: float):
    share = 1 - (1 - success) ** (1 / len(buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                x = _matrix(part.column("v"))
                for t, codes in enumerate(buckets):
                    p = hashing.success(x, t, _slots(codes, hashing.shifts.shape[1]), similarity)
                    order = np.argsort(-p, axis=1, kind="stable")
                    before = np.cumsum(np.take_along_axis(p, order, 1), axis=1) - np.take_along_axis(p, order, 1)
                    row, place = np.nonzero(before < share)
                    yield pa.record_batch({
                        "tab": pa.array(np.full(len(row), t, np.int32)), "bucket": pa.array(codes[order[row, place]]),
                        "id": part.column("id").take(pa.array(row)), "v": part.column("v").take(pa.array(row))})

    return run


def _scored(k: int):
    """The k best of each block for each query of a block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                qid, ids = (batch.column(c)[i].values.to_numpy() for c in ("qids", "ids"))
                q, v = (batch.column(c)[i].values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(n), -1)
                        for c, n in (("qvs", qid), ("vs", ids)))
                near = q @ v.T
                near[qid[:, None] == ids[None, :]] = -np.inf
                least = np.partition(near, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(qid), -np.inf)
                out_q, out_v, out_s = [], [], []
                for j in range(len(qid)):
                    some = np.flatnonzero((near[j] >= least[j] - 1e-9) & (near[j] > -np.inf))
                    exact = (v[some] * q[j]).sum(axis=1)
                    best = some[np.lexsort((ids[some], -exact))[:k]]
                    out_q.append(np.full(len(best), qid[j]))
                    out_v.append(ids[best])
                    out_s.append((v[best] * q[j]).sum(axis=1))
                yield pa.record_batch({"query_id": pa.array(np.concatenate(out_q)), "vec_id": pa.array(np.concatenate(out_v)),
                                       "score": pa.array(np.concatenate(out_s))})

    return run


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id", vector: str = "embedding",
            tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, success: float = SUCCESS) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of each row whose id is divisible by ``every``.

    Nearness is the inner product in double precision; candidates are all rows
    but the query's own.  Up to ``k`` are returned, nearest first, ties to the
    smaller id.

    Rows without id and vectors that are null, zero, or hold null or non-finite
    components take no part, nor do vectors of another length than most have.  Of
    several rows of one id the least vector counts.  Other columns are not looked
    at.
    """
    spark, kept = vectors.sparkSession, Tables(vectors.sparkSession)
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = (vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
            .where("id is not null and v is not null").where(good).groupBy("id").agg(F.min("v").alias("v")))
    rows = kept.keep(rows, "vectors")
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if common is None:
        return empty
    rows = rows.where(F.size("v") == common.n)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    hashing = Hashing.make(common.n, rows.agg(F.max(norm)).first()[0], tables, projections, width)

    sample = np.array([r.v for r in bounded_sample(rows, ["id"], SAMPLE_ROWS, "ann").select("v").collect()])
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    near = (unit[::2] @ hashing.sphere(sample[1::2])[:, :-1].T).ravel()
    similarity = 0.5
    if len(near) and common["count"] > k:
        middle = np.median(near)
        spread = 1.4826 * np.median(np.abs(near - middle))
        similarity = float(np.clip(middle + NormalDist().inv_cdf(1 - k / common["count"]) * spread, 0.05, 0.95))

    index = rows.mapInArrow(_indexed(hashing), "tab int, bucket long, id long, v array<double>")
    counts = index.groupBy("tab", "bucket").count().withColumn("blocks", F.ceil(F.col("count") / BLOCK_ROWS).cast("int"))
    counts = kept.keep(counts, "buckets")
    found = counts.collect()        # bounded by the number of slots, see MOST
    buckets = [np.sort(np.array([r.bucket for r in found if r.tab == t], np.int64)) for t in range(tables)]
    blocks = (index.join(F.broadcast(counts.drop("count")), ["tab", "bucket"])
              .groupBy("tab", "bucket", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"))
              .agg(F.collect_list(F.struct("id", "v")).alias("rows"))
              .select("tab", "bucket", F.col("rows.id").alias("ids"), F.flatten("rows.v").alias("vs")))

    queries = rows.where(F.col("id") % every == 0)
    chunks = max(1, -(-queries.count() // BLOCK_QUERIES))
    asked = (queries.repartition("id").mapInArrow(_probes(hashing, buckets, similarity, success), "tab int, bucket long, id long, v array<double>")
             .groupBy("tab", "bucket", F.pmod(F.xxhash64("id"), F.lit(chunks)).alias("chunk"))
             .agg(F.collect_list(F.struct("id", "v")).alias("rows"))
             .select("tab", "bucket", F.col("rows.id").alias("qids"), F.flatten("rows.v").alias("qvs")))
    pairs = blocks.hint("merge").join(asked, ["tab", "bucket"]).select("qids", "qvs", "ids", "vs")
    scored = pairs.mapInArrow(_scored(k), "query_id long, vec_id long, score double").dropDuplicates(["query_id", "vec_id"])
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
