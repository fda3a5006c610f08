"""Clusterings, their quality, and what sets clusters apart."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.functions.quantiles import lookup_by_frequency
from dayloom.operators import lloyd, mixture
from dayloom.operators.neighbors import BLOCK_ROWS, as_array, build_cells, distinct_vectors
from dayloom.operators.neighbors import dbscan as dbscan_cells
from dayloom.operators.profiles import with_median
from dayloom.operators.quality import long_values
from dayloom.session import cut_lineage


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out).transform(df)


def pca(df: DataFrame, features: Sequence[str], k: int = 2) -> DataFrame:
    """Centred data on its first ``k`` principal axes, as ``pc1`` ...; each axis points to its largest loading."""
    rows = assemble(df, features, "_raw")
    centred = StandardScaler(inputCol="_raw", outputCol="_c", withMean=True, withStd=False).fit(rows).transform(rows)
    model = PCA(k=k, inputCol="_c", outputCol="_pc").fit(centred)
    loadings = model.pc.toArray()
    flip = [1.0 if loadings[np.abs(loadings[:, i]).argmax(), i] >= 0 else -1.0 for i in range(k)]
    out = model.transform(centred).withColumn("_p", vector_to_array("_pc"))
    return out.withColumns({f"pc{i + 1}": F.col("_p")[i] * flip[i] for i in range(k)}).drop("_raw", "_c", "_pc", "_p")


def kmeans(df: DataFrame, features: Sequence[str], k: int = 3) -> DataFrame:
    """Clusters numbered in the order of their first centres (see ``operators/lloyd.py``)."""
    found = lloyd.fit_all(df, features, [k]).centers
    if k not in found:
        raise ValueError(f"fewer than {k} different rows")
    return lloyd.assigned(assemble(df, features), features, found[k])


def gaussian_mixture(df: DataFrame, features: Sequence[str], k: int = 3, *, kind: str = "full", rounds: int = 100, tol: float = 1e-3) -> DataFrame:
    """Parts of a Gaussian mixture whose covariances are of a ``kind`` (see ``operators/mixture.py``)."""
    model = mixture.fit_mixtures(df, features, k, [kind], rounds=rounds, tol=tol)[kind]
    return mixture.assigned(assemble(df, features), features, model)


def hierarchical(df: DataFrame, features: Sequence[str], k: int = 3, *, seed: int = 42) -> DataFrame:
    """Divisive: clusters are split until there are ``k``."""
    rows = assemble(df, features)
    return BisectingKMeans(k=k, seed=seed, predictionCol="cluster").fit(rows).transform(rows)


def dbscan(df: DataFrame, features: Sequence[str], *, eps: float = 0.5, min_samples: int = 10,
           block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Density clusters numbered from 0 by their least core vector; noise is -1."""
    rows = as_array(assemble(df, features), features, "_vec")
    cells = build_cells(distinct_vectors(rows, "_vec"), block_rows=block_rows)
    found = cut_lineage(dbscan_cells(cells, eps, min_samples, block_rows=block_rows))
    table = cells.points.select("id", "vec", "weight").join(found, "id").select(
        F.col("vec").alias("_vec"), "weight", F.coalesce("label", F.lit(-1)).cast("long").alias("cluster"))
    return lookup_by_frequency(rows, cut_lineage(table), ["_vec"], "weight").drop("_vec")


def clustering_quality(clustered: DataFrame, *, features: str = "features", cluster: str = "cluster",
                       weight_of_none: float = -1.0) -> DataFrame:
    """Silhouette, Calinski-Harabasz and Davies-Bouldin; -1 with fewer than two clusters.

    One centre per cluster comes to the driver, as in the silhouette of Spark ML.
    """
    array = vector_to_array(F.col(features))
    groups = clustered.groupBy(cluster).agg(
        Summarizer.metrics("mean", "count").summary(F.col(features)).alias("s")).collect()    # one row per cluster
    spark = clustered.sparkSession
    ddl = "silhouette double, calinski_harabasz double, davies_bouldin double, n_clusters int"
    if len(groups) < 2:
        return spark.createDataFrame([(weight_of_none,) * 3 + (len(groups),)], ddl)
    centers = {g[cluster]: g["s"]["mean"].toArray() for g in groups}
    counts = {g[cluster]: g["s"]["count"] for g in groups}
    center_of = F.create_map(*[x for c, m in centers.items() for x in (
        F.lit(c), F.array(*[F.lit(float(v)) for v in m]))])
    d2 = F.aggregate(F.zip_with(array, center_of[F.col(cluster)], lambda a, b: (a - b) * (a - b)), F.lit(0.0),
                     lambda acc, x: acc + x)
    spread = {r[cluster]: r for r in clustered.select(cluster, d2.alias("_d2")).groupBy(cluster).agg(
        F.sum("_d2").alias("ss"), F.avg(F.sqrt("_d2")).alias("scatter")).collect()}
    n, k = sum(counts.values()), len(centers)
    overall = sum(m * counts[c] for c, m in centers.items()) / n
    between = sum(counts[c] * float(((m - overall) ** 2).sum()) for c, m in centers.items())
    within = sum(r["ss"] for r in spread.values())
    calinski = between * (n - k) / (within * (k - 1)) if within > 0 else 1.0
    worst = [max((spread[a]["scatter"] + spread[b]["scatter"]) / float(np.linalg.norm(centers[a] - centers[b]))
                 for b in centers if b != a and np.linalg.norm(centers[a] - centers[b]) > 0) for a in centers]
    relabelled = clustered.withColumn("_k", F.element_at(F.create_map(*[
        x for i, c in enumerate(centers) for x in (F.lit(c), F.lit(float(i)))]), F.col(cluster)))
    silhouette = ClusteringEvaluator(featuresCol=features, predictionCol="_k", metricName="silhouette").evaluate(relabelled)
    return spark.createDataFrame([(float(silhouette), float(calinski), float(np.mean(worst)), k)], ddl)


def choose_k(df: DataFrame, features: Sequence[str], *, max_k: int = 10) -> DataFrame:
    """Quality and inertia of k-means for k = 2..max_k, and which k each measure prefers.

    All k share the scans of each round.  Tables of fewer than 2 max_k rows stop at half their rows.
    """
    top = min(max_k, df.count() // 2)
    model = lloyd.fit_all(df, features, range(2, top + 1))
    table = [(k, s, c, d, model.inertia[k]) for k, s, c, d in lloyd.qualities(df, features, model.centers)]
    best = {
        "silhouette": max(table, key=lambda r: r[1])[0] if table else None,
        "calinski_harabasz": max(table, key=lambda r: r[2])[0] if table else None,
        "davies_bouldin": min(table, key=lambda r: r[3])[0] if table else None,
    }
    bends = np.diff(np.diff([r[4] for r in table]))
    best["elbow"] = int(np.argmax(bends)) + 2 if len(bends) else None
    ddl = ("k int, silhouette double, calinski_harabasz double, davies_bouldin double, inertia double, "
           "chosen_by array<string>")
    return df.sparkSession.createDataFrame([(*r, [m for m, k in best.items() if k == r[0]]) for r in table], ddl)


def _statistics(long: DataFrame, cluster: str) -> DataFrame:
    return long.groupBy(cluster, "column").agg(
        F.count("*").alias("size"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))


def cluster_statistics(clustered: DataFrame, features: Sequence[str], *, cluster: str = "cluster") -> DataFrame:
    """:func:`cluster_profiles` without shares and medians, in one scan."""
    return _statistics(long_values(clustered, features, ids=[cluster]), cluster).where(F.col(cluster) != -1)


def cluster_profiles(clustered: DataFrame, features: Sequence[str], *, cluster: str = "cluster", mode: str = "exact") -> DataFrame:
    """Size, share and statistics of each feature per cluster; noise (-1) is left out but counts in the share.

    Clusters are found once: the statistics and the passes of the medians read stored rows.
    """
    stored = cut_lineage(clustered.select(cluster, *[F.col(c).cast("double").alias(c) for c in features]))
    long = long_values(stored, features, ids=[cluster])
    stats = cut_lineage(_statistics(long, cluster))
    total = stats.where(F.col("column") == features[0]).agg(F.sum("size")).scalar()
    out = with_median(long, [cluster, "column"], "value", stats, mode=mode, few_groups=False)
    return out.withColumn("pct", F.col("size") / total * 100).where(F.col(cluster) != -1)


def cluster_importance(profiles: DataFrame) -> DataFrame:
    """Variance of the cluster means of a feature, the largest being 1; ``profiles`` or :func:`cluster_statistics`."""
    per = cut_lineage(profiles.groupBy("column").agg(F.coalesce(F.var_pop("mean"), F.lit(0.0)).alias("variance")))
    top = per.agg(F.max("variance")).scalar()
    return per.select("column", F.when(top > 0, F.col("variance") / top).otherwise(0.0).alias("importance"))


Clusterer = Callable[[DataFrame, Sequence[str]], DataFrame]
CLUSTERERS: Mapping[str, Clusterer] = {
    "kmeans": kmeans, "gaussian_mixture": gaussian_mixture, "hierarchical": hierarchical, "dbscan": dbscan}


def compare_clusterers(df: DataFrame, features: Sequence[str], clusterers: Mapping[str, Clusterer] = CLUSTERERS) -> DataFrame:
    """Quality per clusterer, ``best`` for the highest silhouette."""
    out = None
    for name, fit in clusterers.items():
        one = clustering_quality(fit(df, features)).withColumn("clusterer", F.lit(name))
        out = one if out is None else out.unionByName(one)
    top = out.agg(F.max_by("clusterer", "silhouette")).scalar()
    return out.withColumn("best", F.col("clusterer") == top)


def dbscan_grid(df: DataFrame, features: Sequence[str], *, eps: Sequence[float] = (0.1, 0.5, 1.0, 2.0),
                min_samples: Sequence[int] = (5, 10, 20)) -> DataFrame:
    """Quality of every parameter pair of the grid."""
    out = None
    for e in eps:
        for m in min_samples:
            one = clustering_quality(dbscan(df, features, eps=e, min_samples=m)).withColumns(
                {"eps": F.lit(float(e)), "min_samples": F.lit(m)})
            out = one if out is None else out.unionByName(one)
    return out
