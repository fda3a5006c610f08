"""Model queries: detectors, clusterings, regressors, report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayloom.catalog import inputs
from dayloom.catalog.base import Query, table
from dayloom.operators import anomaly, clustering, impute, mixture, prediction
from dayloom.plans import reports
from dayloom.session import cut_lineage

VECTOR = [f"x{i}" for i in range(64)]


def vectors(spark, sf, *, even=False):
    """The components of every embedding as features; ``even`` deals rows out first, for a file may be a single row group, which one task reads."""
    rows = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    if even:
        rows = rows.repartition(max(spark.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()))
    return rows.select(
        "vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(VECTOR)])


DAILY_FEATURES = ["steps", "stress_avg", "resting_heart_rate", "hydration_intake"]


def days(spark, sf):
    """Subject days with all features, standardised."""
    return impute.standardize(inputs.subject_daily(spark, sf), DAILY_FEATURES).select("subject", "day", *DAILY_FEATURES)


def votes(spark, sf):
    rows, keys = cut_lineage(vectors(spark, sf, even=True)), ["vec_id"]     # every detector reads it several times
    return anomaly.ensemble(anomaly.label_by_shares({
        "isolation_forest": (anomaly.isolation_forest(rows, keys, VECTOR, contamination=None, store=False), 0.05),
        "local_outlier_factor": (anomaly.lof(rows, keys, VECTOR, contamination=None), 0.05),
        "mahalanobis": (anomaly.mahalanobis(rows, keys, VECTOR, share=None), 0.1)}), keys)


def clusters(spark, sf):
    return clustering.kmeans(cut_lineage(vectors(spark, sf, even=True)), VECTOR, 3)


SLEEP_COLUMNS = ["steps", "stress_avg", "bb_max", "bb_min", "steps_lag1", "stress_avg_lag1", "bb_max_lag1"]


def linear_models(spark, sf):
    """The four linear models over the days of all subjects."""
    frame, features = prediction.sleep_features(inputs.subject_daily(spark, sf), subject_cols=("subject",))
    return prediction.train_models(frame, features, models=prediction.LINEAR_MODELS, subject_cols=("subject",))[0]


def sleep_models(spark, sf):
    """Five of the six models of the sleep score; boosting, a hundred rounds of jobs, took over 170 s here."""
    frame, features = prediction.sleep_features(inputs.subject_daily(spark, sf), subject_cols=("subject",))
    return prediction.train_models(frame, features, models=(*prediction.LINEAR_MODELS, "random_forest"), subject_cols=("subject",), folds=1)[0]


def sleep_forest(spark, sf):
    frame, features = prediction.sleep_features(inputs.subject_daily(spark, sf), subject_cols=("subject",))
    results, importance = prediction.train_models(
        frame, features, models=["random_forest"], subject_cols=("subject",))
    return prediction.top_features(importance, "random_forest", 20)


def linear_sql() -> str:
    """The four models by coordinate descent, each on the medians, means and deviations of its own training rows."""
    d = len(SLEEP_COLUMNS)
    x = "[" + ", ".join(f"CAST({c} AS DOUBLE)" for c in SLEEP_COLUMNS) + "]"
    lags = ", ".join(f"coalesce(lag({c}) OVER (PARTITION BY subject ORDER BY day), {c}) AS {c}_lag1" for c in ("steps", "stress_avg", "bb_max"))
    return f"""WITH RECURSIVE {inputs.SUBJECT_DAILY_SQL},
f AS (SELECT *, {lags} FROM daily),
r AS (SELECT subject, day, {x} AS x, CAST(score AS DOUBLE) AS y, row_number() OVER (PARTITION BY subject ORDER BY day) AS i,
    count(*) OVER (PARTITION BY subject) AS n FROM f WHERE score IS NOT NULL),
t AS MATERIALIZED (SELECT *, row_number() OVER () AS id, i <= floor(n * 0.8::DOUBLE) AS is_train, floor(n * 0.8::DOUBLE) AS k FROM r),
g AS MATERIALIZED (SELECT id, x, y, CASE WHEN is_train THEN greatest(0, 5 - floor((k - i) / floor(k / 6)))::INT ELSE -1 END AS fold FROM t),
p AS (SELECT unnest(range(1, 7)) AS p),
c AS (SELECT id, y, fold, j, x[j] AS v FROM g, (SELECT unnest(range(1, {d + 1})) AS j)),
med AS MATERIALIZED (SELECT p, j, quantile_cont(v, 0.5) AS m FROM c, p WHERE fold >= 0 AND fold < p GROUP BY ALL),
z AS MATERIALIZED (SELECT p, id, y, fold, j, coalesce(v, m, 0) AS v FROM c JOIN med USING (j)),
st AS MATERIALIZED (SELECT p, j, avg(v) AS mu, stddev_samp(v) AS sd FROM z WHERE fold >= 0 AND fold < p GROUP BY ALL),
s AS MATERIALIZED (SELECT p, id, y, fold, j, CASE WHEN sd > 0 THEN (v - mu) / sd ELSE 0 END AS v FROM z JOIN st USING (p, j)),
w AS MATERIALIZED (SELECT p, id, any_value(y) AS y, any_value(fold) AS fold, list(v ORDER BY j) AS v FROM s GROUP BY p, id),
ym AS (SELECT p, avg(y) AS ybar, count(*) AS n FROM w WHERE fold >= 0 AND fold < p GROUP BY p),
ab AS MATERIALIZED (
  SELECT p, list(row_ ORDER BY i) AS a FROM (SELECT p, i, list(e ORDER BY j) AS row_ FROM (
    SELECT a.p, a.j AS i, b.j, avg(a.v * b.v) AS e FROM s AS a JOIN s AS b ON a.p = b.p AND a.id = b.id WHERE a.fold >= 0 AND a.fold < a.p GROUP BY ALL)
    GROUP BY p, i) GROUP BY p),
bb AS (SELECT p, list(e ORDER BY j) AS b FROM (SELECT s.p, j, avg(v * (y - ybar)) AS e FROM s JOIN ym USING (p) WHERE fold >= 0 AND fold < s.p GROUP BY ALL) GROUP BY p),
m AS MATERIALIZED (SELECT p, model, a, b, ybar, l1, CASE WHEN per THEN reg / n ELSE reg END AS reg FROM ab JOIN bb USING (p) JOIN ym USING (p),
  (VALUES ('linear', 0.0::DOUBLE, 0.0::DOUBLE, false), ('ridge', 1.0, 0.0, true), ('lasso', 0.1, 1.0, false), ('elastic_net', 0.1, 0.5, false)) AS t(model, reg, l1, per)),
cd AS (
  SELECT p, model, 0 AS sweep, list_transform(b, lambda q: 0.0::DOUBLE) AS w FROM m
  UNION ALL
  SELECT p, model, sweep + 1, list_reduce(range(1, {d + 1}), lambda w, j: list_transform(w, lambda o, k: CASE WHEN k <> j THEN o ELSE
      sign(b[j] - list_dot_product(a[j], w) + a[j][j] * w[j]) * greatest(abs(b[j] - list_dot_product(a[j], w) + a[j][j] * w[j]) - reg * l1, 0)
      / CASE WHEN a[j][j] + reg * (1 - l1) > 0 THEN a[j][j] + reg * (1 - l1) ELSE 1 END END), cd.w)
  FROM cd JOIN m USING (p, model) WHERE sweep < 400),
fit AS (SELECT p, model, cd.w, ybar FROM cd JOIN m USING (p, model) WHERE sweep = 400),
e AS (SELECT model, w.p, fold, y, y - ybar - list_dot_product(w.v, fit.w) AS err FROM w JOIN fit ON fit.p = w.p),
whole AS (
  SELECT model, avg(err * err) FILTER (fold >= 0) AS train_mse, avg(abs(err)) FILTER (fold >= 0) AS train_mae,
    1 - avg(err * err) FILTER (fold >= 0) / var_pop(y) FILTER (fold >= 0) AS train_r2, avg(err * err) FILTER (fold < 0) AS test_mse,
    sqrt(avg(err * err) FILTER (fold < 0)) AS test_rmse, avg(abs(err)) FILTER (fold < 0) AS test_mae,
    1 - avg(err * err) FILTER (fold < 0) / var_pop(y) FILTER (fold < 0) AS test_r2 FROM e WHERE p = 6 GROUP BY model),
cv AS (SELECT model, avg(mse) AS cv_mse, stddev_pop(mse) AS cv_std FROM (SELECT model, p, avg(err * err) AS mse FROM e WHERE fold = p GROUP BY ALL) GROUP BY model)
SELECT *, test_r2 = max(test_r2) OVER () AS best FROM whole JOIN cv USING (model)"""


VECTORS_SQL = "v AS (SELECT vec_id, label, " + ", ".join(
    f"CAST(embedding[{i + 1}] AS DOUBLE) AS {c}" for i, c in enumerate(VECTOR)) + " FROM embeddings)"
X = "[" + ", ".join(VECTOR) + "]"
LOF_SQL = f"""WITH {VECTORS_SQL}, p AS (SELECT a.vec_id AS id, b.vec_id AS o, list_distance(a.x, b.x) AS d
  FROM (SELECT vec_id, {X} AS x FROM v) AS a JOIN (SELECT vec_id, {X} AS x FROM v) AS b ON a.vec_id <> b.vec_id),
n AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, o) <= 20),
k AS (SELECT id, max(d) AS kd FROM n GROUP BY 1),
r AS (SELECT n.id, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM n JOIN k ON n.o = k.id GROUP BY 1),
s AS (SELECT n.id AS vec_id, avg(a.lrd) / any_value(b.lrd) AS score FROM n JOIN r AS a ON n.o = a.id JOIN r AS b ON n.id = b.id
  GROUP BY 1)
SELECT vec_id, score, CASE WHEN score > (SELECT quantile_cont(score, 0.95) FROM s) THEN -1 ELSE 1 END::BIGINT AS label FROM s"""
LINE_IDS, LINE_NUMBERS = ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def mahalanobis_sql(rows: str, ids: str, columns, share: float = 0.9) -> str:
    """Distances with the inverse covariance of ``columns`` by Gauss-Jordan steps; ``rows`` is a FROM clause."""
    d = len(columns)
    centred = "[" + ", ".join(f"CAST({c} AS DOUBLE) - avg({c}) OVER ()" for c in columns) + "]"
    product = ", ".join(f"sum(z[{i + 1}] * z[{j + 1}]) / (count(*) - 1)" for i in range(d) for j in range(d))
    return f"""WITH RECURSIVE z AS MATERIALIZED (SELECT {ids}, {centred} AS z FROM {rows}),
co AS (SELECT [{product}] AS c FROM z),
g AS (SELECT 0 AS k, list_transform(range(0, {d}), lambda i: c[i * {d} + 1:(i + 1) * {d}] || list_transform(range(0, {d}), lambda j: CASE WHEN i = j THEN 1.0 ELSE 0 END::DOUBLE)) AS a FROM co
  UNION ALL
  SELECT k + 1, list_transform(a, lambda r, i: CASE WHEN i = k + 1 THEN list_transform(r, lambda v: v / a[k + 1][k + 1])
    ELSE list_transform(r, lambda v, j: v - r[k + 1] * a[k + 1][j] / a[k + 1][k + 1]) END) FROM g WHERE k < {d}),
inv AS MATERIALIZED (SELECT list_transform(a, lambda r: r[{d + 1}:]) AS a FROM g WHERE k = {d}),
s AS (SELECT {ids}, sqrt(list_dot_product(z, list_transform(a, lambda r: list_dot_product(r, z)))) AS score FROM z, inv)
SELECT *, CASE WHEN score > (SELECT quantile_cont(score, {share}) FROM s) THEN -1 ELSE 1 END::BIGINT AS label FROM s"""


def isolation_sql(rows: str, key: str, ids: str, columns, *, nodes: bool = False, trees: int = 100, size: int = 256, seed: int = 42) -> str:
    """The forest grown level by level from the same draws, and the walk of every row; ``key`` is the text that is hashed."""
    d, limit = len(columns), (size - 1).bit_length()
    x = "[" + ", ".join(f"CAST({c} AS DOUBLE)" for c in columns) + "]"
    lows = "[" + ", ".join(f"min(x[{i + 1}]) OVER w" for i in range(d)) + "]"
    highs = "[" + ", ".join(f"max(x[{i + 1}]) OVER w" for i in range(d)) + "]"
    draw = lambda first: f"('0x' || md5('{seed}:' || tree || ':' || node)[{first}:{first + 6}])::BIGINT / 268435456.0::DOUBLE"
    path = "CASE WHEN {n} > 2 THEN 2 * (ln({n} - 1.0::DOUBLE) + 0.5772156649015329::DOUBLE) - 2 * ({n} - 1.0::DOUBLE) / {n} WHEN {n} = 2 THEN 1 ELSE 0 END"
    grown = f"""WITH RECURSIVE src AS MATERIALIZED (SELECT {ids}, {x} AS x, md5('{seed}|' || {key}) AS h FROM {rows}),
smp AS (SELECT tree, x FROM src, (SELECT unnest(range({trees})) AS tree)
  QUALIFY row_number() OVER (PARTITION BY tree ORDER BY (('0x' || h[1:7])::BIGINT + (tree + 1) * ('0x' || h[9:15])::BIGINT) % 268435399, x) <= {size}),
grown AS (
  SELECT tree, 1 AS node, 0 AS depth, x FROM smp
  UNION ALL
  SELECT tree, CASE WHEN x[f] <= lo[f] + {draw(9)} * (hi[f] - lo[f]) THEN 2 * node ELSE 2 * node + 1 END, depth + 1, x
  FROM (SELECT *, varying[floor({draw(1)} * len(varying))::INT + 1] AS f FROM (
    SELECT *, list_filter(range(1, {d + 1}), lambda i: hi[i] > lo[i]) AS varying FROM (
      SELECT *, {lows} AS lo, {highs} AS hi, count(*) OVER w AS n FROM grown WHERE depth < {limit} WINDOW w AS (PARTITION BY tree, node)))
    WHERE n > 1 AND len(varying) > 0)),
box AS (SELECT tree, node, any_value(depth) AS depth, count(*) AS n, [{', '.join(f'min(x[{i + 1}])' for i in range(d))}] AS lo,
  [{', '.join(f'max(x[{i + 1}])' for i in range(d))}] AS hi FROM grown GROUP BY tree, node),
cuts AS (SELECT *, CASE WHEN depth < {limit} AND n > 1 AND len(varying) > 0 THEN varying[floor({draw(1)} * len(varying))::INT + 1] END AS f
  FROM (SELECT *, list_filter(range(1, {d + 1}), lambda i: hi[i] > lo[i]) AS varying FROM box)),
nodes AS MATERIALIZED (SELECT tree, node, f, lo[f] + {draw(9)} * (hi[f] - lo[f]) AS cut, CASE WHEN f IS NULL THEN depth + {path.format(n='n')} ELSE 0 END AS depth FROM cuts)"""
    if nodes:
        return grown + """ SELECT tree, node::BIGINT AS node, coalesce(f - 1, -1)::BIGINT AS feature, coalesce(cut, 0) AS cut,
  CASE WHEN f IS NULL THEN -1 ELSE 2 * node END::BIGINT AS "left", CASE WHEN f IS NULL THEN -1 ELSE 2 * node + 1 END::BIGINT AS "right", depth FROM nodes"""
    return grown + f""", walk AS (
  SELECT {ids}, x, tree, 1 AS node FROM src, (SELECT unnest(range({trees})) AS tree)
  UNION ALL
  SELECT {ids}, x, tree, CASE WHEN x[f] <= cut THEN 2 * node ELSE 2 * node + 1 END FROM walk JOIN nodes USING (tree, node) WHERE f IS NOT NULL),
s AS (SELECT {ids}, pow(2, -sum(depth) / {trees} / (SELECT {path.format(n=f'least({size}, count(*))')} FROM src)) AS score
  FROM walk JOIN nodes USING (tree, node) WHERE f IS NULL GROUP BY ALL)
SELECT *, CASE WHEN score > (SELECT quantile_cont(score, 0.95) FROM s) THEN -1 ELSE 1 END::BIGINT AS label FROM s"""


def axis_sql(name: str, matrix: str) -> str:
    """Leading unit eigenvector ``u`` of a symmetric matrix of lists: squared again and again, only its projector is left."""
    return f"""{name}_p AS (SELECT 0 AS k, a FROM {matrix} UNION ALL
  SELECT k + 1, list_transform(a, lambda r: list_transform(a, lambda s:
    list_dot_product(r, s) / list_sum(list_transform(a, lambda t: list_dot_product(t, t))))) FROM {name}_p WHERE k < 14),
{name}_r AS (SELECT list_transform(r, lambda x: x / sqrt(list_dot_product(r, r))) AS u FROM (
  SELECT unnest(a) AS r FROM {name}_p WHERE k = 14) ORDER BY list_dot_product(r, r) DESC LIMIT 1),
{name} AS (SELECT CASE WHEN list_max(u) >= -list_min(u) THEN u ELSE list_transform(u, lambda x: -x) END AS u FROM {name}_r)"""


PCA_SQL = f"""WITH RECURSIVE {VECTORS_SQL},
c AS MATERIALIZED (SELECT vec_id, [{', '.join(f'{c} - avg({c}) OVER ()' for c in VECTOR)}] AS x FROM v),
m1 AS MATERIALIZED (SELECT list(r ORDER BY i) AS a FROM (SELECT i, list(s ORDER BY j) AS r FROM (
  SELECT i, j, sum(x[i] * x[j]) AS s FROM c, (SELECT unnest(range(1, {len(VECTOR) + 1})) AS i), (SELECT unnest(range(1, {len(VECTOR) + 1})) AS j)
  GROUP BY 1, 2) GROUP BY 1)),
{axis_sql('first', 'm1')},
m2 AS MATERIALIZED (SELECT list_transform(a, lambda r, i: list_transform(r, lambda s, j: s - l * u[i] * u[j])) AS a FROM (
  SELECT a, u, list_dot_product(u, list_transform(a, lambda r: list_dot_product(r, u))) AS l FROM m1, first)),
{axis_sql('second', 'm2')}
SELECT vec_id, list_dot_product(x, first.u) AS pc1, list_dot_product(x, second.u) AS pc2 FROM c, first, second"""
PROFILE_SQL = f"WITH {VECTORS_SQL} " + " UNION ALL ".join(
    f"""SELECT CAST(label AS BIGINT) AS cluster, '{c}' AS "column", count(*) AS size, avg({c}) AS mean, stddev_samp({c}) AS std,
  min({c}) AS min, max({c}) AS max, quantile_cont({c}, 0.5) AS median,
  count(*) * 100.0::DOUBLE / (SELECT count(*) FROM v) AS pct FROM v GROUP BY 1""" for c in VECTOR)
QUALITY_SQL = f"""WITH {VECTORS_SQL}, g AS (SELECT label, count(*) AS n, [{', '.join(f'avg({c})' for c in VECTOR)}] AS m FROM v GROUP BY 1),
o AS (SELECT [{', '.join(f'avg({c})' for c in VECTOR)}] AS m, count(*) AS n FROM v),
w AS (SELECT v.label, sum(pow(list_distance({X}, m), 2)) AS ss, avg(list_distance({X}, m)) AS sc FROM v JOIN g USING (label) GROUP BY 1),
b AS (SELECT sum(g.n * pow(list_distance(g.m, o.m), 2)) AS bs, count(*) AS k, any_value(o.n) AS n FROM g, o),
d AS (SELECT a.label, max((wa.sc + wb.sc) / list_distance(a.m, z.m)) AS r FROM g AS a JOIN g AS z ON a.label <> z.label
  JOIN w AS wa ON wa.label = a.label JOIN w AS wb ON wb.label = z.label GROUP BY 1),
pair AS (SELECT p.vec_id, p.label, q.label AS other, sum(pow(list_distance(p.x, q.x), 2)) AS s, count(*) AS n
  FROM (SELECT vec_id, label, {X} AS x FROM v) AS p JOIN (SELECT label, {X} AS x FROM v) AS q ON true GROUP BY 1, 2, 3),
ab AS (SELECT vec_id, max(CASE WHEN label = other THEN s / (n - 1) END) AS a, min(CASE WHEN label <> other THEN s / n END) AS b
  FROM pair GROUP BY 1)
SELECT (SELECT avg((b - a) / greatest(a, b)) FROM ab) AS silhouette,
  (SELECT bs * (n - k) / ((SELECT sum(ss) FROM w) * (k - 1)) FROM b) AS calinski_harabasz,
  (SELECT avg(r) FROM d) AS davies_bouldin, (SELECT k FROM b) AS n_clusters"""


def lloyd_sql(features, last: int, rounds: int = 100) -> str:
    """Farthest-first starts and rounds of k-means for k = 2..last over ``pts`` (x), ending in ``km`` (k, c)."""
    mean = "[" + ", ".join(f"avg(x[{i + 1}])" for i in range(len(features))) + "]"
    return f"""mean AS (SELECT {mean} AS m FROM pts),
ff AS (SELECT 1 AS i, [arg_max(x, list_distance(x, m))] AS c FROM pts, mean
  UNION ALL
  SELECT i + 1, list_append(any_value(c), arg_max(x, list_min(list_transform(c, lambda q: list_distance(x, q))))) FROM ff, pts WHERE i < {last} GROUP BY i),
rounds AS (
  SELECT k, 0 AS r, c[1:k] AS c FROM ff, (SELECT unnest(range(2, {last + 1})) AS k) WHERE i = {last}
  UNION ALL
  SELECT k, r + 1, list(u ORDER BY j) FROM (
    SELECT k, r, j, {mean} AS u FROM (
      SELECT k, r, x, list_position(d, list_min(d)) AS j FROM (
        SELECT k, r, x, list_transform(c, lambda q: list_distance(x, q)) AS d FROM rounds, pts WHERE r < {rounds})) GROUP BY k, r, j) GROUP BY k, r),
km AS MATERIALIZED (SELECT k, c FROM rounds WHERE r = {rounds})"""


DAYS = (f"days AS (SELECT subject, day, {', '.join(f'({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}' for c in DAILY_FEATURES)} "
        f"FROM daily WHERE {' AND '.join(f'{c} IS NOT NULL' for c in DAILY_FEATURES)})")
#: The same, with 0 in columns without spread, as ``impute.standardize`` has it.
FLAT_DAYS = ("days AS (SELECT subject, day, " + ", ".join(
    f"CASE WHEN max({c}) OVER () > min({c}) OVER () THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () ELSE 0 END AS {c}" for c in DAILY_FEATURES)
    + f" FROM daily WHERE {' AND '.join(f'{c} IS NOT NULL' for c in DAILY_FEATURES)})")
DAY_X = "[" + ", ".join(DAILY_FEATURES) + "]"
KMEANS_SQL = f"""WITH RECURSIVE {inputs.SUBJECT_DAILY_SQL}, {FLAT_DAYS}, pts AS MATERIALIZED (SELECT subject, day, {DAY_X} AS x FROM days),
{lloyd_sql(DAILY_FEATURES, 3)}
SELECT subject, day, list_position(list_transform(c, lambda q: list_distance(x, q)), list_min(list_transform(c, lambda q: list_distance(x, q)))) - 1::BIGINT AS cluster
FROM pts, km WHERE k = 3"""
_KM_QUALITY = """a AS MATERIALIZED (SELECT k, x, d, list_position(d, list_min(d)) AS j FROM (
  SELECT k, x, list_transform(c, lambda q: list_distance(x, q)) AS d FROM km, pts)),
n AS MATERIALIZED (SELECT k, j, count(*) AS n, sum(pow(d[j], 2)) AS ss, avg(d[j]) AS far, any_value(c[j]) AS u FROM a JOIN km USING (k) GROUP BY k, j),
l AS (SELECT k, list(n ORDER BY j) AS n, list(ss / n ORDER BY j) AS s FROM n GROUP BY k),
m AS (SELECT k, j, n, list_transform(d, lambda q, i: pow(q, 2) + s[i]) AS e FROM a JOIN l USING (k)),
ab AS (SELECT k, n[j] AS own, e[j] * n[j] / greatest(n[j] - 1, 1) AS a, list_min(list_filter(e, lambda q, i: i <> j)) AS b FROM m),
sil AS (SELECT k, avg(CASE WHEN own > 1 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END) AS silhouette FROM ab GROUP BY k),
ch AS (SELECT k, sum(n * pow(list_distance(u, m), 2)) * (sum(n) - k) / (sum(ss) * (k - 1)) AS calinski_harabasz, sum(ss) AS inertia FROM n, mean GROUP BY k),
db AS (SELECT k, avg(r) AS davies_bouldin FROM (SELECT p.k, p.j, max((p.far + q.far) / list_distance(p.u, q.u)) AS r FROM n AS p JOIN n AS q
  ON p.k = q.k AND p.j <> q.j GROUP BY ALL) GROUP BY k)"""
CLUSTER_QUALITY_SQL = f"""WITH RECURSIVE {VECTORS_SQL}, pts AS MATERIALIZED (SELECT {X} AS x FROM v), {lloyd_sql(VECTOR, 3)}, {_KM_QUALITY}
SELECT silhouette, calinski_harabasz, davies_bouldin, k AS n_clusters FROM sil JOIN ch USING (k) JOIN db USING (k) WHERE k = 3"""
CHOOSE_K_SQL = f"""WITH RECURSIVE {VECTORS_SQL}, pts AS MATERIALIZED (SELECT {X} AS x FROM v), {lloyd_sql(VECTOR, 10)}, {_KM_QUALITY},
q AS (SELECT k, silhouette, calinski_harabasz, davies_bouldin, inertia, lead(inertia, 2) OVER w - 2 * lead(inertia) OVER w + inertia AS bend
  FROM sil JOIN ch USING (k) JOIN db USING (k) WINDOW w AS (ORDER BY k))
SELECT k, silhouette, calinski_harabasz, davies_bouldin, inertia, list_filter([
  CASE WHEN k = (SELECT arg_max(k, silhouette) FROM q) THEN 'silhouette' END, CASE WHEN k = (SELECT arg_max(k, calinski_harabasz) FROM q) THEN 'calinski_harabasz' END,
  CASE WHEN k = (SELECT arg_min(k, davies_bouldin) FROM q) THEN 'davies_bouldin' END, CASE WHEN k = (SELECT arg_max(k, bend) FROM q) THEN 'elbow' END],
  lambda x: x IS NOT NULL) AS chosen_by FROM q"""
_PROFILES = f"""WITH RECURSIVE {VECTORS_SQL}, pts AS MATERIALIZED (SELECT *, {X} AS x FROM v), {lloyd_sql(VECTOR, 3)},
w AS MATERIALIZED (SELECT * REPLACE (list_position(list_transform(c, lambda q: list_distance(x, q)),
  list_min(list_transform(c, lambda q: list_distance(x, q)))) - 1::BIGINT AS label) FROM pts, km WHERE k = 3),
profiles AS (""" + " UNION ALL ".join(
    f"""SELECT label AS cluster, '{c}' AS "column", count(*) AS size, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max,
  quantile_cont({c}, 0.5) AS median, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM v) AS pct FROM w GROUP BY 1""" for c in VECTOR) + ")"
KMEANS_PROFILE_SQL = _PROFILES + " SELECT * FROM profiles"
IMPORTANCE_SQL = _PROFILES + """, i AS (SELECT "column", var_pop(mean) AS variance FROM profiles GROUP BY 1)
SELECT "column", variance / max(variance) OVER () AS importance FROM i"""
DBSCAN_SQL = f"""WITH RECURSIVE {inputs.SUBJECT_DAILY_SQL}, {FLAT_DAYS}, pts AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {DAY_X}, subject, day) AS id, subject, day, {DAY_X} AS x FROM days),
near AS MATERIALIZED (SELECT a.id, b.id AS o FROM pts AS a JOIN pts AS b ON list_distance(a.x, b.x) <= 0.5),
core AS MATERIALIZED (SELECT id FROM near GROUP BY id HAVING count(*) >= 10),
e AS MATERIALIZED (SELECT near.id, near.o FROM near JOIN core AS a ON a.id = near.id JOIN core AS b ON b.id = near.o),
r AS (SELECT id, id AS root, 0 AS k, true AS moved FROM core UNION ALL
  SELECT id, root, k, bool_or(root < own) OVER () FROM (
    SELECT e.id, min(r.root) AS root, min(r.root) FILTER (e.o = e.id) AS own, any_value(k) + 1 AS k FROM e JOIN r ON r.id = e.o WHERE moved GROUP BY e.id)),
c AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS cluster FROM r WHERE k = (SELECT max(k) FROM r)),
b AS (SELECT near.id, min(cluster) AS cluster FROM near JOIN c ON c.id = near.o WHERE near.id NOT IN (SELECT id FROM core) GROUP BY 1)
SELECT subject, day, coalesce(c.cluster, b.cluster, -1) AS cluster FROM pts LEFT JOIN c USING (id) LEFT JOIN b USING (id)"""


_DAY_ROWS = f"(WITH {inputs.SUBJECT_DAILY_SQL}, {DAYS} SELECT * FROM days)"
ISOLATION_SQL = isolation_sql(_DAY_ROWS, "subject || '|' || day", "subject, day", DAILY_FEATURES)
ISOLATION_NODES_SQL = isolation_sql(_DAY_ROWS, "subject || '|' || day", "subject, day", DAILY_FEATURES, nodes=True)
_VECTOR_ROWS = f"(WITH {VECTORS_SQL} SELECT * FROM v)"
VOTES_SQL = f"""SELECT *, CASE WHEN (isolation_forest = 1)::INT + (local_outlier_factor = 1)::INT + (mahalanobis = 1)::INT > 1.5 THEN 1 ELSE -1 END::BIGINT AS ensemble FROM (
  SELECT vec_id, a.label AS isolation_forest, b.label AS local_outlier_factor, c.label AS mahalanobis
  FROM ({isolation_sql(_VECTOR_ROWS, "vec_id", "vec_id", VECTOR)}) AS a JOIN ({LOF_SQL}) AS b USING (vec_id)
  JOIN ({mahalanobis_sql(_VECTOR_ROWS, "vec_id", VECTOR)}) AS c USING (vec_id))"""
RATES_SQL = f"""SELECT detector, count(*) FILTER (label = -1) AS n_anomalies, count(*) FILTER (label = 1) AS n_normal,
  avg((label = -1)::INT::DOUBLE) AS anomaly_rate FROM (UNPIVOT ({VOTES_SQL}) ON isolation_forest, local_outlier_factor, mahalanobis, ensemble
  INTO NAME detector VALUE label) GROUP BY detector"""


_D = len(DAILY_FEATURES)
#: Rounds of expectation-maximisation with diagonal covariances from the clusters of k-means, in SQL.
MIXTURE_ROUNDS = 12
MIXTURE_SQL = f"""WITH RECURSIVE {inputs.SUBJECT_DAILY_SQL}, {FLAT_DAYS}, pts AS MATERIALIZED (SELECT subject, day, {DAY_X} AS x FROM days),
{lloyd_sql(DAILY_FEATURES, 3)},
hard AS (SELECT x, list_position(list_transform(c, lambda q: list_distance(x, q)), list_min(list_transform(c, lambda q: list_distance(x, q)))) AS j FROM pts, km WHERE k = 3),
em AS (
  SELECT 0 AS r, list({{'w': w, 'u': u, 'v': v}} ORDER BY j) AS g FROM (
    SELECT j, count(*) / (SELECT count(*) FROM pts)::DOUBLE AS w, [{', '.join(f'avg(x[{i + 1}])' for i in range(_D))}] AS u,
      [{', '.join(f'var_pop(x[{i + 1}]) + 1e-6' for i in range(_D))}] AS v FROM hard GROUP BY j)
  UNION ALL
  SELECT r + 1, list({{'w': w, 'u': u, 'v': v}} ORDER BY j) FROM (
    SELECT r, j, sum(p) / (SELECT count(*) FROM pts)::DOUBLE AS w, [{', '.join(f'sum(p * x[{i + 1}]) / sum(p)' for i in range(_D))}] AS u,
      [{', '.join(f'sum(p * x[{i + 1}] * x[{i + 1}]) / sum(p) - pow(sum(p * x[{i + 1}]) / sum(p), 2) + 1e-6' for i in range(_D))}] AS v
    FROM (SELECT r, x, unnest([1, 2, 3]) AS j, unnest(list_transform(e, lambda q: q / list_sum(e))) AS p FROM (
      SELECT r, x, list_transform(g, lambda q: q.w * exp(-0.5 * list_sum(list_transform(x, lambda v, i: pow(v - q.u[i], 2) / q.v[i] + ln(q.v[i]))))) AS e
      FROM em, pts WHERE r < {MIXTURE_ROUNDS - 1})) GROUP BY r, j) GROUP BY r)
SELECT subject, day, list_position(e, list_max(e)) - 1::BIGINT AS cluster FROM (SELECT subject, day,
  list_transform(g, lambda q: ln(q.w) - 0.5 * list_sum(list_transform(x, lambda v, i: pow(v - q.u[i], 2) / q.v[i] + ln(q.v[i])))) AS e
  FROM em, pts WHERE r = {MIXTURE_ROUNDS - 1})"""
MIXTURE_COVARIANCE_SQL = f"""WITH {VECTORS_SQL}, p AS (SELECT label AS part, i, j, a.x[i] AS x, a.x[j] AS y FROM (SELECT label, {X} AS x FROM v) AS a,
  (SELECT unnest(range(1, {len(VECTOR) + 1})) AS i), (SELECT unnest(range(1, {len(VECTOR) + 1})) AS j)),
f AS MATERIALIZED (SELECT part, i, j, covar_pop(x, y) AS c, count(*) AS n FROM p GROUP BY ALL),
s AS (SELECT part, avg(c) AS c FROM f WHERE i = j GROUP BY part), t AS (SELECT i, j, sum(c * n) / sum(n) AS c FROM f GROUP BY ALL)
SELECT kind, part::BIGINT AS part, i - 1::BIGINT AS i, j - 1::BIGINT AS j, covariance FROM (
  SELECT 'full' AS kind, part, i, j, c AS covariance FROM f
  UNION ALL SELECT 'diag', part, i, j, CASE WHEN i = j THEN c ELSE 0 END FROM f
  UNION ALL SELECT 'spherical', part, i, j, CASE WHEN i = j THEN s.c ELSE 0 END FROM f JOIN s USING (part)
  UNION ALL SELECT 'tied', part, i, j, t.c FROM f JOIN t USING (i, j))"""


def labelled(spark, sf):
    """Embeddings with their given label as the cluster."""
    return clustering.assemble(vectors(spark, sf, even=True), VECTOR).withColumn("cluster", F.col("label").cast("long"))


QUERIES = [
    Query("isolation_forest", lambda s, d: anomaly.isolation_forest(days(s, d), ["subject", "day"], DAILY_FEATURES), ISOLATION_SQL, ("score",)),
    Query("isolation_nodes", lambda s, d: anomaly.isolation_nodes(days(s, d), ["subject", "day"], DAILY_FEATURES), ISOLATION_NODES_SQL, ("cut", "depth")),
    Query("lof", lambda s, d: anomaly.lof(vectors(s, d), ["vec_id"], VECTOR), LOF_SQL, ("score",)),
    Query("mahalanobis", lambda s, d: anomaly.mahalanobis(table(s, d, "lineitem"), LINE_IDS, LINE_NUMBERS),
          mahalanobis_sql("lineitem", "l_orderkey, l_linenumber::BIGINT AS l_linenumber", LINE_NUMBERS).replace(
              "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, sqrt", "SELECT l_orderkey, l_linenumber, sqrt"), ("score",)),
    Query("mahalanobis_vectors", lambda s, d: anomaly.mahalanobis(vectors(s, d), ["vec_id"], VECTOR),
          mahalanobis_sql(_VECTOR_ROWS, "vec_id", VECTOR), ("score",)),
    Query("ensemble_vote", votes, VOTES_SQL),
    Query("detector_rates", lambda s, d: anomaly.detector_rates(
        votes(s, d), ["isolation_forest", "local_outlier_factor", "mahalanobis", "ensemble"]), RATES_SQL, ("anomaly_rate",)),
    Query("pca2", lambda s, d: clustering.pca(vectors(s, d), VECTOR).select("vec_id", "pc1", "pc2"), PCA_SQL, ("pc1", "pc2")),
    Query("label_profile", lambda s, d: clustering.cluster_profiles(labelled(s, d), VECTOR), PROFILE_SQL,
          ("mean", "std", "min", "max", "median", "pct")),
    Query("label_quality", lambda s, d: clustering.clustering_quality(labelled(s, d)), QUALITY_SQL,
          ("silhouette", "calinski_harabasz", "davies_bouldin")),
    Query("kmeans", lambda s, d: clustering.kmeans(days(s, d), DAILY_FEATURES).select("subject", "day", "cluster"), KMEANS_SQL),
    Query("kmeans_profile", lambda s, d: clustering.cluster_profiles(clusters(s, d), VECTOR), KMEANS_PROFILE_SQL, ("mean", "std", "min", "max", "median", "pct")),
    Query("cluster_importance", lambda s, d: clustering.cluster_importance(clustering.cluster_statistics(clusters(s, d), VECTOR)), IMPORTANCE_SQL, ("importance",)),
    Query("gaussian_mixture", lambda s, d: clustering.gaussian_mixture(days(s, d), DAILY_FEATURES, kind="diag", rounds=MIXTURE_ROUNDS, tol=0.0).select(
        "subject", "day", "cluster"), MIXTURE_SQL),
    Query("mixture_covariances", lambda s, d: mixture.mixture_of_labels(vectors(s, d), VECTOR, "label", vectors(s, d).agg(F.max("label")).first()[0] + 1),
          MIXTURE_COVARIANCE_SQL, ("covariance",)),
    Query("mixture_grid", lambda s, d: mixture.compare_mixtures(days(s, d), DAILY_FEATURES, (2, 3, 4))),
    Query("hierarchical", lambda s, d: clustering.hierarchical(days(s, d), DAILY_FEATURES).select(
        "subject", "day", "cluster")),
    Query("dbscan", lambda s, d: clustering.dbscan(days(s, d), DAILY_FEATURES, eps=0.5, min_samples=10).select(
        "subject", "day", "cluster"), DBSCAN_SQL),
    Query("cluster_quality", lambda s, d: clustering.clustering_quality(clusters(s, d)), CLUSTER_QUALITY_SQL,
          ("silhouette", "calinski_harabasz", "davies_bouldin")),
    Query("choose_k", lambda s, d: clustering.choose_k(vectors(s, d), VECTOR), CHOOSE_K_SQL,
          ("silhouette", "calinski_harabasz", "davies_bouldin", "inertia")),
    Query("linear_models", linear_models, linear_sql(), ("train_mse", "train_mae", "train_r2", "test_mse", "test_rmse", "test_mae", "test_r2",
                                                         "cv_mse", "cv_std")),
    Query("sleep_models", sleep_models),
    Query("sleep_forest_importance", sleep_forest),
    Query("trend_summary_missing", lambda s, d: reports.trend_summary(inputs.subject_daily(s, d))["missing"],
          f"WITH {inputs.SUBJECT_DAILY_SQL} SELECT * FROM (" + " UNION ALL ".join(
              f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count, (1 - count({c})::DOUBLE / count(*)) * 100 AS missing_pct,
  count({c}) AS available_count FROM daily""" for c in ("score", "steps", "stress_duration", "resting_heart_rate", "stress_avg",
                                                        "bb_max", "bb_min", "hydration_intake"))
          + ") WHERE missing_pct > 0", ("missing_pct",)),
    Query("quality_recommendations", lambda s, d: reports.quality_report(inputs.subject_daily(s, d))["recommendations"]),
]
