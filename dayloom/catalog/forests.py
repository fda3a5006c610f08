"""Queries of forests that are grown by sums, and the same growth in SQL."""

from __future__ import annotations

from functools import lru_cache

from dayloom.catalog import inputs
from dayloom.catalog.base import Query
from dayloom.operators import forest
from dayloom.operators.stats import chronological_split, expanding_folds

FEATURES = ["steps", "stress_avg", "resting_heart_rate", "bb_max", "bb_min", "stress_duration", "hydration_intake"]
KEYS = ["subject", "day"]
TREES, DEPTH, MIN_ROWS, SEED = 10, 6, 2, 42


def _grown(spark, sf):
    days = inputs.subject_daily(spark, sf)
    return forest.grow_forest(days, FEATURES, keys=KEYS, trees=TREES, depth=DEPTH, min_rows=MIN_ROWS, seed=SEED)[0]


def nodes(spark, sf):
    return forest.forest_nodes(spark, _grown(spark, sf))


def importance(spark, sf):
    return forest.forest_importance(nodes(spark, sf), FEATURES)


def grid(spark, sf):
    """Twelve forests, by trees, depth and rows of a leaf, each on three folds and the last fifth of each subject's days."""
    days = inputs.subject_daily(spark, sf).where("score is not null").select(*KEYS, "score", *FEATURES)
    split = chronological_split(days, subject_cols=["subject"])
    folded = expanding_folds(split.where("is_train"), 3, subject_cols=["subject"]).drop("is_train")
    tested = split.where("not is_train").drop("is_train").selectExpr("*", "-1 AS fold")
    return forest.forest_grid(folded.unionByName(tested), FEATURES, keys=KEYS, trees=(10, 20), depths=(4, 7, 10), min_rows=(1, 2))


@lru_cache
def nodes_sql() -> str:
    """A table of rows, one of splits for each level, and the nodes of all levels."""
    columns = ", ".join(f"CAST({c} AS DOUBLE)" for c in FEATURES)
    weight = " + ".join(f"(u >= {limit})::BIGINT" for limit in forest.WEIGHT_LIMITS)
    out = f"""WITH {inputs.SUBJECT_DAILY_SQL},
src AS MATERIALIZED (SELECT row_number() OVER (ORDER BY subject, day) AS rid, [{columns}] AS x,
  CAST(floor(score * {forest.SCALE} + 0.5) AS BIGINT) AS y, md5('{SEED}|' || subject || '|' || day) AS h FROM daily WHERE score IS NOT NULL),
draws AS (SELECT rid, ('0x' || substr(h, 1, 7))::BIGINT AS a, ('0x' || substr(h, 9, 7))::BIGINT AS b FROM src),
long AS (SELECT rid, f, x[f + 1] AS v FROM src, range({len(FEATURES)}) AS r(f)),
ranked AS (SELECT *, count(*) OVER (PARTITION BY f ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last,
  count(*) OVER (PARTITION BY f) AS n FROM long WHERE v IS NOT NULL),
placed AS (SELECT rid, f, v, dense_rank() OVER (PARTITION BY f ORDER BY (last - 1) * {forest.BINS} // n) - 1 AS b FROM ranked),
cuts AS MATERIALIZED (SELECT f, b, max(v) AS cut FROM placed GROUP BY ALL),
binned AS MATERIALIZED (SELECT rid, f, coalesce(b, 0) AS b FROM long LEFT JOIN placed USING (rid, f)),
rows0 AS MATERIALIZED (SELECT rid, tree, 1::BIGINT AS node, w, w * y AS wy FROM (
  SELECT rid, tree, {weight} AS w FROM (
    SELECT rid, t AS tree, (a + (t + 1) * b) % {2**28 - 57} AS u FROM draws, range({TREES}) AS r(t))) JOIN src USING (rid) WHERE w > 0)"""
    for k in range(DEPTH + 1):
        out += f""",
sums{k} AS (SELECT tree, node, f, b, CAST(sum(w) AS BIGINT) AS n, CAST(sum(wy) AS BIGINT) AS s FROM rows{k} JOIN binned USING (rid) GROUP BY ALL),
run{k} AS (SELECT tree, node, f, b, CAST(sum(n) OVER u AS BIGINT) AS nl, CAST(sum(s) OVER u AS BIGINT) AS sl,
  CAST(sum(n) OVER p AS BIGINT) AS n, CAST(sum(s) OVER p AS BIGINT) AS s FROM sums{k}
  WINDOW p AS (PARTITION BY tree, node, f), u AS (PARTITION BY tree, node, f ORDER BY b)),
gain{k} AS (SELECT *, CASE WHEN nl >= {MIN_ROWS} AND n - nl >= {MIN_ROWS} THEN
  sl::DOUBLE * sl::DOUBLE / nl + (s - sl)::DOUBLE * (s - sl)::DOUBLE / (n - nl) - s::DOUBLE * s::DOUBLE / n END AS gain FROM run{k}),
best{k} AS MATERIALIZED (SELECT tree, node, n, s, f, b, gain, {'coalesce(gain > ' + str(forest.MIN_GAIN) + ', false)' if k < DEPTH else 'false'} AS inner_
  FROM gain{k} QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY gain DESC NULLS LAST, f, b) = 1),
rows{k + 1} AS MATERIALIZED (SELECT r.rid, r.tree, 2 * r.node + (x.b > t.b)::BIGINT AS node, r.w, r.wy
  FROM rows{k} AS r JOIN best{k} AS t ON r.tree = t.tree AND r.node = t.node AND t.inner_ JOIN binned AS x ON x.rid = r.rid AND x.f = t.f)"""
    every = " UNION ALL ".join(f"SELECT * FROM best{k}" for k in range(DEPTH + 1))
    return out + f""",
nodes AS (SELECT tree, node, CASE WHEN inner_ THEN e.f ELSE -1 END AS feature, CASE WHEN inner_ THEN cut END AS cut, n AS "rows",
  s::DOUBLE / n / {forest.SCALE} AS mean, CASE WHEN inner_ THEN gain / {forest.SCALE**2} END AS gain FROM ({every}) AS e LEFT JOIN cuts USING (f, b))"""


NODES_SQL = nodes_sql() + " SELECT * FROM nodes"
IMPORTANCE_SQL = nodes_sql() + f""", g AS (SELECT tree, feature, sum(gain) AS g FROM nodes WHERE feature >= 0 GROUP BY ALL),
shares AS (SELECT feature, g / sum(g) OVER (PARTITION BY tree) AS g FROM g), summed AS (SELECT feature, sum(g) AS g FROM shares GROUP BY ALL),
names AS (SELECT i - 1 AS feature, {FEATURES!r}[i] AS name FROM range(1, {len(FEATURES) + 1}) AS r(i))
SELECT name AS feature, coalesce(g, 0) / sum(g) OVER () AS importance FROM names LEFT JOIN summed USING (feature)"""

QUERIES = [
    Query("forest_nodes", nodes, NODES_SQL, ("cut", "mean", "gain"), digits=4),
    Query("forest_importance", importance, IMPORTANCE_SQL, ("importance",)),
    Query("forest_grid", grid),
]
