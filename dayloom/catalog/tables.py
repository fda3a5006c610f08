"""Queries on whole raw tables: cleaning, typing, column statistics, correlation, schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayloom.catalog import inputs
from dayloom.catalog.base import Query, table
from dayloom.catalog.daily import MINUTES
from dayloom.functions.temporal import duration_minutes, utc_day, wall_clock
from dayloom.operators import daily, impute, prep, quality, stats
from dayloom.sources import schema
from dayloom.sources.tables import read_samples, read_sessions

# order rows with gaps: some cells are missing by rule
GAPPY_SQL = """gappy AS (SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS cust,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price,
  CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 3 END AS third,
  CASE WHEN o_orderkey % 20 = 0 THEN CAST(o_custkey % 10 AS DOUBLE) END AS sparse,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS priority FROM orders)"""
GAPPY_COLUMNS = ("o_orderkey", "cust", "price", "third", "sparse", "priority")
GAPPY_NUMBERS = ("cust", "price", "third", "sparse")
GAPPY = f"WITH {GAPPY_SQL}"


def gappy(spark, sf):
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    return table(spark, sf, "orders").select(
        key, F.col("o_custkey").cast("double").alias("cust"), F.when(key % 7 != 0, price).alias("price"),
        F.when(key % 3 == 0, price / 3).alias("third"),
        F.when(key % 20 == 0, (F.col("o_custkey") % 10).cast("double")).alias("sparse"),
        F.when(key % 2 == 0, F.col("o_orderpriority")).alias("priority"))


def lines(spark, sf):
    return table(spark, sf, "lineitem")


LINE_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def union_sql(columns, template: str) -> str:
    return " UNION ALL ".join(template.replace("{c}", c) for c in columns)


LEVELS_SQL = " ".join(f"WHEN completeness >= {bound} THEN '{name}'" for bound, name in quality.COMPLETENESS_LEVELS)
COMPLETE_SQL = f"""complete AS (SELECT *, CASE {LEVELS_SQL} END AS completeness_level,
  non_null_count >= 50 AS sufficient_for_modeling, completeness >= 0.1 AS adequate_for_analysis FROM (
  {union_sql(GAPPY_COLUMNS, '''SELECT '{c}' AS "column", count({c}) AS non_null_count, count(*) - count({c}) AS null_count,
  count({c})::DOUBLE / count(*) AS completeness FROM gappy''')}))"""

CORR_SQL = "pairs AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) AS n, corr({a}, {b}) AS r "
    f"FROM gappy" for i, a in enumerate(GAPPY_NUMBERS) for b in GAPPY_NUMBERS[i + 1:]) + ")"

RAW_SQL = """raw AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'NA' WHEN event_id % 13 = 0 THEN ''
    WHEN event_id % 17 = 0 THEN 'null' ELSE event_type END AS kind,
  CASE WHEN event_id % 10 = 0 THEN -1.0::DOUBLE ELSE value END AS value,
  CASE WHEN event_id % 19 = 0 THEN 'None' ELSE CAST(user_id AS VARCHAR) END AS who FROM events)"""


def raw(spark, sf):
    e, key = table(spark, sf, "events"), F.col("event_id")
    return e.select(
        key, F.when(key % 11 == 0, "NA").when(key % 13 == 0, "").when(key % 17 == 0, "null")
        .otherwise(F.col("event_type")).alias("kind"),
        F.when(key % 10 == 0, -1.0).otherwise(F.col("value")).alias("value"),
        F.when(key % 19 == 0, "None").otherwise(F.col("user_id").cast("string")).alias("who"))


TEXT_SQL = """texts AS (SELECT event_id, CASE event_id % 8
  WHEN 0 THEN '0' || CAST(user_id % 10 AS VARCHAR) || ':' || CAST(event_id % 60 AS VARCHAR) || ':30'
  WHEN 1 THEN CAST(user_id AS VARCHAR) || ':15' WHEN 2 THEN CAST(value AS VARCHAR) WHEN 3 THEN '  '
  WHEN 4 THEN 'abc' WHEN 5 THEN '1:xx:00' WHEN 6 THEN '1:2:3:4' END AS t FROM events)"""


def texts(spark, sf):
    key, user = F.col("event_id"), F.col("user_id")
    r = key % 8
    return table(spark, sf, "events").select(key, F.when(r == 0, F.concat(
        F.lit("0"), (user % 10).cast("string"), F.lit(":"), (key % 60).cast("string"), F.lit(":30")))
        .when(r == 1, F.concat(user.cast("string"), F.lit(":15"))).when(r == 2, F.col("value").cast("string"))
        .when(r == 3, "  ").when(r == 4, "abc").when(r == 5, "1:xx:00").when(r == 6, "1:2:3:4").alias("t"))


ZONED_SQL = """zoned AS (SELECT event_id, CASE event_id % 4
  WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || '+09:00' WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z'
  WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE 'not a time' END AS t FROM events)"""


def zoned(spark, sf):
    r = F.col("event_id") % 4
    return table(spark, sf, "events").select(
        "event_id", F.when(r == 0, F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("+09:00")))
        .when(r == 1, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
        .when(r == 2, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("not a time").alias("t"))


def iqr_sql(sequential: bool) -> str:
    columns, out, source = ("l_extendedprice", "l_tax", "l_quantity"), [], "lineitem"
    for i, c in enumerate(columns):
        base = source if sequential else "lineitem"
        out.append(f"f{i} AS (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM {base}), "
                   f"t{i} AS (SELECT t.* FROM {source} t, f{i} WHERE {c} IS NULL OR "
                   f"{c} BETWEEN a - 0.5::DOUBLE * (b - a) AND b + 0.5::DOUBLE * (b - a))")
        source = f"t{i}"
    return f"WITH {', '.join(out)} SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity FROM {source}"


def iqr(one_pass):
    def run(spark, sf):
        return prep.iqr_filter(lines(spark, sf), ["l_extendedprice", "l_tax", "l_quantity"], factor=0.5,
                               one_pass=one_pass).select("l_orderkey", "l_linenumber", "l_quantity")
    return run


def twins(spark, sf):
    q = F.col("l_quantity")
    hole = F.when(F.col("l_linenumber") != 2, q)
    return lines(spark, sf).select(
        "l_quantity", q.cast("long").alias("whole"), hole.alias("hole"), hole.alias("hole_again"), "l_tax", "l_discount")


TWIN_COLUMNS = ("l_quantity", "whole", "hole", "hole_again", "l_tax", "l_discount")
TWINS_SQL = """twins AS (SELECT l_quantity, CAST(l_quantity AS BIGINT) AS whole, CASE WHEN l_linenumber <> 2 THEN l_quantity END AS hole,
  CASE WHEN l_linenumber <> 2 THEN l_quantity END AS hole_again, l_tax, l_discount FROM lineitem)"""

# what the payload of events should look like; numbers are whole
EXPECTED_PROPS = {"click": [("k", "bigint"), ("page", "string")], "view": [("k", "BIGINT")], "error": [("k", "string")],
                  "signup": [("k", "bigint")], "refund": [("k", "bigint")]}


def observed_props(spark, sf):
    """Columns and types that occur in the JSON payload of each event type."""
    entries = F.explode(F.map_entries(F.from_json("props", "map<string,string>"))).alias("e")
    value = F.col("e.value")
    kind = F.when(value.rlike(r"^-?\d+$"), "bigint").when(value.try_cast("double").isNotNull(), "double").otherwise("string")
    return (table(spark, sf, "events").select(F.col("event_type").alias("table"), entries)
            .select("table", F.col("e.key").alias("column"), kind.alias("type"))
            .groupBy("table", "column").agg(F.max("type").alias("type")))


DRIFT_SQL = """observed AS (SELECT event_type AS "table", regexp_extract(props, '"([a-z]+)"', 1) AS "column", 'bigint' AS type
  FROM events GROUP BY 1, 2),
expected AS (SELECT * FROM (VALUES ('click', 'k', 'bigint'), ('click', 'page', 'string'), ('view', 'k', 'BIGINT'),
  ('error', 'k', 'string'), ('signup', 'k', 'bigint'), ('refund', 'k', 'bigint')) AS v("table", "column", type)),
drift AS (SELECT "table", CASE WHEN o.type IS NULL THEN 'missing_column' WHEN e.type IS NULL THEN 'extra_column'
    WHEN upper(e.type) <> upper(o.type) THEN 'type_mismatch' END AS kind, "column",
  e.type AS expected_type, o.type AS actual_type FROM expected e FULL JOIN observed o USING ("table", "column"))"""

AUDITED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
           "pages", "benchmark", "labels", "conversations")


def audit(spark, sf):
    return schema.audit_tables(spark, {t: table(spark, sf, t) for t in AUDITED} | {"sleep": None})


def importance(spark, sf):
    """Absolute correlation of each daily column with the score, as an importance."""
    df = inputs.subject_daily(spark, sf)
    renamed = df.withColumnsRenamed({"resting_heart_rate": "rhr", "hydration_intake": "calories_active"})
    return stats.linear_trends(renamed, ["steps", "rhr", "calories_active", "stress_avg"], "score").select(
        F.col("column").alias("feature"), F.abs("r").alias("importance"))


QUERIES = [
    Query("completeness", lambda s, d: quality.completeness(gappy(s, d)).drop("position"),
          f"{GAPPY}, {COMPLETE_SQL} SELECT * FROM complete", ("completeness",)),
    Query("missing_summary", lambda s, d: quality.missing_summary(gappy(s, d), GAPPY_NUMBERS),
          f"{GAPPY} " + union_sql(GAPPY_NUMBERS, """SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count,
  (1 - count({c})::DOUBLE / count(*)) * 100 AS missing_pct, count({c}) AS available_count FROM gappy"""), ("missing_pct",)),
    Query("worst_columns", lambda s, d: quality.worst_columns(gappy(s, d), 3).select("column", "completeness"),
          f"""{GAPPY}, {COMPLETE_SQL} SELECT "column", completeness FROM complete ORDER BY completeness, "column" LIMIT 3""",
          ("completeness",)),
    Query("column_domains", lambda s, d: quality.column_domains(inputs.subject_daily(s, d)).select(
        "column", "domain", "non_null_count"),
          f"WITH {inputs.SUBJECT_DAILY_SQL} " + " UNION ALL ".join(
              f"""SELECT '{c}' AS "column", '{k}' AS domain, count({c}) AS non_null_count FROM daily""" for c, k in (
                  ("subject", "other"), ("day", "other"), ("score", "other"), ("steps", "activity"),
                  ("stress_duration", "stress"), ("resting_heart_rate", "heart_rate"), ("stress_avg", "stress"),
                  ("bb_max", "other"), ("bb_min", "other"), ("hydration_intake", "nutrition")))),
    Query("dataset_profile", lambda s, d: quality.dataset_profile(table(s, d, "orders").withColumn(
        "o_totalprice", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")))),
          """SELECT count(*) AS rows, 6::BIGINT AS columns, count(*) * 6 AS cells,
  count(CASE WHEN o_orderkey % 7 = 0 THEN 1 END)::DOUBLE / (count(*) * 6) AS missing_share, 3::BIGINT AS numeric_columns,
  2::BIGINT AS text_columns, min(o_orderdate)::DATE AS first_day, max(o_orderdate)::DATE AS last_day,
  date_diff('day', min(o_orderdate), max(o_orderdate)) AS duration_days, count(DISTINCT o_orderdate::DATE) AS distinct_days
FROM orders""", ("missing_share",)),
    Query("outliers_3iqr", lambda s, d: quality.extreme_outliers(table(s, d, "events").withColumn(
        "squared", F.col("value") * F.col("value")), ["value", "squared", "user_id"]),
          "WITH e AS (SELECT value, value * value AS squared, user_id FROM events) " + union_sql(
              ("value", "squared", "user_id"), """SELECT '{c}' AS "column", n AS "values", a - 3 * (b - a) AS lower_bound,
  b + 3 * (b - a) AS upper_bound, count(*) AS outlier_count, min({c}) AS outlier_min, max({c}) AS outlier_max,
  count(*)::DOUBLE / n AS outlier_share
FROM e, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b, count({c}) AS n FROM e) AS q
WHERE n > 10 AND b > a AND ({c} < a - 3 * (b - a) OR {c} > b + 3 * (b - a)) GROUP BY 1, 2, 3, 4, n"""),
          ("lower_bound", "upper_bound", "outlier_min", "outlier_max", "outlier_share")),
    Query("duplicate_columns", lambda s, d: quality.duplicate_columns(twins(s, d)),
          f"WITH {TWINS_SQL} " + " UNION ALL ".join(
              f"SELECT '{a}' AS column_a, '{b}' AS column_b FROM twins HAVING bool_and({a} IS NOT DISTINCT FROM {b})"
              for i, a in enumerate(TWIN_COLUMNS) for b in TWIN_COLUMNS[i + 1:])),
    Query("text_issues", lambda s, d: quality.text_issues(inputs.sessions(s, d), ["activity_id", "sport", "elapsed_time"]),
          f"WITH {inputs.SESSIONS_SQL} " + union_sql(("activity_id", "sport", "elapsed_time"), """SELECT '{c}' AS "column",
  count({c}) AS non_null_count, count(CASE WHEN regexp_matches({c}, ':|AM|PM|am|pm') THEN 1 END) AS time_like,
  count(TRY_CAST({c} AS DOUBLE)) AS numeric_like, count(CASE WHEN regexp_matches({c}, ':|AM|PM|am|pm') THEN 1 END) > 0 AS has_time_strings,
  count(TRY_CAST({c} AS DOUBLE)) > 0 AND count(TRY_CAST({c} AS DOUBLE)) < count({c}) AS mixed_types FROM sessions""")),
    Query("modeling_suitability", lambda s, d: quality.modeling_suitability(gappy(s, d).withColumnsRenamed(
        {"price": "price_score", "third": "active_time"})),
          f"""{GAPPY}, {COMPLETE_SQL}, named AS (SELECT CASE "column" WHEN 'price' THEN 'price_score' WHEN 'third' THEN 'active_time'
  ELSE "column" END AS "column", completeness, sufficient_for_modeling AS ok FROM complete)
SELECT "column", completeness, unnest(CASE WHEN NOT ok OR "column" = 'priority' THEN ['unsuitable']
  WHEN "column" = 'active_time' THEN ['time_series'] WHEN "column" = 'price_score' THEN ['predictive_modeling']
  ELSE ['anomaly_detection', 'clustering', 'predictive_modeling'] END) AS task FROM named""", ("completeness",)),
    Query("impute_median", lambda s, d: impute.impute(gappy(s, d), ["price", "sparse"], "median").select(
        "o_orderkey", "price", "sparse"),
          f"""{GAPPY} SELECT o_orderkey, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM gappy)) AS price,
  coalesce(sparse, (SELECT quantile_cont(sparse, 0.5) FROM gappy)) AS sparse FROM gappy""", ("price", "sparse")),
    Query("impute_mean", lambda s, d: impute.impute(gappy(s, d), ["price", "sparse"], "mean").select(
        "o_orderkey", "price", "sparse"),
          f"""{GAPPY} SELECT o_orderkey, coalesce(price, (SELECT avg(price) FROM gappy)) AS price,
  coalesce(sparse, (SELECT avg(sparse) FROM gappy)) AS sparse FROM gappy""", ("price", "sparse")),
    Query("impute_drop", lambda s, d: impute.impute(gappy(s, d), ["price", "third"], "drop").select("o_orderkey", "price"),
          f"{GAPPY} SELECT o_orderkey, price FROM gappy WHERE price IS NOT NULL AND third IS NOT NULL"),
    Query("impute_advice", lambda s, d: impute.recommend_imputation(
        gappy(s, d).join(table(s, d, "events").select(F.col("event_id").alias("o_orderkey"), "value"), "o_orderkey", "left"),
        ["price", "sparse", "value"]),
          f"""{GAPPY}, w AS (SELECT * FROM gappy LEFT JOIN (SELECT event_id AS o_orderkey, value FROM events) USING (o_orderkey)),
s AS ({union_sql(("price", "sparse", "value"), '''SELECT '{c}' AS "column", count({c}) AS n, skewness({c}) AS skew, avg({c}) AS m,
  stddev_samp({c}) AS d, min({c}) AS low, max({c}) AS high FROM w''')})
SELECT "column", n, skew, d > 0 AND (low < m - 3 * d OR high > m + 3 * d) AS has_outliers,
  CASE WHEN n = 0 THEN 'drop' WHEN d > 0 AND (low < m - 3 * d OR high > m + 3 * d) OR abs(skew) > 1 THEN 'median'
  ELSE 'mean' END AS strategy FROM s""", ("skew",)),
    Query("standardize", lambda s, d: impute.standardize(lines(s, d), ["l_quantity", "l_discount"]).select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount"),
          """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS l_quantity,
  (l_discount - avg(l_discount) OVER ()) / stddev_pop(l_discount) OVER () AS l_discount FROM lineitem""",
          ("l_quantity", "l_discount")),
    Query("robust_scale", lambda s, d: impute.robust_scale(lines(s, d), ["l_quantity", "l_extendedprice"]).select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"),
          """WITH q AS (SELECT quantile_cont(l_quantity, [0.25, 0.5, 0.75]) AS a, quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS b
  FROM lineitem)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, (l_quantity - a[2]) / (a[3] - a[1]) AS l_quantity,
  (l_extendedprice - b[2]) / (b[3] - b[1]) AS l_extendedprice FROM lineitem, q""", ("l_quantity", "l_extendedprice")),
    Query("placeholder_clean", lambda s, d: prep.blank_placeholders(raw(s, d)),
          f"""WITH {RAW_SQL} SELECT event_id, CASE WHEN kind NOT IN ('', 'NA', 'null', 'None') THEN kind END AS kind,
  CASE WHEN value <> -1 THEN value END AS value, CASE WHEN who NOT IN ('', 'NA', 'null', 'None') THEN who END AS who FROM raw"""),
    Query("clean_table", lambda s, d: prep.clean(raw(s, d).withColumnsRenamed({"kind": " Event Kind "})),
          f"""WITH {RAW_SQL} SELECT event_id, CASE WHEN kind NOT IN ('', 'NA', 'null', 'None') THEN kind END AS event_kind,
  CASE WHEN value <> -1 THEN value END AS value,
  TRY_CAST(CASE WHEN who NOT IN ('', 'NA', 'null', 'None') THEN who END AS BIGINT) AS who FROM raw"""),
    Query("iqr_filter", iqr(False), iqr_sql(True)),
    Query("iqr_filter_one_pass", iqr(True), iqr_sql(False)),
    Query("drop_sparse_columns", lambda s, d: prep.drop_sparse_columns(
        gappy(s, d).withColumn("missing_price", F.col("price").isNull()), 0.6),
          f"{GAPPY} SELECT o_orderkey, cust, price, priority FROM gappy"),
    Query("duration_minutes", lambda s, d: texts(s, d).select("event_id", duration_minutes("t").alias("minutes")),
          f"WITH {TEXT_SQL} SELECT event_id, {MINUTES.format('t')} AS minutes FROM texts", ("minutes",)),
    Query("utc_day", lambda s, d: zoned(s, d).select("event_id", utc_day("t").alias("utc_day"), wall_clock("t").alias("wall_clock")),
          f"""WITH {ZONED_SQL}, p AS (SELECT event_id, t, TRY_CAST(replace(left(t, 19), 'T', ' ') AS TIMESTAMP) AS wall_clock FROM zoned)
SELECT event_id, CAST(CASE WHEN t LIKE '%+09:00' THEN wall_clock - INTERVAL 9 HOUR ELSE wall_clock END AS DATE) AS utc_day,
  wall_clock FROM p"""),
    Query("first_element", lambda s, d: prep.first_element(table(s, d, "embeddings"), "embedding").select(
        "vec_id", "embedding"),
          "SELECT vec_id, CAST(CAST(embedding[1] AS VARCHAR) AS DOUBLE) AS embedding FROM embeddings", ("embedding",), 5),
    Query("feature_selection", lambda s, d: s.createDataFrame(
        [(c,) for c in prep.select_features(gappy(s, d), min_values=1000)], "feature string"),
          f"{GAPPY} SELECT * FROM (" + union_sql(("o_orderkey", *GAPPY_NUMBERS),
                                               "SELECT '{c}' AS feature FROM gappy HAVING count({c}) >= 1000") + ")"),
    Query("sample_scan", lambda s, d: read_samples(inputs.samples(s, d), ts="ts", subject_cols=("subject",)).groupBy(
        "subject").agg(F.count("*").alias("n"), F.max("ts").alias("last")),
          "SELECT user_id AS subject, count(*) AS n, max(ts) AS last FROM events WHERE value IS NOT NULL GROUP BY 1"),
    Query("session_scan", lambda s, d: read_sessions(inputs.sessions(s, d)),
          f"WITH {inputs.SESSIONS_SQL} SELECT activity_id, start_time, sport FROM sessions"),
    Query("corr_pairs", lambda s, d: stats.correlation_pairs(gappy(s, d), GAPPY_NUMBERS),
          f"{GAPPY}, {CORR_SQL} SELECT * FROM pairs", ("r",)),
    Query("corr_matrix", lambda s, d: stats.correlation_matrix(stats.correlation_pairs(gappy(s, d), GAPPY_NUMBERS)),
          f"""{GAPPY}, {CORR_SQL} SELECT * FROM pairs UNION ALL SELECT b AS a, a AS b, n, r FROM pairs
UNION ALL SELECT c, c, NULL, 1.0 FROM (VALUES ('cust'), ('price'), ('third'), ('sparse')) AS v(c)""", ("r",)),
    Query("top_correlations", lambda s, d: stats.top_correlations(
        stats.correlation_pairs(gappy(s, d), GAPPY_NUMBERS), threshold=0.01),
          f"{GAPPY}, {CORR_SQL} SELECT * FROM pairs WHERE abs(r) >= 0.01 ORDER BY abs(r) DESC LIMIT 20", ("r",)),
    Query("strongest_correlations", lambda s, d: stats.strongest_correlations(
        stats.correlation_pairs(gappy(s, d), GAPPY_NUMBERS), 2),
          f"""{GAPPY}, {CORR_SQL} (SELECT *, 'positive' AS sign FROM pairs WHERE r > 0 ORDER BY r DESC LIMIT 2)
UNION ALL (SELECT *, 'negative' AS sign FROM pairs WHERE r < 0 ORDER BY r LIMIT 2)""", ("r",)),
    Query("spearman", lambda s, d: stats.spearman_pairs(
        lines(s, d).withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount"))),
        ["l_quantity", "net", "l_tax"]),
          """WITH x AS (SELECT l_quantity, l_extendedprice * (1 - l_discount) AS net, l_tax FROM lineitem),
k AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS a,
  rank() OVER (ORDER BY net) + (count(*) OVER (PARTITION BY net) - 1) / 2.0::DOUBLE AS b,
  rank() OVER (ORDER BY l_tax) + (count(*) OVER (PARTITION BY l_tax) - 1) / 2.0::DOUBLE AS c FROM x)
SELECT 'l_quantity' AS a, 'net' AS b, count(*) AS n, corr(k.a, k.b) AS r FROM k
UNION ALL SELECT 'l_quantity', 'l_tax', count(*), corr(k.a, k.c) FROM k
UNION ALL SELECT 'net', 'l_tax', count(*), corr(k.b, k.c) FROM k""", ("r",)),
    Query("feature_stats", lambda s, d: stats.feature_stats(gappy(s, d), GAPPY_NUMBERS),
          f"{GAPPY} " + union_sql(GAPPY_NUMBERS, """SELECT '{c}' AS "column", count({c}) AS count, avg({c}) AS mean,
  stddev_samp({c}) AS std, var_samp({c}) AS variance, min({c}) AS min, max({c}) AS max, quantile_cont({c}, 0.5) AS median,
  (count(*) - count({c}))::DOUBLE / count(*) * 100 AS missing_pct FROM gappy"""),
          ("mean", "std", "variance", "min", "max", "median", "missing_pct"), 2),
    Query("volatility", lambda s, d: stats.volatility(lines(s, d), LINE_NUMBERS, 3),
          "SELECT * FROM (" + union_sql(LINE_NUMBERS, """SELECT '{c}' AS "column", stddev_samp({c}) AS std FROM lineitem""")
          + ") ORDER BY std DESC LIMIT 3", ("std",)),
    Query("trend_line", lambda s, d: stats.linear_trends(lines(s, d), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"),
          union_sql(("l_quantity", "l_discount", "l_tax"), """SELECT '{c}' AS "column", count(*) AS n,
  regr_slope(l_extendedprice, {c}) AS slope, regr_intercept(l_extendedprice, {c}) AS intercept,
  corr({c}, l_extendedprice) AS r FROM lineitem"""), ("slope", "intercept", "r"), 4),
    Query("importance_by_category", lambda s, d: stats.importance_by_category(importance(s, d)),
          f"""WITH {inputs.SUBJECT_DAILY_SQL}, i AS (SELECT {", ".join(f'''CASE WHEN max({c}) FILTER (score IS NOT NULL) > min({c}) FILTER (score IS NOT NULL)
    AND max(score) FILTER ({c} IS NOT NULL) > min(score) FILTER ({c} IS NOT NULL) THEN abs(corr({c}, score)) END AS {n}''' for c, n in (
      ("steps", "steps"), ("resting_heart_rate", "rhr"), ("hydration_intake", "cal"), ("stress_avg", "stress")))} FROM daily),
t AS (SELECT coalesce(rhr, 0) AS h, coalesce(steps + cal, steps, cal, 0) AS a, list_sum([steps, rhr, cal, stress]) AS total FROM i)
SELECT 'heart_rate' AS category, h AS importance, CASE WHEN total <> 0 THEN h / total END AS share FROM t
UNION ALL SELECT 'activity', a, CASE WHEN total <> 0 THEN a / total END FROM t
UNION ALL SELECT 'other', total - h - a, CASE WHEN total <> 0 THEN (total - h - a) / total END FROM t""", ("importance", "share")),
    Query("table_audit", audit,
          " UNION ALL ".join(f"""SELECT '{t}' AS "table", count(*) AS rows, 'ok' AS status FROM {t}""" for t in AUDITED)
          + """ UNION ALL SELECT 'sleep', NULL, 'not found'"""),
    Query("value_counts", lambda s, d: schema.value_counts(table(s, d, "part"), "p_type"),
          "SELECT p_type, count(*) AS n FROM part GROUP BY 1"),
    Query("schema_drift", lambda s, d: schema.schema_drift(
        schema.schema_from(s, EXPECTED_PROPS), observed_props(s, d)),
          f"WITH {DRIFT_SQL} SELECT * FROM drift WHERE kind IS NOT NULL"),
    Query("preview", lambda s, d: schema.preview(table(s, d, "orders"), ["o_orderkey", "o_totalprice", "absent"], 3)),
]
