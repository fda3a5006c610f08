"""Queries on reports, votes and stored tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from dayloom.catalog import inputs
from dayloom.catalog.base import Query, table
from dayloom.catalog.daily import MANY, SUBJECT, delta_sql
from dayloom.catalog.models import PROFILE_SQL, QUALITY_SQL, VECTOR, labelled
from dayloom.operators import anomaly, clustering, stats
from dayloom.plans import reports
from dayloom.session import ensure_checkpoint_dir
from dayloom.sources import schema, sinks, tables

METRICS = ("steps", "score", "stress_avg", "resting_heart_rate", "bb_max", "bb_min")
NUMBERS = ("score", "steps", "stress_duration", "resting_heart_rate", "stress_avg", "bb_max", "bb_min", "hydration_intake")
SECTIONS = (("sleep_score", "sleep_score_avg", "sleep_score_count", 1, False), ("resting_hr", "rhr_avg", "rhr_count", -1, False),
            ("stress_minutes", "stress_minutes_total", "stress_minutes_count", -1, True))


def weekly_report(spark, sf):
    """The three sections of the weekly report, all weeks."""
    report = reports.weekly_report(inputs.subject_daily(spark, sf), 10_000, subject_cols=SUBJECT)
    out = None
    for name, *_ in SECTIONS:
        one = report[name].withColumn("section", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def given_votes(spark, sf):
    """Three detectors that judge parts by rule."""
    def judged(condition):
        return table(spark, sf, "part").select("p_partkey", F.when(condition, -1).otherwise(1).alias("label"))

    return anomaly.ensemble({"size": judged(F.col("p_size") > 40), "price": judged(F.col("p_retailprice") > 1500),
                             "number": judged(F.col("p_partkey") % 3 == 0)}, ["p_partkey"])


VOTES_SQL = """votes AS (SELECT *, CASE WHEN (CASE WHEN size = 1 THEN 1 ELSE 0 END + CASE WHEN price = 1 THEN 1 ELSE 0 END
    + CASE WHEN number = 1 THEN 1 ELSE 0 END) >= 2 THEN 1 ELSE -1 END::BIGINT AS ensemble FROM (
  SELECT p_partkey, CASE WHEN p_size > 40 THEN -1 ELSE 1 END::BIGINT AS size, CASE WHEN p_retailprice > 1500 THEN -1 ELSE 1 END::BIGINT AS price,
    CASE WHEN p_partkey % 3 = 0 THEN -1 ELSE 1 END::BIGINT AS number FROM part))"""
DETECTORS = ("size", "price", "number", "ensemble")
RATES_SQL = " UNION ALL ".join(
    f"""SELECT '{d}' AS detector, count(CASE WHEN {d} = -1 THEN 1 END) AS n_anomalies, count(CASE WHEN {d} = 1 THEN 1 END) AS n_normal,
  avg(CASE WHEN {d} = -1 THEN 1.0::DOUBLE ELSE 0 END) AS anomaly_rate FROM votes""" for d in DETECTORS)


def given_rates(spark, sf):
    return anomaly.detector_rates(given_votes(spark, sf), DETECTORS)


def recommendations(spark, sf):
    return reports.modeling_recommendations(
        features=stats.feature_stats(inputs.subject_daily(spark, sf), NUMBERS), detectors=given_rates(spark, sf),
        clusterings=clustering.clustering_quality(labelled(spark, sf)))


def stored(spark) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/out-{uuid.uuid4().hex}"


def csv_round_trip(spark, sf):
    """A table written as CSV and scanned with its schema."""
    path, rows = stored(spark), table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    sinks.write_csv(rows, path)
    return tables.read_master_csv(spark, path, rows.schema)


def stored_quality(spark, sf):
    """Quality scores written and read, beside the daily columns."""
    daily, path = inputs.subject_daily(spark, sf), stored(spark)
    sinks.write_quality(daily, path, subject_cols=SUBJECT)
    return sinks.join_quality(daily, tables.read_quality(spark, path, subject_cols=SUBJECT), subject_cols=SUBJECT).select(
        "subject", "day", "steps", "data_quality_score", "coverage_score", "completeness_score", "key_metrics_count", "key_metrics_total")


def built_once(spark, sf):
    """The table is built on the first call and read on the second."""
    path = stored(spark)
    tables.read_or_build(spark, path, lambda: inputs.daily(spark, sf))

    def again():
        raise AssertionError("built twice")

    return tables.read_or_build(spark, path, again).select("day", "steps")


def published(spark, sf):
    sinks.publish(inputs.daily(spark, sf), "published_daily")
    return spark.sql("SELECT count(*) AS days, avg(steps) AS mean_steps FROM published_daily")


def stored_results(spark, sf):
    path = stored(spark)
    sinks.write_results({"regions": table(spark, sf, "region").select("r_regionkey", "r_name")}, path)
    return tables.read_table(spark, f"{path}/regions", table(spark, sf, "region").select("r_regionkey", "r_name").schema, fmt="json")


def bundle(spark, sf):
    """Core tables of a folder that has one of the four; the others are empty."""
    path = stored(spark)
    inputs.daily(spark, sf).select("day", "steps", F.col("hydration_intake").alias("calories_total")).write.parquet(f"{path}/daily_summary.parquet")
    found, out = tables.read_bundle(spark, path), None
    for name in tables.CORE_TABLES:
        one = found[name].agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = [
    Query("weekly_report", weekly_report,
          " UNION ALL ".join(f"SELECT *, '{n}' AS section FROM ({delta_sql(*rest)}) AS s" for n, *rest in SECTIONS), ("value", "delta"), 9),
    Query("trend_summary_volatility", lambda s, d: reports.trend_summary(inputs.subject_daily(s, d), NUMBERS)["volatility"],
          f"{MANY} SELECT * FROM (" + " UNION ALL ".join(
              f"""SELECT '{c}' AS "column", stddev_samp({c}) AS std FROM daily""" for c in NUMBERS) + ") WHERE std IS NOT NULL", ("std",)),
    Query("trend_summary_correlations",
          lambda s, d: reports.trend_summary(inputs.subject_daily(s, d), NUMBERS, threshold=0.02)["correlations"],
          f"{MANY} SELECT * FROM (" + " UNION ALL ".join(
              f"""SELECT '{a}' AS a, '{b}' AS b, count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) AS n, CASE WHEN max({a}) FILTER ({b} IS NOT NULL) > min({a}) FILTER ({b} IS NOT NULL)
  AND max({b}) FILTER ({a} IS NOT NULL) > min({b}) FILTER ({a} IS NOT NULL) THEN corr({a}, {b}) END AS r FROM daily"""
              for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1:]) + ") WHERE abs(r) >= 0.02 ORDER BY abs(r) DESC, a, b LIMIT 20", ("r",)),
    Query("vote_of_given_labels", given_votes, f"WITH {VOTES_SQL} SELECT * FROM votes"),
    Query("rates_of_given_labels", given_rates, f"WITH {VOTES_SQL} {RATES_SQL}", ("anomaly_rate",)),
    Query("label_importance", lambda s, d: clustering.cluster_importance(clustering.cluster_statistics(labelled(s, d), VECTOR)),
          f"""SELECT "column", v / max(v) OVER () AS importance FROM (
  SELECT "column", var_pop(mean) AS v FROM ({PROFILE_SQL}) AS p GROUP BY 1)""", ("importance",)),
    Query("modeling_recommendations", recommendations,
          f"""{MANY}, {VOTES_SQL}, f AS (SELECT count(CASE WHEN gap > 0.3 THEN 1 END) AS gappy FROM (""" + " UNION ALL ".join(
              f"SELECT 1 - count({c})::DOUBLE / count(*) AS gap FROM daily" for c in NUMBERS) + f""")),
r AS ({RATES_SQL})
SELECT 'gappy_features' AS rule, 'medium' AS priority, gappy::DOUBLE AS value FROM f WHERE gappy > 0
UNION ALL SELECT 'anomalies_many', 'high', anomaly_rate FROM r WHERE detector = 'ensemble' AND anomaly_rate > 0.1
UNION ALL SELECT 'anomalies_few', 'low', anomaly_rate FROM r WHERE detector = 'ensemble' AND anomaly_rate < 0.01
UNION ALL SELECT CASE WHEN silhouette < 0.2 THEN 'clusters_overlap' ELSE 'clusters_apart' END,
  CASE WHEN silhouette < 0.2 THEN 'medium' ELSE 'low' END, silhouette FROM ({QUALITY_SQL}) AS q WHERE silhouette < 0.2 OR silhouette > 0.6""",
          ("value",)),
    Query("csv_round_trip", csv_round_trip, "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer", ("c_acctbal",)),
    Query("stored_quality", stored_quality,
          f"""{MANY}, f AS (SELECT subject, day, steps, ({' + '.join(f"CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END" for c in METRICS)})::BIGINT AS n FROM daily)
SELECT subject, day, steps, round_even(25 + 0.5 * n / {len(METRICS)} * 100, 1)::DOUBLE AS data_quality_score, 50.0::DOUBLE AS coverage_score,
  round_even(n::DOUBLE / {len(METRICS)} * 100, 1)::DOUBLE AS completeness_score, n AS key_metrics_count, {len(METRICS)}::BIGINT AS key_metrics_total FROM f""",
          ("steps", "data_quality_score", "coverage_score", "completeness_score")),
    Query("built_once", built_once, f"WITH {inputs.DAILY_SQL} SELECT day, steps FROM daily", ("steps",)),
    Query("published", published, f"WITH {inputs.DAILY_SQL} SELECT count(*) AS days, avg(steps) AS mean_steps FROM daily", ("mean_steps",)),
    Query("stored_results", stored_results, "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region"),
    Query("bundle", bundle, f"""WITH {inputs.DAILY_SQL} SELECT 'daily_summary' AS "table", count(*) AS rows FROM daily
UNION ALL SELECT 'sleep', 0 UNION ALL SELECT 'stress', 0 UNION ALL SELECT 'resting_hr', 0"""),
    Query("preview_ordered", lambda s, d: schema.preview(
        table(s, d, "orders"), ["o_orderkey", "o_totalprice", "absent"], 3, order_by=["o_orderkey"]),
          "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 3", ("o_totalprice",)),
]
