"""Queries agree with their SQL where a column of the daily table has no spread."""

import duckdb
import pytest

from conftest import SF_SMALL
from dayloom.catalog import QUERIES
from test_catalog import plain


@pytest.fixture(scope="module")
def flat(tmp_path_factory):
    """Orders of customers whose keys give every day the same resting heart rate, 12 to a day and subject."""
    folder = str(tmp_path_factory.mktemp("flat"))
    duckdb.connect().execute(f"""COPY (SELECT * REPLACE (o_orderkey * 12 + i AS o_orderkey, (o_custkey * 12 + i) * 40 AS o_custkey, o_totalprice * (12 + i) / 12 AS o_totalprice)
  FROM '{SF_SMALL}/orders.parquet', (SELECT unnest(range(12)) AS i)) TO '{folder}/orders.parquet'""")
    return folder


@pytest.mark.parametrize("name", ["dbscan", "gaussian_mixture", "importance_by_category", "kmeans", "trend_summary_correlations"])
def test_query_agrees_with_sql_on_a_flat_column(spark, flat, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{flat}/orders.parquet'")
    got, want = QUERIES[name].frame(spark, flat), con.execute(QUERIES[name].oracle()).df()
    names = sorted(got.columns)
    mine = sorted(tuple(plain(r[c]) for c in names) for r in got.collect())
    theirs = sorted(tuple(plain(v) for v in r) for r in want[names].astype(object).itertuples(index=False, name=None))
    assert mine and mine == theirs
