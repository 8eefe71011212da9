"""A cross-section of the registered queries against their SQL on the smallest scale factor."""

import glob
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from kinsight.plans.queries import QUERIES
from oracle.sql import ORACLES

SF = "/root/testdata/sf0.001"
KEYS = ("load_rejects", "upsert_merge", "dim_household", "dim_date", "agg_customer_policy", "sentiment_score",
        "interactions_enriched", "customer_360_enriched", "nba_recommendations", "dq_fk_orphans", "search_bm25",
        "decision_history", "incremental_agg")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(ORACLES) <= set(oracle_sql()) and set(QUERIES) <= set(queries())


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, duck, key):
    got = queries()[key](spark, SF)
    columns = sorted(got.columns)
    result = duck.execute(oracle_sql()[key])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted(repr([row[i] for i in order]) for row in result.fetchall())
    assert sorted(repr(list(r)) for r in got.select(*[f"`{c}`" for c in columns]).collect()) == want


def test_entry_returns_rows(spark):
    assert entry(spark).count() > 0
