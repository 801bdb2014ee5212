"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from cashtrail.plans import catalog, oracles
from oracle_check import compare, duck

QUERIES, SQL = catalog.queries(), oracles.oracle_sql()
HEAVY = {"model_scores", "learned_ridge_tree_forest", "knn_scores", "adaboost", "run_log"}


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == HEAVY


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, sf_dir, name):
    assert compare(spark, con, sf_dir, name, QUERIES[name], SQL[name]) == ""


@pytest.mark.parametrize("name", ["model_scores", "knn_scores", "adaboost", "run_log"])
def test_model_query_returns_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
