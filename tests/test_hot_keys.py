"""A third of all events belong to one user, one type and one minute: results must not change."""

import duckdb
import pytest

import __spark_entry__ as entry
from oracle_check import compare

NAMES = (
    "state_distribution",
    "city_stats",
    "topk_categories",
    "column_profile",
    "crime_type_analysis",
    "ks_drift",
    "geo_error",
    "heatmap",
    "rolling_heatmap",
    "alert_routing",
    "prediction_log",
    "knn_regress",
)


@pytest.fixture(scope="module")
def hot(sf_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("hot"))
    con = duckdb.connect()
    hot_row = "event_id % 3 = 0"
    con.sql(
        f"""COPY (SELECT event_id, CASE WHEN {hot_row} THEN TIMESTAMP '2024-01-24 10:00:00' + to_microseconds(event_id) ELSE ts END AS ts,
        CASE WHEN {hot_row} THEN (SELECT min(c_custkey) FROM '{sf_dir}/customer.parquet' WHERE c_nationkey = 2) ELSE user_id END AS user_id,
        CASE WHEN {hot_row} THEN 'purchase' ELSE event_type END AS event_type, CASE WHEN {hot_row} THEN 90.5 ELSE value END AS value, props
        FROM '{sf_dir}/events.parquet') TO '{folder}/events.parquet'"""
    )
    for name in ("customer", "nation"):
        con.sql(f"COPY (SELECT * FROM '{sf_dir}/{name}.parquet') TO '{folder}/{name}.parquet'")
    for name in ("events", "customer", "nation"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return folder, con


@pytest.mark.parametrize("name", NAMES)
def test_hot_keys(spark, hot, name):
    folder, con = hot
    assert compare(spark, con, folder, name, entry.queries()[name], entry.oracle_sql()[name]) == ""


def test_hot_user_with_a_shuffled_join(spark, hot):
    """The same with the join shuffled, as it is when customers are too many to broadcast."""
    folder, con = hot
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("state_distribution", "heatmap"):
            assert compare(spark, con, folder, name, entry.queries()[name], entry.oracle_sql()[name]) == ""
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
