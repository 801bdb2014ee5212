"""The physical plans that matter at scale: what is read, shuffled and broadcast."""

import re

import pytest
from pyspark.sql import functions as F

from cashtrail.operators import analytics, clean, profile, scoring
from cashtrail.plans import catalog
from cashtrail.session import new_folder
from cashtrail.sources import demo_tables


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def read_columns(plan):
    return [set(re.findall(r"(\w+):", found)) for found in re.findall(r"ReadSchema: struct<([^>]*)>", plan)]


@pytest.fixture(scope="module")
def stored(spark, complaints):
    path = new_folder(spark, "plan-complaints")
    complaints.write.parquet(path)
    return spark.read.parquet(path)


def test_scoring_is_narrow(stored):
    inputs = stored.drop(*scoring.RESULT_COLUMNS[1:])
    for df in (scoring.score(inputs), scoring.alerts(scoring.score(inputs)), clean.prepare_complaints(stored)):
        plan = plan_of(df)
        assert "Exchange" not in plan and "Join" not in plan and "Python" not in plan


def test_scans_read_only_what_is_asked(stored):
    (columns,) = read_columns(plan_of(analytics.state_distribution(stored)))
    assert columns == {"complaint_state", "amount_lost", "risk_score"}
    (columns,) = read_columns(plan_of(analytics.bank_incidents(stored)))
    assert columns == {"bank_involved", "amount_lost"}


def test_filters_reach_the_scan(stored):
    plan = plan_of(clean.where_equal(stored, "urgency_level", "High"))
    assert "EqualTo(urgency_level,High)" in plan
    plan = plan_of(clean.within_days(stored, F.lit("2024-01-31"), 7))
    assert "GreaterThanOrEqual(timestamp" in plan


def test_one_partial_aggregate_then_one_exchange(stored):
    for df in (analytics.state_distribution(stored), analytics.bank_incidents(stored), analytics.city_stats(stored)):
        plan = plan_of(df)
        assert plan.count("Exchange hashpartitioning") == 1 and "TakeOrderedAndProject" in plan


def test_top_k_per_group_is_limited_before_the_shuffle(stored):
    plan = plan_of(profile.top_categories(stored))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_total_reuses_the_groups(stored):
    df = analytics.crime_type_analysis(stored)
    df.collect()
    assert "ReusedExchange" in plan_of(df)


def test_growing_tables_are_not_forced_into_a_broadcast(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(demo_tables.complaints(spark, sf_dir, keep_event_id=True))  # not the cached frame
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_no_query_plans_a_cross_join_or_local_checkpoint(spark, sf_dir):
    light = ("state_distribution", "crime_type_analysis", "topk_categories", "weekly_trend", "hourly_distribution")
    for name in light:
        plan = plan_of(catalog.queries()[name](spark, sf_dir))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
