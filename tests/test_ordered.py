"""Prefix sums over written ranges, and medians by successive histograms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cashtrail.operators import ordered


@pytest.mark.parametrize("ranges", [1, 7, None])
def test_prefix_sums_of_several_keys(spark, ranges):
    rng = np.random.default_rng(2)
    rows = [(k, float(v), int(n)) for k, size in (("a", 400), ("b", 1), ("hot", 900)) for v, n in zip(rng.permutation(size), rng.integers(1, 9, size))]
    counted = ordered.kept(spark.createDataFrame(rows, "key string, v double, n long"))
    got = {(r["key"], r["v"]): (r["n_upto"], r["n_total"]) for r in ordered.running_totals(counted, "key", "v", ["n"], ranges).collect()}
    for key in ("a", "b", "hot"):
        own = sorted((v, n) for k, v, n in rows if k == key)
        upto = np.cumsum([n for _, n in own])
        assert [got[key, v] for v, _ in own] == [(int(u), int(upto[-1])) for u in upto]


def test_no_cut_points_in_the_plan(spark):
    counted = ordered.kept(spark.range(20_000).selectExpr("'k' AS key", "cast(id AS double) AS v", "1L AS n"))
    few, many = (ordered.running_totals(counted, "key", "v", ["n"], n)._jdf.queryExecution().optimizedPlan().toString() for n in (2, 200))
    assert abs(len(few) - len(many)) < 200


@pytest.mark.parametrize("few,cells", [(1, 2), (3, 16), (10_000, 1024)])
def test_medians_of_skewed_values(spark, few, cells):
    rng = np.random.default_rng(8)
    sides = {
        "spread": np.round(rng.lognormal(0, 4, 701), 3),
        "even": np.array([1.0, 2.0, 1e9, 3.0]),
        "one value": np.full(60, 2.5),
        "hot value": np.concatenate([np.full(500, 7.0), rng.normal(7, 3, 301).round(2)]),
        "close": 1.0 + np.arange(9) * 2.0**-52,
        "negative": -rng.random(40).round(4),
    }
    df = spark.createDataFrame([(k, float(v)) for k, values in sides.items() for v in values], "key string, v double")
    df = df.unionByName(spark.createDataFrame([("even", None), ("even", float("nan"))], "key string, v double"))
    got = {r["key"]: r["median"] for r in ordered.exact_medians(df, "key", "v", few, cells).collect()}
    assert got == {k: pytest.approx(float(np.median(v)), rel=1e-15) for k, v in sides.items()}


def test_median_of_nothing(spark):
    assert ordered.exact_medians(spark.createDataFrame([], "key string, v double"), "key", "v").count() == 0
    assert ordered.exact_medians(spark.range(3).select(F.lit("k").alias("key"), F.col("id").alias("v")), "key", "v").first()["median"] == 1.0
