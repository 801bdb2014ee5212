import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cashtrail import contract
from cashtrail.functions import numbers
from cashtrail.operators import analytics, clean, ordered, profile, quality, splits


def test_contract_names(spark, complaints):
    good = clean.prepare_complaints(complaints)
    assert quality.check_contract(good).ok
    for bad in (good.drop("hour"), good.withColumn("x", F.lit(1)), good.withColumnRenamed("hour", "hr")):
        with pytest.raises(quality.ContractViolation):
            quality.require_contract(bad)
    retyped = good.withColumn("hour", F.col("hour").cast("string"))
    assert quality.check_contract(retyped).names_ok and not quality.check_contract(retyped).ok
    assert quality.missing_targets(good.drop("withdrawal_probability")) == ["withdrawal_probability"]


def test_bounds(spark):
    data = [
        (6.0, 67.7, 0.0, 0.01),
        (37.6, 97.25, 1.0, 1.0),
        (5.999, 70.0, 0.5, 1.0),
        (37.601, 70.0, 0.5, 1.0),
        (None, 70.0, 0.5, 1.0),
        (20.0, float("nan"), 0.5, 1.0),
        (20.0, 70.0, -0.001, 1.0),
        (20.0, 70.0, 1.001, 1.0),
        (20.0, 70.0, None, 1.0),
        (20.0, 70.0, 0.5, 0.0),
        (20.0, 70.0, 0.5, None),
    ]
    df = spark.createDataFrame(
        data, "complaint_lat double, complaint_lng double, withdrawal_probability double, amount_lost double"
    )
    report = quality.content_checks(df).first()
    assert report["complaint_lat_outside"] == 3
    assert report["complaint_lng_outside"] == 1
    assert report["probability_outside"] == 3
    assert report["amount_not_positive"] == 1
    assert not report["ok"]
    kept, held = quality.split_by_quality(df)
    assert kept.count() == 3 and held.count() == 8
    assert held.where(F.size("violations") != 1).count() == 0


def test_mean_drift(spark):
    base = spark.createDataFrame([(0.0, -100.0, 100.0)], "amount_lost double, complaint_lat double, risk_score double")
    now = spark.createDataFrame([(5.0, -105.0, 106.0)], "amount_lost double, complaint_lat double, risk_score double")
    report = {r["column_name"]: r for r in quality.mean_drift(base, now).collect()}
    assert set(report) == {"complaint_lat", "risk_score"}  # a zero base mean is left out
    assert not report["complaint_lat"]["drift_detected"]  # exactly the threshold
    assert report["risk_score"]["drift_detected"]
    assert not quality.no_drift(quality.mean_drift(base, now))
    assert quality.no_drift(quality.mean_drift(base, base))


def _ks(a, b):
    values = np.concatenate([a, b])
    return max(abs((a <= v).mean() - (b <= v).mean()) for v in values)


def test_ks_with_a_hot_value(spark):
    rng = np.random.default_rng(5)
    a = np.where(rng.random(900) < 0.4, 7.0, rng.normal(7, 3, 900))
    b = np.where(rng.random(700) < 0.3, 7.0, rng.normal(8, 3, 700))
    frames = [spark.createDataFrame([(float(x),) for x in side], "v double") for side in (a, b)]
    for buckets in (2, 16, 256):
        row = quality.ks_drift(*frames, buckets=buckets).first()
        assert row["ks_statistic"] == pytest.approx(_ks(a, b), abs=1e-12)
        assert (row["base_rows"], row["current_rows"]) == (900, 700)
        assert row["drift_detected"]
    same = quality.ks_drift(frames[0], frames[0]).first()
    assert same["ks_statistic"] == 0 and same["p_value"] == 1


def test_running_totals_and_medians(spark):
    rng = np.random.default_rng(3)
    for n in (1, 2, 501, 1000):
        values = np.round(rng.exponential(5, n), 2)
        df = spark.createDataFrame([("k", float(v)) for v in values], "key string, v double")
        for buckets in (2, 9):
            assert ordered.exact_medians(df, "key", "v", buckets).first()["median"] == pytest.approx(np.median(values))


def test_drop_incomplete_and_available(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", float("nan"))], "complaint_id string, amount_lost double")
    assert [r[0] for r in clean.drop_incomplete(df).collect()] == ["a"]
    assert clean.keep_available(df.withColumn("extra", F.lit(1))).columns == ["complaint_id", "amount_lost"]
    with pytest.raises(clean.MissingColumns, match="urgency_level"):
        clean.require_columns(df)


def test_features_only_where_inputs_exist(spark):
    df = spark.createDataFrame([("2024-01-06T23:00:00",)], "timestamp string")
    got = clean.add_features(df)
    assert got.columns == ["timestamp", "hour", "day_of_week", "is_weekend", "is_peak_hours"]
    assert tuple(got.first())[1:] == (23, 5, 1, 0)
    bare = clean.add_model_features(spark.createDataFrame([(1,)], "x int"))
    assert bare.columns == ["x", "high_risk_zone"]


def test_clean_schema(complaints):
    got = clean.prepare_complaints(complaints).schema
    assert {f.name: f.dataType for f in got} == {f.name: f.dataType for f in contract.CLEAN_SCHEMA}
    assert isinstance(got["timestamp"].dataType, T.TimestampType)


def test_split_shares(complaints):
    train, test = splits.train_test(complaints)
    total = complaints.count()
    assert train.count() + test.count() == total
    assert test.count() / total == pytest.approx(0.2, abs=0.05)


def test_nan_counts_as_missing(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, 2.0), (3.0, nan), (nan, 4.0), (5.0, 6.0)], "amount_lost double, risk_score double")
    row = profile.numeric_profile(df, ["amount_lost"]).first()
    assert (row["minimum"], row["maximum"], row["mean"], row["nulls"]) == (1.0, 5.0, 3.0, 1)
    columns = {r["column_name"]: r for r in profile.column_profile(df).collect()}
    assert (columns["risk_score"]["nulls"], columns["risk_score"]["unique_values"]) == (1, 3)
    drift = quality.mean_drift(df, df).collect()
    assert {r["column_name"]: r["base_mean"] for r in drift} == {"amount_lost": 3.0, "risk_score": 4.0}
    assert analytics.summary_row(df.withColumn("complaint_state", F.lit("Goa"))).first()["avg_case_value"] == 2.0


def test_exact_sums_keep_small_scores(spark):
    df = spark.createDataFrame([(0.123456,), (0.000001,), (None,)], "risk double")
    assert df.select(numbers.exact_sum(F.col("risk"), numbers.SCORE), numbers.exact_mean(F.col("risk"))).first() == (
        0.123457,
        0.0617285,
    )
