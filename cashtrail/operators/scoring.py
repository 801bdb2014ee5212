"""Withdrawal prediction by rule: one expression for one row, a batch or a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cashtrail.contract import LIMITS, Limits
from cashtrail.functions import draws, geo, money, risk, texts, times
from cashtrail.operators.clean import default_timestamp, require_columns

RESULT_COLUMNS = (
    "complaint_id",
    "predicted_withdrawal_lat",
    "predicted_withdrawal_lng",
    "withdrawal_probability",
    "predicted_hours_to_withdrawal",
    "risk_level",
    "confidence_score",
    "alert_radius_km",
)
PAGE_COLUMNS = (
    "complaint_id",
    "predicted_withdrawal_lat",
    "predicted_withdrawal_lng",
    "withdrawal_probability",
    "risk_level",
)


def rule_probability(ts: str = "timestamp") -> Column:
    stamp = F.col(ts)
    return risk.rule_probability(
        F.col("amount_lost"),
        F.col("urgency_level"),
        times.hour(stamp),
        times.day_of_week(stamp),
        F.col("complaint_lat"),
        F.col("complaint_lng"),
    )


def score(
    df: DataFrame, run_ts: Column | None = None, high: float = LIMITS.single_high, medium: float = LIMITS.single_medium
) -> DataFrame:
    """Add the prediction columns. Narrow: no join, no shuffle, no Python.

    The lead time and the place are draws seeded by the complaint id, so the
    same complaint always gets the same answer.
    """
    require_columns(df)
    if run_ts is not None:
        df = default_timestamp(df, run_ts)
    p, key = F.col("_p"), F.col("complaint_id")
    reach = risk.scatter_degrees(p)
    return (
        df.withColumn("_p", rule_probability())
        .withColumns(
            {
                "predicted_withdrawal_lat": risk.scatter(F.col("complaint_lat"), reach, draws.draw(key, "lat")),
                "predicted_withdrawal_lng": risk.scatter(F.col("complaint_lng"), reach, draws.draw(key, "lng")),
                "withdrawal_probability": F.round(p, 3),
                "predicted_hours_to_withdrawal": risk.hours_from_band(p, draws.draw(key, "hours")),
                "risk_level": risk.risk_level(p, high, medium),
                "confidence_score": F.round(risk.confidence(p), 3),
                "alert_radius_km": risk.rule_radius_km(p),
            }
        )
        .drop("_p")
    )


def single_score(spark: SparkSession, complaint: dict, run_ts: str) -> DataFrame:
    """One request as a one-row table through :func:`score`."""
    schema = (
        "complaint_id string, crime_type string, amount_lost double, urgency_level string, "
        "complaint_city string, complaint_lat double, complaint_lng double, timestamp string"
    )
    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    row = spark.createDataFrame([tuple(complaint.get(c) for c in names)], schema)
    parsed = row.withColumn("timestamp", times.parse_timestamp(F.col("timestamp")))
    return score(parsed, F.lit(run_ts)).select(*RESULT_COLUMNS)


def bulk_score(df: DataFrame, run_ts: Column, limits: Limits = LIMITS) -> DataFrame:
    """Score an uploaded table; the level uses the stricter bulk limits."""
    return score(df, run_ts, limits.bulk_high, limits.bulk_medium)


def high_risk_count(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count(F.lit(1)).alias("processed"), F.count_if(F.col("risk_level") == "HIGH").alias("high_risk_count")
    )


def result_page(scored: DataFrame, rows: int | None = 10) -> DataFrame:
    """Five columns for display: the first rows by id, or all of them."""
    page = scored.select(*PAGE_COLUMNS)
    return page if rows is None else page.orderBy("complaint_id").limit(rows)


def serving_features(df: DataFrame) -> DataFrame:
    """The inputs the serving model is given, which differ from those of training."""
    ts, key = F.col("timestamp"), F.col("complaint_id")
    lat, lng = F.col("complaint_lat"), F.col("complaint_lng")
    near = F.lit(0.005)
    return df.withColumns(
        {
            "nearest_atm_lat": risk.scatter(lat, near, draws.draw(key, "atm_lat")),
            "nearest_atm_lng": risk.scatter(lng, near, draws.draw(key, "atm_lng")),
            "hour": times.hour(ts),
            "day_of_week": times.day_of_week(ts),
        }
    ).withColumns(
        {
            "atm_distance_km": geo.planar_km(lat, lng, F.col("nearest_atm_lat"), F.col("nearest_atm_lng")),
            "is_weekend": times.is_weekend(F.col("day_of_week")),
            "is_peak_hours": times.is_peak_withdrawal(F.col("hour")),
            "is_night_time": times.is_night_time(F.col("hour")),
            "is_business_hours": times.is_business_hours(F.col("hour"), F.col("day_of_week")),
            "amount_risk_level": money.serving_amount_level(F.col("amount_lost")),
            "base_risk": risk.base_risk(F.col("amount_lost"), F.col("urgency_level")),
            "high_risk_zone": geo.in_major_city_box(lat, lng),
            "requires_bank_alert": money.requires_bank_alert(F.col("amount_lost"), F.col("urgency_level")),
        }
    )


def from_model(df: DataFrame, probability: str, limits: Limits = LIMITS) -> DataFrame:
    """Turn a model's probability column into the prediction columns."""
    p = risk.clamp_probability(F.col(probability))
    return df.withColumns(
        {
            "withdrawal_probability": F.round(p, 3),
            "predicted_hours_to_withdrawal": risk.model_hours(F.col(probability)),
            "risk_level": risk.risk_level(p, limits.single_high, limits.single_medium),
            "confidence_score": F.round(risk.confidence(p), 3),
            "alert_radius_km": F.round(risk.model_radius_km(p), 1),
        }
    )


def prediction_log(scored: DataFrame, model_version: str = "rules-1") -> DataFrame:
    """Scored rows as nested log records."""
    inputs = [
        "complaint_id",
        "crime_type",
        "amount_lost",
        "urgency_level",
        "complaint_city",
        "complaint_lat",
        "complaint_lng",
        "timestamp",
    ]
    return scored.select(
        "complaint_id",
        "timestamp",
        F.struct(*inputs).alias("input_data"),
        F.struct(*RESULT_COLUMNS[1:]).alias("prediction"),
        F.lit(model_version).alias("model_version"),
    )


def alerts(scored: DataFrame, level: str = "HIGH") -> DataFrame:
    """Alert rows for the scored complaints of a level."""
    lat, lng = F.col("predicted_withdrawal_lat"), F.col("predicted_withdrawal_lng")
    return scored.where(F.col("risk_level") == level).select(
        texts.alert_id(F.col("complaint_id"), F.col("timestamp")).alias("alert_id"),
        "complaint_id",
        F.lit("high_risk").alias("alert_type"),
        texts.alert_message(lat, lng, F.col("predicted_hours_to_withdrawal")).alias("message"),
        F.create_map(F.lit("lat"), lat, F.lit("lng"), lng).alias("location"),
        "timestamp",
        F.lit("HIGH").alias("severity"),
    )


def route(alerts_df: DataFrame, role: Column) -> DataFrame:
    """One row per recipient: the named role, or both for any other value."""
    both = F.array(F.lit("lea"), F.lit("bank"))
    return alerts_df.withColumn("recipient", F.explode(F.when(role.isin("lea", "bank"), F.array(role)).otherwise(both)))


def notifications(alerts_df: DataFrame, role: Column) -> DataFrame:
    return alerts_df.select(
        "alert_id",
        "complaint_id",
        "alert_type",
        "message",
        "severity",
        role.alias("recipient_role"),
        "timestamp",
        F.lit("pending").alias("status"),
    )


def latest_notifications(log: DataFrame, n: int = 50) -> DataFrame:
    return log.drop("_id").orderBy(F.desc("timestamp"), "alert_id").limit(n)
