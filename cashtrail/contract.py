"""Column contracts, column roles and tunable limits of the complaint tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_STRING, _DOUBLE, _INT = T.StringType(), T.DoubleType(), T.IntegerType()

RAW_SCHEMA = T.StructType(
    [
        T.StructField("complaint_id", _STRING, False),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("crime_type", _STRING),
        T.StructField("amount_lost", _DOUBLE),
        T.StructField("urgency_level", _STRING),
        T.StructField("complaint_city", _STRING),
        T.StructField("complaint_state", _STRING),
        T.StructField("complaint_lat", _DOUBLE),
        T.StructField("complaint_lng", _DOUBLE),
        T.StructField("victim_phone", _STRING),
        T.StructField("predicted_withdrawal_lat", _DOUBLE),
        T.StructField("predicted_withdrawal_lng", _DOUBLE),
        T.StructField("withdrawal_probability", _DOUBLE),
        T.StructField("risk_score", _DOUBLE),
        T.StructField("status", _STRING),
        T.StructField("reported_by", _STRING),
        T.StructField("investigation_officer", _STRING),
        T.StructField("bank_involved", _STRING),
    ]
)

DERIVED_SCHEMA = T.StructType(
    [
        T.StructField("distance_km", _DOUBLE),
        T.StructField("alert_priority", _STRING),
        T.StructField("hour", _INT),
        T.StructField("day_of_week", _INT),
        T.StructField("is_weekend", _INT),
        T.StructField("is_peak_hours", _INT),
    ]
)

CLEAN_SCHEMA = T.StructType(RAW_SCHEMA.fields + DERIVED_SCHEMA.fields)

RAW_COLUMNS = tuple(RAW_SCHEMA.names)
CLEAN_COLUMNS = tuple(CLEAN_SCHEMA.names)

TARGETS = ("withdrawal_probability", "risk_score")

# The numeric columns a model is trained on, after feature engineering.
MODEL_FEATURES = (
    "amount_lost",
    "complaint_lat",
    "complaint_lng",
    "predicted_withdrawal_lat",
    "predicted_withdrawal_lng",
    "distance_km",
    "hour",
    "day_of_week",
    "is_weekend",
    "is_peak_hours",
    "high_risk_zone",
    "is_night_time",
    "is_business_hours",
    "amount_risk_level",
)

# Columns reported by the descriptive profile.
PROFILE_CATEGORIES = (
    "crime_type",
    "urgency_level",
    "complaint_state",
    "status",
    "reported_by",
    "bank_involved",
)
PROFILE_NUMBERS = (
    "risk_score",
    "withdrawal_probability",
    "amount_lost",
    "complaint_lat",
    "complaint_lng",
    "predicted_withdrawal_lat",
    "predicted_withdrawal_lng",
)

# Columns whose mean is compared between a base and a current table; those a
# table lacks are skipped.
DRIFT_COLUMNS = (
    "amount_lost",
    "complaint_lat",
    "complaint_lng",
    "withdrawal_probability",
    "hours_to_withdrawal",
    "atm_distance_km",
    "risk_score",
)

LATITUDE_COLUMNS = ("complaint_lat", "predicted_withdrawal_lat", "nearest_atm_lat")
LONGITUDE_COLUMNS = ("complaint_lng", "predicted_withdrawal_lng", "nearest_atm_lng")

SCORING_INPUT = (
    "complaint_id",
    "crime_type",
    "amount_lost",
    "urgency_level",
    "complaint_city",
    "complaint_lat",
    "complaint_lng",
)

_INPUT_STRUCT = T.StructType(
    [
        T.StructField("complaint_id", _STRING),
        T.StructField("crime_type", _STRING),
        T.StructField("amount_lost", _DOUBLE),
        T.StructField("urgency_level", _STRING),
        T.StructField("complaint_city", _STRING),
        T.StructField("complaint_lat", _DOUBLE),
        T.StructField("complaint_lng", _DOUBLE),
        T.StructField("timestamp", T.TimestampType()),
    ]
)
_PREDICTION_STRUCT = T.StructType(
    [
        T.StructField("predicted_withdrawal_lat", _DOUBLE),
        T.StructField("predicted_withdrawal_lng", _DOUBLE),
        T.StructField("withdrawal_probability", _DOUBLE),
        T.StructField("predicted_hours_to_withdrawal", _INT),
        T.StructField("risk_level", _STRING),
        T.StructField("confidence_score", _DOUBLE),
        T.StructField("alert_radius_km", _DOUBLE),
    ]
)
PREDICTION_LOG_SCHEMA = T.StructType(
    [
        T.StructField("complaint_id", _STRING),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("input_data", _INPUT_STRUCT),
        T.StructField("prediction", _PREDICTION_STRUCT),
        T.StructField("model_version", _STRING),
    ]
)

NOTIFICATION_COLUMNS = (
    "alert_id",
    "complaint_id",
    "alert_type",
    "message",
    "severity",
    "recipient_role",
    "timestamp",
    "status",
)


@dataclass(frozen=True)
class Limits:
    """Every threshold a caller may want to move."""

    # fixed values
    latitude: tuple[float, float] = (6.0, 37.6)
    longitude: tuple[float, float] = (67.7, 97.25)
    drift_ratio: float = 0.05
    drift_p_value: float = 0.05
    high_risk_score: float = 75.0
    single_high: float = 0.7
    single_medium: float = 0.4
    bulk_high: float = 0.8
    bulk_medium: float = 0.5
    correlation_floor: float = 0.1
    expected_r2: float = 0.9
    overfit_gap: float = 0.05
    neighbours: int = 5
    test_share: float = 0.2


LIMITS = Limits()
