"""Row filters, projections and the two composite feature steps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, SQLTransformer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cashtrail.contract import MODEL_FEATURES, RAW_COLUMNS, SCORING_INPUT, TARGETS
from cashtrail.functions import geo, money, texts, times


class MissingColumns(ValueError):
    """A table lacks columns an operator needs."""


def _has(df: DataFrame, *columns: str) -> bool:
    return set(columns) <= set(df.columns)


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Drop rows holding a null or a NaN anywhere."""
    return df.na.drop("any")


def keep_available(df: DataFrame, columns: Sequence[str] = RAW_COLUMNS) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def require_columns(df: DataFrame, columns: Sequence[str] = SCORING_INPUT) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingColumns(f"missing required columns: {missing}")
    return df


def default_timestamp(df: DataFrame, run_ts: Column) -> DataFrame:
    """Use the time of the run where a row, or the whole table, has no time."""
    stamp = run_ts.cast("timestamp")
    return df.withColumn("timestamp", F.coalesce("timestamp", stamp) if _has(df, "timestamp") else stamp)


def fill_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Replace nulls; a column the table lacks is added with its default."""
    return df.withColumns(
        {c: F.coalesce(F.col(c), F.lit(v)) if _has(df, c) else F.lit(v) for c, v in defaults.items()}
    )


def where_equal(df: DataFrame, column: str, value: object) -> DataFrame:
    """Equality on a column or on a field nested in one."""
    return df.where(F.col(column) == value)


def within_days(df: DataFrame, as_of: Column, days: int, column: str = "timestamp") -> DataFrame:
    """The last ``days`` days up to ``as_of``, both ends included."""
    end = as_of.cast("timestamp")
    return df.where(F.col(column).between(end - F.make_dt_interval(days=F.lit(days)), end))


def mask_phone(df: DataFrame, column: str = "victim_phone", whole: bool = True) -> DataFrame:
    mask = texts.hide_phone if whole else texts.mask_phone_digits
    return df.withColumn(column, mask(F.col(column)))


def add_time_features(df: DataFrame) -> DataFrame:
    stamped = df.withColumns(
        {"hour": times.hour(F.col("timestamp")), "day_of_week": times.day_of_week(F.col("timestamp"))}
    )
    return stamped.withColumns(
        {"is_weekend": times.is_weekend(F.col("day_of_week")), "is_peak_hours": times.is_peak_hours(F.col("hour"))}
    )


def add_distance(df: DataFrame) -> DataFrame:
    ends = ("complaint_lat", "complaint_lng", "predicted_withdrawal_lat", "predicted_withdrawal_lng")
    return df.withColumn("distance_km", geo.haversine_km(*[F.col(c) for c in ends]))


def add_features(df: DataFrame) -> DataFrame:
    """Time, distance and priority columns, each only if its inputs exist."""
    if _has(df, "timestamp"):
        if dict(df.dtypes)["timestamp"] == "string":
            df = df.withColumn("timestamp", times.parse_timestamp(F.col("timestamp")))
        df = add_time_features(df)
    if _has(df, "complaint_lat", "complaint_lng", "predicted_withdrawal_lat", "predicted_withdrawal_lng"):
        df = add_distance(df)
    if _has(df, "risk_score", "amount_lost"):
        df = df.withColumn("alert_priority", money.alert_priority(F.col("risk_score"), F.col("amount_lost")))
    return df


def prepare_complaints(df: DataFrame) -> DataFrame:
    """Raw complaints to clean complaints: one narrow pass over the input."""
    return df.transform(drop_incomplete).transform(keep_available).transform(add_features)


def add_model_features(df: DataFrame) -> DataFrame:
    """Columns only the models use, each only if its inputs exist."""
    added: dict[str, Column] = {}
    if _has(df, "complaint_lat", "complaint_lng", "nearest_atm_lat", "nearest_atm_lng"):
        added["distance_to_atm"] = geo.haversine_km(
            F.col("complaint_lat"), F.col("complaint_lng"), F.col("nearest_atm_lat"), F.col("nearest_atm_lng")
        )
    known = _has(df, "jurisdiction")
    added["high_risk_zone"] = geo.in_high_risk_jurisdiction(F.col("jurisdiction")) if known else F.lit(0)
    if _has(df, "hour"):
        added["is_night_time"] = times.is_night_time(F.col("hour"))
        added["is_business_hours"] = times.is_business_hours(F.col("hour"))
    if _has(df, "amount_lost"):
        added["amount_risk_level"] = money.amount_risk_level(F.col("amount_lost"))
    return df.withColumns(added)


def fit_preprocessor(train: DataFrame, features: Sequence[str] = MODEL_FEATURES) -> PipelineModel:
    """Features as doubles, gaps filled with the training mean, assembled to a vector.

    Gaps are rare here (a band is null where the amount is not positive);
    :func:`cashtrail.operators.neighbours.knn_impute` fills them from similar
    rows beforehand when training.
    """
    casts = ", ".join(f"CAST(`{c}` AS DOUBLE) AS `_{c}`" for c in features)
    return Pipeline(
        stages=[
            SQLTransformer(statement=f"SELECT *, {casts} FROM __THIS__"),
            Imputer(strategy="mean", inputCols=[f"_{c}" for c in features], outputCols=[f"_{c}_filled" for c in features]),
            VectorAssembler(inputCols=[f"_{c}_filled" for c in features], outputCol="features"),
        ]
    ).fit(train)


def drop_working_columns(df: DataFrame, features: Sequence[str] = MODEL_FEATURES) -> DataFrame:
    return df.drop("features", *[f"_{c}" for c in features], *[f"_{c}_filled" for c in features])


def feature_frame(
    df: DataFrame, preprocessor: PipelineModel, targets: Sequence[str] = TARGETS, key: str = "complaint_id"
) -> DataFrame:
    """Key, feature vector and targets of every row, side by side."""
    return preprocessor.transform(df).select(key, "features", *targets)
