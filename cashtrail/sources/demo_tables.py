"""Complaint table derived from the events, customer and nation test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cashtrail.contract import RAW_COLUMNS
from cashtrail.functions import geo, money, risk, times
from cashtrail.operators import lookup

# The complaint type that stands for each event type.
CRIME_OF_EVENT = {
    "purchase": "Digital Payment Fraud",
    "click": "UPI Fraud",
    "error": "Cryptocurrency Fraud",
    "view": "Phishing",
    "signup": "Online Job Fraud",
}
STATUSES = ("New", "Being Checked", "Settled", "Shelved")
CHANNELS = ("web", "hotline", "counter", "partner")
BANKS = ("Harbour Bank", "Meadow Bank", "Summit Bank", "River Bank", "Orchard Bank", "Lantern Bank", "Copper Bank", "Willow Bank")
# City centres a nation's customers are placed around, by nation key modulo 7.
BASE_LATITUDES = (*[point[1] for point in geo.MAJOR_CITY_POINTS], 26.9, 17.4)
BASE_LONGITUDES = (*[point[2] for point in geo.MAJOR_CITY_POINTS], 75.8, 78.5)


def _pick(values: tuple, position: Column) -> Column:
    """The value at a position of a constant array (folded by the planner)."""
    listed = ", ".join(f"'{v}'" if isinstance(v, str) else f"{v!r}D" for v in values)
    return F.get(F.expr(f"array({listed})"), position.cast("int"))


def _case(key: Column, mapping: dict[str, str]) -> Column:
    (first, text), *others = mapping.items()
    chosen = F.when(key == first, text)
    for source, target in others:
        chosen = chosen.when(key == source, target)
    return chosen


_SCHEMAS: dict[str, T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; its footer is read for the schema once per process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int | None = None) -> DataFrame:
    """The events table as a file stream."""
    reader = spark.readStream.schema(table(spark, sf_dir, "events").schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{sf_dir}/events.parq*")


def _reported(events: DataFrame) -> DataFrame:
    """What an event alone tells: no join."""
    event = F.col("event_id")
    amount = (F.col("value").cast("decimal(12,2)") * 2000).cast("double")
    crime = _case(F.col("event_type"), CRIME_OF_EVENT)
    return events.select(
        "event_id",
        "user_id",
        F.format_string("CG2024%06d", event).alias("complaint_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        crime.alias("crime_type"),
        amount.alias("amount_lost"),
        money.urgency_level(amount, crime).alias("urgency_level"),
        F.concat(F.lit("+91-98"), F.lpad(event.cast("string"), 8, "0")).alias("victim_phone"),
        _pick(STATUSES, event % 4).alias("status"),
        _pick(CHANNELS, F.floor(event / 4) % 4).alias("reported_by"),
        F.concat(F.lit("Officer_"), (event % 97 + 1000).cast("string")).alias("investigation_officer"),
        _pick(BANKS, event % 8).alias("bank_involved"),
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complaints without place or risk, for questions that need neither."""
    return _reported(table(spark, sf_dir, "events")).drop("event_id", "user_id")


def complaints(
    spark: SparkSession, sf_dir: str, keep_event_id: bool = False, events: DataFrame | None = None
) -> DataFrame:
    """The 18-column complaint table, of all events or of those given (a stream, say).

    Customers grow with the data, so that join carries no broadcast hint: the
    planner shuffles it at scale and splits a hot user's partition. Nations are
    joined to the customers first, which leaves one join of the events.
    """
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    homes = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).drop("n_nationkey")
    user, event, base = F.col("user_id"), F.col("event_id"), F.col("c_nationkey") % 7
    placed = (
        _reported(table(spark, sf_dir, "events") if events is None else events)
        .join(homes, user == F.col("c_custkey"))
        .withColumns(
            {
                "complaint_city": F.col("n_name"),
                "complaint_state": _pick(tuple(s[0] for s in lookup.STATES), F.col("c_nationkey")),
                "complaint_lat": _pick(BASE_LATITUDES, base) + (user % 21 - 10) / 20.0,
                "complaint_lng": _pick(BASE_LONGITUDES, base) + (user % 13 - 6) / 20.0,
            }
        )
        .withColumns(
            {
                "predicted_withdrawal_lat": F.col("complaint_lat") + (event % 41 - 20) / 100.0,
                "predicted_withdrawal_lng": F.col("complaint_lng") + (event % 37 - 18) / 100.0,
            }
        )
    )
    raw = risk.composite_risk(
        _pick(tuple(s[1] for s in lookup.STATES), F.col("c_nationkey")),
        times.hour(F.col("timestamp")),
        F.col("amount_lost"),
        F.col("crime_type"),
    )
    scored = placed.withColumn("_risk", raw).withColumns(
        {
            "withdrawal_probability": risk.composite_probability(F.col("_risk")),
            "risk_score": risk.composite_score(F.col("_risk")),
        }
    )
    return scored.select(*(["event_id"] if keep_event_id else []), *RAW_COLUMNS)


def gappy_complaints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complaints whose amount is missing for every seventeenth event."""
    rows = complaints(spark, sf_dir, keep_event_id=True)
    amount = F.when(F.col("event_id") % 17 != 0, F.col("amount_lost"))
    return rows.withColumn("amount_lost", amount).drop("event_id")


def damaged_complaints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complaints where a number or the time is missing or no number, by event."""
    rows = complaints(spark, sf_dir, keep_event_id=True)
    event, nan = F.col("event_id"), F.lit(float("nan"))
    return rows.withColumns(
        {
            "amount_lost": F.when(event % 17 == 0, None).when(event % 17 == 1, nan).otherwise(F.col("amount_lost")),
            "complaint_lat": F.when(event % 13 == 0, None).when(event % 13 == 1, nan).otherwise(F.col("complaint_lat")),
            "predicted_withdrawal_lng": F.when(event % 11 == 0, None).when(event % 11 == 1, nan).otherwise(F.col("predicted_withdrawal_lng")),
            "timestamp": F.when(event % 7 != 0, F.col("timestamp")),
        }
    ).drop("event_id")
