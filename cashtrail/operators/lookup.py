"""Reference tables, the joins onto them, and dense spines for charts.

The built-in tables are constants of a few dozen rows, so broadcasting them is
bounded by this file. A table handed in by the caller gets no hint: the planner
broadcasts it only below its size threshold and shuffles it otherwise.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: state, crime factor, latitude range, longitude range
STATES = (
    ("Andhra Pradesh", 0.7, 12.5, 19.5, 77.0, 84.7),
    ("Arunachal Pradesh", 0.2, 26.3, 29.4, 91.7, 97.4),
    ("Assam", 0.5, 24.1, 27.9, 89.7, 96.0),
    ("Bihar", 0.6, 24.2, 27.5, 83.3, 88.1),
    ("Chhattisgarh", 0.4, 17.8, 24.1, 80.2, 84.4),
    ("Goa", 0.3, 15.0, 15.8, 73.7, 74.3),
    ("Gujarat", 0.8, 20.1, 24.7, 68.2, 74.5),
    ("Haryana", 0.9, 27.4, 30.9, 74.5, 77.6),
    ("Himachal Pradesh", 0.2, 30.2, 33.2, 75.6, 79.0),
    ("Jharkhand", 0.6, 21.9, 25.3, 83.3, 87.9),
    ("Karnataka", 0.8, 11.3, 18.4, 74.0, 78.6),
    ("Kerala", 0.5, 8.2, 12.8, 74.8, 77.4),
    ("Madhya Pradesh", 0.7, 21.0, 26.9, 74.0, 82.8),
    ("Maharashtra", 1.0, 15.6, 22.0, 72.6, 80.9),
    ("Manipur", 0.3, 23.8, 25.7, 93.0, 94.8),
    ("Meghalaya", 0.2, 25.0, 26.1, 89.4, 92.8),
    ("Mizoram", 0.1, 21.9, 24.6, 92.2, 93.4),
    ("Nagaland", 0.2, 25.2, 27.0, 93.3, 95.8),
    ("Odisha", 0.5, 17.8, 22.6, 81.3, 87.5),
    ("Punjab", 0.7, 29.4, 32.5, 73.9, 76.9),
    ("Rajasthan", 0.8, 23.0, 30.2, 69.5, 78.2),
    ("Sikkim", 0.1, 27.0, 28.1, 88.0, 88.9),
    ("Tamil Nadu", 0.9, 8.1, 13.6, 76.2, 80.3),
    ("Telangana", 0.9, 15.8, 19.9, 77.2, 81.8),
    ("Tripura", 0.3, 22.9, 24.5, 91.0, 92.7),
    ("Uttar Pradesh", 1.0, 23.9, 30.4, 77.1, 84.6),
    ("Uttarakhand", 0.4, 28.4, 31.4, 77.6, 81.0),
    ("West Bengal", 0.8, 21.8, 27.1, 85.8, 89.9),
    ("Delhi", 1.0, 28.4, 28.9, 76.8, 77.3),
)

# fixed values: crime type, weight, usual amount range
CRIME_TYPES = (
    ("Digital Payment Fraud", 0.35, 50000.0, 500000.0),
    ("UPI Fraud", 0.25, 5000.0, 100000.0),
    ("Credit Card Fraud", 0.15, 20000.0, 300000.0),
    ("Phishing", 0.10, 10000.0, 150000.0),
    ("Cyberstalking", 0.05, 0.0, 25000.0),
    ("Online Job Fraud", 0.05, 15000.0, 200000.0),
    ("Social Media Fraud", 0.03, 5000.0, 75000.0),
    ("Cryptocurrency Fraud", 0.02, 100000.0, 2000000.0),
)

WEEKDAY_LABELS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def _local_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A few constant rows; Arrow input becomes a local relation of known size."""
    return spark.createDataFrame(pa.Table.from_pylist(rows))


def state_table(spark: SparkSession) -> DataFrame:
    return _local_table(
        spark,
        [
            {
                "complaint_state": state,
                "crime_rate_factor": factor,
                "lat_range": {"lo": south, "hi": north},
                "lng_range": {"lo": west, "hi": east},
            }
            for state, factor, south, north, west, east in STATES
        ],
    )


def crime_table(spark: SparkSession) -> DataFrame:
    return _local_table(
        spark,
        [
            {"crime_type": crime, "crime_weight": weight, "usual_amount": {"lo": low, "hi": high}}
            for crime, weight, low, high in CRIME_TYPES
        ],
    )


def with_state_facts(df: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """Left join on the state; rows of unknown states keep nulls."""
    dimension = F.broadcast(state_table(df.sparkSession)) if states is None else states
    return df.join(dimension, "complaint_state", "left")


def with_crime_facts(df: DataFrame, crimes: DataFrame | None = None) -> DataFrame:
    dimension = F.broadcast(crime_table(df.sparkSession)) if crimes is None else crimes
    return df.join(dimension, "crime_type", "left")


def hour_spine(spark: SparkSession) -> DataFrame:
    return spark.range(24).select(F.col("id").cast("int").alias("hour"))


def weekday_spine(spark: SparkSession) -> DataFrame:
    labels = F.array(*[F.lit(x) for x in WEEKDAY_LABELS])
    return spark.range(7).select(
        F.col("id").cast("int").alias("day_of_week"), F.get(labels, F.col("id").cast("int")).alias("label")
    )


def month_spine(spark: SparkSession, as_of: Column, months: int = 12) -> DataFrame:
    """First days of the ``months`` months that end with the month of ``as_of``."""
    last = F.trunc(as_of, "month")
    return spark.range(months).select(F.add_months(last, -F.col("id").cast("int")).alias("month_start"))


def fill_spine(spine: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """Every spine row, with zero where nothing was counted."""
    measures = [c for c in counts.columns if c != key]
    return spine.join(counts, key, "left").na.fill(0, measures)
