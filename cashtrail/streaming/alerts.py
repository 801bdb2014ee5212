"""Complaints in, alerts and notifications out. Stateless: no shuffle, no state store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cashtrail.contract import LIMITS, RAW_SCHEMA, Limits
from cashtrail.operators import scoring
from cashtrail.sources import writers


def read_complaints(
    spark: SparkSession, path: str, file_format: str = "parquet", schema: T.StructType = RAW_SCHEMA
) -> DataFrame:
    """Complaint files as they arrive in a folder."""
    reader = spark.readStream.format(file_format).schema(schema)
    if file_format == "csv":
        reader = reader.option("header", True)
    return reader.load(path)


def raise_alerts(complaints: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Score, keep HIGH, shape as alerts: the batch functions, unchanged."""
    inputs = complaints.drop(*scoring.RESULT_COLUMNS[1:])
    return scoring.alerts(scoring.score(inputs, high=limits.single_high, medium=limits.single_medium))


def store_alerts(alerts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append alerts to a table; the sink's log makes every batch count once."""
    return (
        alerts.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def store_routed(alerts: DataFrame, role: Column, path: str, checkpoint: str) -> StreamingQuery:
    """Append each alert to the folder of its recipient, or of both."""
    return (
        scoring.route(alerts, role)
        .writeStream.format("parquet")
        .partitionBy("recipient")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def store_notifications(alerts: DataFrame, role: Column, path: str, checkpoint: str) -> StreamingQuery:
    """Append to the notification log that batches write to as well."""

    def write(batch: DataFrame, batch_id: int) -> None:
        writers.append_notifications(batch, path)

    return (
        scoring.notifications(alerts, role)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_notifications(spark: SparkSession, path: str) -> DataFrame:
    """The log with each alert once, however often it was written."""
    return spark.read.parquet(path).drop("log_date").dropDuplicates(["alert_id"])


def recipients(spark: SparkSession, path: str, role: str) -> DataFrame:
    """The alerts of one recipient; only that folder is read."""
    return spark.read.parquet(path).where(F.col("recipient") == role)
