"""Sliding windows over the prediction stream.

The stream adds rows up per day; the state holds one row per day and cell. Each
micro-batch hands on the days it changed, open ones included, to a table where the
latest total of a key counts. Windows of any length are added up from the days when
they are read, so they are complete at any time and a row is counted once and not
once per window. Rows later than the watermark are dropped.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cashtrail.functions import geo, numbers
from cashtrail.operators import heatmap

WATERMARK = "1 hour"


def daily_cells(log: DataFrame, digits: int = 2, watermark: str = WATERMARK) -> DataFrame:
    """Sum of probabilities and incidents by day and cell."""
    return (
        log.withWatermark("timestamp", watermark)
        .groupBy(
            F.window("timestamp", "1 day").alias("day"),
            geo.grid_key(F.col("prediction.predicted_withdrawal_lat"), digits).alias("lat"),
            geo.grid_key(F.col("prediction.predicted_withdrawal_lng"), digits).alias("lng"),
        )
        .agg(
            F.sum(F.col("prediction.withdrawal_probability").cast(numbers.SCORE)).alias("p_sum"),
            F.count(F.lit(1)).alias("incidents"),
        )
        .withColumn("day", F.col("day.start"))
    )


def daily_counts(log: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Predictions, and those of a high risk, by day."""
    return (
        log.withWatermark("timestamp", watermark)
        .groupBy(F.window("timestamp", "1 day").alias("day"))
        .agg(
            F.count(F.lit(1)).alias("predictions"),
            F.count_if(F.col("prediction.risk_level") == "HIGH").alias("high_risk"),
        )
        .withColumn("day", F.col("day.start"))
    )


def store_days(days: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the totals that each batch changed; a batch that runs again repeats them."""
    started = time.time_ns()

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumns({"run": F.lit(started), "batch_id": F.lit(batch_id)}).write.mode("append").parquet(path)

    return (
        days.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )


def read_days(spark: SparkSession, path: str, keys: tuple[str, ...]) -> DataFrame:
    """The latest totals of each key."""
    rows = spark.read.parquet(path)
    totals = [c for c in rows.columns if c not in (*keys, "run", "batch_id")]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*totals), F.struct("run", "batch_id")).alias("_latest"))
    return latest.select(*keys, "_latest.*")


def heatmap_windows(spark: SparkSession, path: str, days: int = 30) -> DataFrame:
    totals = read_days(spark, path, ("day", "lat", "lng"))
    summed = heatmap.rolling(totals, days, ("lat", "lng"), ("p_sum", "incidents"))
    risk = F.col("p_sum").cast("double") / F.col("incidents")
    return summed.select("window_start", "lat", "lng", risk.alias("risk_score"), F.col("incidents").alias("incident_count"))


def count_windows(spark: SparkSession, path: str, days: int = 7) -> DataFrame:
    return heatmap.rolling(read_days(spark, path, ("day",)), days, (), ("predictions", "high_risk"))
