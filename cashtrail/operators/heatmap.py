"""Grid heatmap and recent counts over the prediction log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cashtrail.functions import geo, numbers


def _cells(log: DataFrame, digits: int) -> DataFrame:
    return log.select(
        "timestamp",
        geo.grid_key(F.col("prediction.predicted_withdrawal_lat"), digits).alias("lat"),
        geo.grid_key(F.col("prediction.predicted_withdrawal_lng"), digits).alias("lng"),
        F.col("prediction.withdrawal_probability").alias("p"),
        F.coalesce("input_data.complaint_city", F.lit("Unknown")).alias("city"),
    )


def risk_heatmap(log: DataFrame, digits: int = 2) -> DataFrame:
    """Mean probability, incidents and first city of each grid cell.

    Cells are first added up per city, where every running value is a number
    and the aggregate stays a hash aggregate; the first city is then picked
    among the few rows left of each cell.
    """
    by_city = (
        _cells(log, digits)
        .groupBy("lat", "lng", "city")
        .agg(
            F.sum(F.col("p").cast(numbers.SCORE)).alias("p_sum"),
            F.count("p").alias("p_rows"),
            F.count(F.lit(1)).alias("rows"),
            F.min("timestamp").alias("first_seen"),
        )
    )
    return by_city.groupBy("lat", "lng").agg(
        (F.sum("p_sum").cast("double") / F.sum("p_rows")).alias("risk_score"),
        F.sum("rows").alias("incident_count"),
        F.min_by("city", F.struct("first_seen", "city")).alias("city"),
    )


def daily_cells(log: DataFrame, digits: int = 2) -> DataFrame:
    """Per day and cell: what any longer window can be added up from."""
    return (
        _cells(log, digits)
        .groupBy(F.to_date("timestamp").alias("day"), "lat", "lng")
        .agg(F.sum(F.col("p").cast(numbers.SCORE)).alias("p_sum"), F.count(F.lit(1)).alias("incidents"))
    )


def rolling(daily: DataFrame, days: int, keys: tuple[str, ...], sums: tuple[str, ...]) -> DataFrame:
    """Every window of ``days`` days that holds a day with data, named by its first day.

    A day's totals enter with the first window that holds the day and leave after the last
    one: two changes for each day and key, which are added up in order. Between two changes
    all windows are alike; they are only written out at the end.
    """

    def change(at: Column, sign: int) -> Column:
        totals = [(sign * F.col(s)).alias(s) for s in sums]
        return F.struct(at.alias("window_start"), F.lit(sign).alias("_days"), *totals)

    day, measures = F.to_date("day"), ("_days", *sums)
    changes = daily.select(*keys, F.explode(F.array(change(F.date_sub(day, days - 1), 1), change(F.date_add(day, 1), -1))).alias("_change"))
    summed = changes.groupBy(*keys, F.col("_change.window_start").alias("_from")).agg(*[F.sum(f"_change.{m}").alias(m) for m in measures])
    order = Window.partitionBy(*keys).orderBy("_from")  # a key has two rows a day at most
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    running = summed.select(*keys, "_from", F.lead("_from").over(order).alias("_next"), *[F.sum(m).over(upto).alias(m) for m in measures])
    starts = F.sequence("_from", F.date_sub("_next", 1), F.expr("interval 1 day"))
    return running.where("_days > 0").select(F.explode(starts).alias("window_start"), *keys, *sums)


def rolling_heatmap(log: DataFrame, days: int = 30, digits: int = 2) -> DataFrame:
    summed = rolling(daily_cells(log, digits), days, ("lat", "lng"), ("p_sum", "incidents"))
    return summed.select(
        "window_start",
        "lat",
        "lng",
        (F.col("p_sum").cast("double") / F.col("incidents")).alias("risk_score"),
        F.col("incidents").alias("incident_count"),
    )


def daily_counts(log: DataFrame) -> DataFrame:
    return log.groupBy(F.to_date("timestamp").alias("day")).agg(
        F.count(F.lit(1)).alias("predictions"),
        F.count_if(F.col("prediction.risk_level") == "HIGH").alias("high_risk"),
    )


def rolling_counts(log: DataFrame, days: int = 7) -> DataFrame:
    return rolling(daily_counts(log), days, (), ("predictions", "high_risk"))


def recent_counts(log: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Predictions of the last days, and how many of them are HIGH."""
    end = as_of.cast("timestamp")
    recent = F.col("timestamp").between(end - F.make_dt_interval(days=F.lit(days)), end)
    return log.where(recent).agg(
        F.count(F.lit(1)).alias("predictions"),
        F.count_if(F.col("prediction.risk_level") == "HIGH").alias("high_risk"),
    )
