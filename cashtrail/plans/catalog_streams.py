"""Registered queries that run a stream over the whole events table and read what it stored."""

from __future__ import annotations

from pyspark.sql import functions as F

from cashtrail import contract
from cashtrail.functions import times
from cashtrail.operators import scoring
from cashtrail.plans.catalog import ALERT_LIMIT, AS_OF, recipient_role, register
from cashtrail.session import new_folder
from cashtrail.sources import demo_tables, writers
from cashtrail.streaming import alerts as alert_streams
from cashtrail.streaming import rolling

_LIMITS = contract.Limits(single_high=ALERT_LIMIT)


def _stream(spark, sf):
    return demo_tables.complaints(spark, sf, events=demo_tables.event_stream(spark, sf))


def _alerts(spark, sf):
    return alert_streams.raise_alerts(_stream(spark, sf), _LIMITS)


def _log(spark, sf):
    rows = _stream(spark, sf).drop(*scoring.RESULT_COLUMNS[1:])
    return scoring.prediction_log(scoring.score(rows, high=ALERT_LIMIT))


def _folders(spark, name):
    base = new_folder(spark, name)
    return f"{base}/table", f"{base}/progress"


@register
def alerts_stream(spark, sf):
    path, progress = _folders(spark, "alerts")
    alert_streams.store_alerts(_alerts(spark, sf), path, progress).awaitTermination()
    return spark.read.parquet(path).select(
        "alert_id", "complaint_id", "message", times.iso_text(F.col("timestamp")).alias("timestamp"), "severity"
    )


@register
def alert_routing_stream(spark, sf):
    path, progress = _folders(spark, "routed")
    alert_streams.store_routed(_alerts(spark, sf), recipient_role(), path, progress).awaitTermination()
    return alert_streams.recipients(spark, path, "bank").select("alert_id", "complaint_id")


@register
def alert_log(spark, sf):
    path, progress = _folders(spark, "notifications")
    alert_streams.store_notifications(_alerts(spark, sf), recipient_role(), path, progress).awaitTermination()
    latest = scoring.latest_notifications(alert_streams.read_notifications(spark, path), 50)
    return latest.withColumn("timestamp", times.iso_text(F.col("timestamp")))


@register
def notification_log(spark, sf):
    """A batch and a stream write one log; what both wrote counts once."""
    path, progress = _folders(spark, "notification-log")
    rows = demo_tables.complaints(spark, sf).drop(*scoring.RESULT_COLUMNS[1:])
    raised = scoring.alerts(scoring.score(rows, high=ALERT_LIMIT))
    early = scoring.notifications(raised, recipient_role()).where(F.col("timestamp") < F.lit(AS_OF).cast("timestamp") - F.expr("INTERVAL 10 DAYS"))
    writers.append_notifications(early, path)
    alert_streams.store_notifications(_alerts(spark, sf), recipient_role(), path, progress).awaitTermination()
    latest = scoring.latest_notifications(alert_streams.read_notifications(spark, path), 50)
    return latest.withColumn("timestamp", times.iso_text(F.col("timestamp")))


@register
def rolling_heatmap_stream(spark, sf):
    path, progress = _folders(spark, "heatmap")
    rolling.store_days(rolling.daily_cells(_log(spark, sf)), path, progress).awaitTermination()
    found = rolling.heatmap_windows(spark, path).withColumn("risk_score", F.round("risk_score", 6))
    return found.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


@register
def rolling_counts_stream(spark, sf):
    path, progress = _folders(spark, "counts")
    rolling.store_days(rolling.daily_counts(_log(spark, sf)), path, progress).awaitTermination()
    return rolling.count_windows(spark, path, 7).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))
