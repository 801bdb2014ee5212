import pytest
from pyspark.sql import functions as F

from cashtrail.contract import Limits
from cashtrail.operators import heatmap, scoring
from cashtrail.session import new_folder
from cashtrail.sources import demo_tables, writers
from cashtrail.streaming import alerts, rolling

LIMITS = Limits(single_high=0.5)


@pytest.fixture(scope="module")
def files(spark, sf_dir):
    """Complaints in time order as five files, then one far later row to close every window."""
    base = new_folder(spark, "stream-input")
    rows = demo_tables.complaints(spark, sf_dir).withColumn("_part", F.floor(F.dayofmonth("timestamp") / 7)).persist()
    for i in range(5):
        rows.where(F.col("_part") == i).drop("_part").coalesce(1).write.mode("append").parquet(base)
    last = rows.drop("_part").orderBy("complaint_id").limit(1)
    far = last.withColumns(
        {"complaint_id": F.lit("sentinel"), "timestamp": F.lit("2024-06-01 00:00:00").cast("timestamp")}
    )
    far.coalesce(1).write.mode("append").parquet(base)
    return base, rows.drop("_part")


def _stream(spark, folder):
    schema = spark.read.parquet(folder).schema
    return alerts.read_complaints(spark, folder, schema=schema)


def _log(df):
    return scoring.prediction_log(scoring.score(df.drop(*scoring.RESULT_COLUMNS[1:]), high=0.5))


def _paths(spark):
    base = new_folder(spark, "stream-output")
    return f"{base}/table", f"{base}/progress"


def _same(a, b):
    assert a.columns == b.columns
    assert a.count() > 0
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_alerts_equal_batch_and_count_once(spark, files):
    folder, rows = files
    path, progress = _paths(spark)
    for _ in range(2):  # a restart from the same checkpoint adds nothing
        alerts.store_alerts(alerts.raise_alerts(_stream(spark, folder), LIMITS), path, progress).awaitTermination()
    got = spark.read.parquet(path).where("complaint_id <> 'sentinel'").drop("location")
    _same(got, scoring.alerts(scoring.score(rows.drop(*scoring.RESULT_COLUMNS[1:]), high=0.5)).drop("location"))


def test_notifications_are_written_once_per_batch(spark, files):
    folder, _ = files
    path, progress = _paths(spark)
    raised = alerts.raise_alerts(_stream(spark, folder), LIMITS)
    alerts.store_notifications(raised, F.lit("lea"), path, progress).awaitTermination()
    log = alerts.read_notifications(spark, path)
    assert log.count() == log.select("alert_id").distinct().count() > 0
    latest = scoring.latest_notifications(log, 5).collect()
    assert [r["timestamp"] for r in latest] == sorted((r["timestamp"] for r in latest), reverse=True)


def test_batch_and_stream_write_one_log(spark, files):
    folder, rows = files
    path, progress = _paths(spark)
    batch = scoring.alerts(scoring.score(rows.drop(*scoring.RESULT_COLUMNS[1:]), high=0.5))
    assert writers.append_notifications(scoring.notifications(batch, F.lit("lea")), path) == batch.count()
    raised = alerts.raise_alerts(_stream(spark, folder), LIMITS)
    alerts.store_notifications(raised, F.lit("lea"), path, progress).awaitTermination()
    once = alerts.read_notifications(spark, path).where("complaint_id <> 'sentinel'").count()
    assert once == batch.count()
    # a lost checkpoint repeats the stream from its start; nothing is lost or doubled
    alerts.store_notifications(raised, F.lit("lea"), path, progress + "-new").awaitTermination()
    assert alerts.read_notifications(spark, path).where("complaint_id <> 'sentinel'").count() == once


def test_no_alert_without_a_time(spark, files):
    _, rows = files
    timeless = rows.drop(*scoring.RESULT_COLUMNS[1:]).withColumn("timestamp", F.lit(None).cast("timestamp"))
    scored = scoring.score(timeless, high=0.0)
    assert scoring.alerts(scored).isEmpty() and scored.where("risk_level IS NOT NULL").isEmpty()


def test_rolling_windows_equal_batch(spark, files):
    folder, rows = files
    path, progress = _paths(spark)
    for _ in range(2):  # a restart from the same checkpoint adds nothing
        rolling.store_days(rolling.daily_counts(_log(_stream(spark, folder))), path, progress).awaitTermination()
    _same(rolling.count_windows(spark, path, 7), heatmap.rolling_counts(_log(spark.read.parquet(folder)), 7))


def test_rolling_heatmap_equals_batch(spark, files):
    folder, rows = files
    path, progress = _paths(spark)
    rolling.store_days(rolling.daily_cells(_log(_stream(spark, folder)), 0), path, progress).awaitTermination()
    _same(rolling.heatmap_windows(spark, path, 30), heatmap.rolling_heatmap(_log(spark.read.parquet(folder)), 30, 0))


def test_late_rows_are_dropped(spark, files):
    folder, rows = files
    base = new_folder(spark, "late")
    ordered = rows.orderBy("timestamp")
    first, second = ordered.where("timestamp >= '2024-01-10'"), ordered.where("timestamp < '2024-01-02'")
    path, progress = _paths(spark)
    for part in (first, second):
        part.coalesce(1).write.mode("append").parquet(base)
        rolling.store_days(rolling.daily_counts(_log(_stream(spark, base))), path, progress).awaitTermination()
    days = [str(r[0]) for r in rolling.count_windows(spark, path, 1).select("window_start").collect()]
    assert days and min(days) >= "2024-01-10"
