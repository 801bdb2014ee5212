"""Sinks. Writes fail loudly; overwrites replace whole tables or whole folders."""

from __future__ import annotations

from pyspark.ml.util import MLReadable, MLWritable
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cashtrail.contract import NOTIFICATION_COLUMNS


# CSV text keeps microseconds.
CSV_OPTIONS = {"header": True, "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
JSON_OPTIONS = {"ignoreNullFields": False, "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def stage_path(base: str, run_ts: str, *parts: str) -> str:
    """``base/run_ts=<run>/<part>/...`` on any file system Spark can reach."""
    return "/".join([base.rstrip("/"), f"run_ts={run_ts}", *parts])


def evenly(df: DataFrame, *columns: str) -> DataFrame:
    """Bring equal keys together before a partitioned write.

    A rebalance lets the adaptive planner split a key that is too large for
    one task and merge those that are small, so a hot key becomes several
    files rather than one slow task.
    """
    return df.hint("rebalance", *[F.col(c) for c in columns])


def write_feature_store(df: DataFrame, path: str, file_format: str = "parquet") -> DataFrame:
    """Replace the feature store and hand back the stored rows."""
    options = CSV_OPTIONS if file_format == "csv" else {}
    df.write.mode("overwrite").format(file_format).options(**options).save(path)
    reader = df.sparkSession.read.schema(df.schema).format(file_format)
    return reader.option("header", True).load(path)


def write_split(df: DataFrame, path: str, column: str = "split") -> None:
    evenly(df, column).write.mode("overwrite").partitionBy(column).parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Publish ``df`` as the whole content of a table."""
    df.write.mode("overwrite").parquet(path)


def append_table(df: DataFrame, path: str) -> int:
    """Append rows and return how many were written, counted during the write."""
    seen = Observation("appended")
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("append").parquet(path)
    return seen.get["rows"]


def json_records(df: DataFrame, column: str = "record") -> DataFrame:
    """One JSON text per row; a null field is written as null."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(column))


def export_both(df: DataFrame, base: str) -> tuple[str, str]:
    """Write the table as JSON lines and as CSV; the rows are computed once, for the first."""
    json_path, csv_path = base + ".json", base + ".csv"
    df.write.mode("overwrite").options(**JSON_OPTIONS).json(json_path)
    lines = df.sparkSession.read.schema(df.schema).option("mode", "FAILFAST").json(json_path)
    lines.write.mode("overwrite").options(**CSV_OPTIONS).csv(csv_path)
    return json_path, csv_path


def append_prediction_log(log: DataFrame, path: str) -> None:
    """Append to the prediction log, one folder per day of the prediction."""
    dated = log.withColumn("log_date", F.to_date("timestamp"))
    evenly(dated, "log_date").write.mode("append").partitionBy("log_date").parquet(path)


def append_notifications(log: DataFrame, path: str) -> int:
    """Append to the notification log, one folder per day; returns the rows added.

    Batches and streams write the same layout. What is written twice, by a batch
    that ran again or a stream that lost its checkpoint, counts once on reading.
    """
    seen = Observation("notified")
    dated = log.select(*NOTIFICATION_COLUMNS).withColumn("log_date", F.to_date("timestamp"))
    counted = evenly(dated.observe(seen, F.count(F.lit(1)).alias("rows")), "log_date")
    counted.write.mode("append").partitionBy("log_date").parquet(path)
    return seen.get["rows"]


def write_report(report: DataFrame, path: str) -> None:
    """Store a small report as JSON lines, replacing an earlier one."""
    report.write.mode("overwrite").options(**JSON_OPTIONS).json(path)


def write_bulk_result(scored: DataFrame, base: str, run_ts: str) -> str:
    path = f"{base.rstrip('/')}/run_ts={run_ts}"
    scored.write.mode("overwrite").parquet(path)
    return path


def save_model(model: MLWritable, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(kind: type[MLReadable], path: str):
    return kind.load(path)


def ingest(spark: SparkSession, source: str, publish_to: str | None = None) -> DataFrame:
    """Load and clean the complaint file; publish only if a target is named."""
    from cashtrail.operators.clean import prepare_complaints
    from cashtrail.sources.readers import read_csv

    rows = prepare_complaints(read_csv(spark, source))
    if publish_to:
        replace_table(rows, publish_to)
    return rows
