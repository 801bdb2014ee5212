"""Scans: every one has an explicit schema, so nothing is read twice to infer it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from cashtrail.contract import RAW_SCHEMA

try:
    import yaml
except ImportError:  # only YAML contracts need it
    yaml = None


def read_csv(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA, mode: str = "FAILFAST") -> DataFrame:
    """CSV with a header, whose columns may be some of the contract's, in any order.

    Types come from the contract by name; a column it does not know is text. Every
    file's header is checked: files of one path must agree on the order.
    """
    header = spark.read.option("header", True).csv(path).columns
    typed = T.StructType(
        [schema[name] if name in schema.names else T.StructField(name, T.StringType()) for name in header]
    )
    reader = spark.read.schema(typed).option("header", True).option("enforceSchema", False)
    return reader.option("mode", mode).csv(path)


def read_json(
    spark: SparkSession,
    path: str,
    schema: T.StructType = RAW_SCHEMA,
    array: bool = True,
    mode: str = "FAILFAST",
) -> DataFrame:
    """One JSON array per file, or one record per line with ``array=False``.

    A file holding one array is read by one task, so large tables should come
    as many files or as lines.
    """
    return spark.read.schema(schema).option("multiLine", array).option("mode", mode).json(path)


def _holds_array(spark: SparkSession, path: str) -> bool:
    """Does every file hold one array? Files of both forms are an error.

    Only files that start with a bracket are looked through, for lines of records;
    one character of a file and two flags reach the driver.
    """
    lines = spark.read.text(path).select(F.ltrim("value").alias("line")).where("line <> ''")
    first = lines.select(F.substring("line", 1, 1).alias("c")).limit(1).collect()
    if not first or first[0]["c"] != "[":
        return False
    mark = F.substring("line", 1, 1)
    files = spark.read.text(path).select(F.ltrim("value").alias("line"), F.input_file_name().alias("file")).where("line <> ''")
    whole = files.groupBy("file").agg(F.bool_or(mark == "[").alias("opens"))
    if whole.where(~F.col("opens")).limit(1).collect():
        raise ValueError(f"{path} holds arrays and lines of records: read each form by itself")
    return True


def load_complaints(spark: SparkSession, base: str, array: bool | None = None) -> DataFrame:
    """``base.json`` if it is there, otherwise ``base.csv``; neither is an error.

    ``array`` says whether a JSON file is one array or one record per line; without
    it the files are looked at.
    """
    try:
        is_array = _holds_array(spark, base + ".json") if array is None else array
        return read_json(spark, base + ".json", array=is_array)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return read_csv(spark, base + ".csv")


# Column types a YAML contract may name.
YAML_TYPES = {
    "object": T.StringType(),
    "float64": T.DoubleType(),
    "int64": T.LongType(),
    "bool": T.BooleanType(),
}


def load_contract(text: str) -> T.StructType:
    """A column contract written as Spark schema JSON, as DDL, or as YAML.

    The YAML form has a list ``columns`` of one-entry mappings, name to type.
    It agrees with a table by names; its types are coarser than Spark's.
    """
    if text.lstrip().startswith("{"):
        return T.StructType.fromJson(json.loads(text))
    if any(line.strip() == "columns:" for line in text.splitlines()):
        if yaml is None:
            raise RuntimeError("a YAML contract needs the yaml package")
        entries = [next(iter(entry.items())) for entry in yaml.safe_load(text)["columns"]]
        return T.StructType([T.StructField(name, YAML_TYPES[kind]) for name, kind in entries])
    return T.StructType.fromDDL(text)


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One side of a stored train/test split; the other side's files are not listed."""
    return spark.read.parquet(path).where(F.col("split") == split).drop("split")


def read_prediction_log(
    spark: SparkSession,
    path: str,
    as_of,
    days: int,
    city: str | None = None,
    risk_level: str | None = None,
) -> DataFrame:
    """Predictions of the last ``days`` days up to ``as_of``, both ends included.

    The log is partitioned by ``log_date``; the date bounds prune folders and
    the exact time bounds reach the scan.
    """
    end = F.lit(as_of).cast("timestamp")
    start = end - F.make_dt_interval(days=F.lit(days))
    rows = spark.read.parquet(path).where(
        F.col("log_date").between(F.to_date(start), F.to_date(end)) & F.col("timestamp").between(start, end)
    )
    if city is not None:
        rows = rows.where(F.col("input_data.complaint_city") == city)
    if risk_level is not None:
        rows = rows.where(F.col("prediction.risk_level") == risk_level)
    return rows
