"""Descriptive profiles: shape, columns, numbers, categories, time, correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cashtrail.contract import LIMITS, PROFILE_CATEGORIES, PROFILE_NUMBERS, TARGETS
from cashtrail.functions import numbers, times
from cashtrail.operators.clean import numeric_columns


def overview(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("records")).withColumn("features", F.lit(len(df.columns)))


def _without_nan(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    return numbers.known(F.col(column)) if isinstance(kind, T.FractionalType) else F.col(column)


def _value_counts_long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value, n) for every column, nulls included.

    Rows are counted per (column, value) before the shuffle, so a value that
    fills a third of a column arrives as one row per task.
    """
    text = df.select(*[_without_nan(df, c).cast("string").alias(c) for c in columns])
    return (
        text.unpivot([], list(columns), "column_name", "value")
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def column_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Type, null count and distinct count of every column.

    The exact distinct count shuffles each distinct value once; with
    ``approximate`` nothing but sketches is exchanged.
    """
    kinds = F.create_map(*[F.lit(x) for pair in df.dtypes for x in pair])
    if approximate:
        facts = [
            F.struct(
                F.lit(c).alias("column_name"),
                F.count_if(_without_nan(df, c).isNull()).alias("nulls"),
                F.approx_count_distinct(_without_nan(df, c)).alias("unique_values"),
            )
            for c in df.columns
        ]
        profile = df.agg(F.array(*facts).alias("f")).select(F.inline("f"))
    else:
        profile = (
            _value_counts_long(df, df.columns)
            .groupBy("column_name")
            .agg(
                F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("nulls"),
                F.count("value").alias("unique_values"),
            )
        )
    return profile.select("column_name", kinds[F.col("column_name")].alias("data_type"), "nulls", "unique_values")


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*[count(F.col(c)).alias(f"{c}_distinct") for c in columns])


def numeric_profile(df: DataFrame, columns: Sequence[str] = PROFILE_NUMBERS) -> DataFrame:
    """Range, mean, sample deviation and nulls of each column, from one pass."""
    facts = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.min(x).alias("minimum"),
            F.max(x).alias("maximum"),
            F.round(F.avg(x), 4).alias("mean"),
            F.round(F.stddev_samp(x), 4).alias("std"),
            F.count_if(x.isNull()).alias("nulls"),
        )
        for c, x in ((c, numbers.known(F.col(c))) for c in columns if c in df.columns)
    ]
    return df.agg(F.array(*facts).alias("f")).select(F.inline("f"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("cases"))
        .orderBy(F.desc("cases"), column)
    )


def _top(counts: DataFrame, group: str, k: int, tie: str) -> DataFrame:
    """First k rows of each group; every task drops all but its own k first."""
    order = Window.partitionBy(group).orderBy(F.desc("cases"), F.asc(tie))
    return counts.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def top_categories(df: DataFrame, features: Sequence[str] = PROFILE_CATEGORIES, k: int = 5) -> DataFrame:
    """Most frequent values per feature, their share of all rows, and how many more there are."""
    counts = _value_counts_long(df, [c for c in features if c in df.columns])
    totals = counts.groupBy("column_name").agg(
        F.sum("n").alias("rows"), F.greatest(F.count("value") - k, F.lit(0)).alias("more_categories")
    )
    top = _top(counts.where("value IS NOT NULL").withColumnRenamed("n", "cases"), "column_name", k, "value")
    return (
        top.join(F.broadcast(totals), "column_name")  # one row per feature
        .withColumn("percent", F.round(F.col("cases") * 100.0 / F.col("rows"), 1))
        .select("column_name", "position", "value", "cases", "percent", "more_categories")
    )


def frequent_values(df: DataFrame, column: str, k: int = 3) -> DataFrame:
    return value_counts(df, column).limit(k)


def date_range(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """First and last time and the whole days between them."""
    return df.agg(F.min(column).alias("first"), F.max(column).alias("last")).select(
        times.iso_text(F.col("first")).alias("first_seen"),
        times.iso_text(F.col("last")).alias("last_seen"),
        F.timestamp_diff("DAY", F.col("first"), F.col("last")).alias("whole_days"),
    )


def peak_times(df: DataFrame, k: int = 3) -> DataFrame:
    """Busiest hours, weekdays and months."""
    ts = F.col("timestamp")
    parts = df.select(
        times.hour(ts).alias("hour"), times.day_of_week(ts).alias("day_of_week"), times.month(ts).alias("month")
    )
    counts = (
        parts.unpivot([], parts.columns, "part", "value")
        .where("value IS NOT NULL")
        .groupBy("part", "value")
        .agg(F.count(F.lit(1)).alias("cases"))
    )
    return _top(counts, "part", k, "value").select("part", "position", "value", "cases")


def correlations(
    df: DataFrame,
    targets: Sequence[str] = TARGETS,
    features: Sequence[str] | None = None,
    floor: float = LIMITS.correlation_floor,
) -> DataFrame:
    """Pearson correlation of every numeric column with each target, strongest positive first."""
    names = list(features) if features is not None else numeric_columns(df)

    def entry(target: str, feature: str) -> Column:
        r = F.corr(numbers.known(F.col(feature)), numbers.known(F.col(target)))
        return F.struct(F.lit(target).alias("target"), F.lit(feature).alias("feature"), r.alias("r"))

    pairs = [entry(t, f) for t in targets for f in names if f != t]
    return (
        df.agg(F.array(*pairs).alias("p"))
        .select(F.inline("p"))
        .where(F.col("r").isNotNull() & ~F.isnan("r") & (F.abs("r") > floor))
        .orderBy("target", F.desc("r"))
    )
