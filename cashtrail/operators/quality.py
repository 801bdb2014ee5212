"""Contract, content and drift checks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cashtrail.contract import (
    CLEAN_SCHEMA,
    DRIFT_COLUMNS,
    LATITUDE_COLUMNS,
    LIMITS,
    LONGITUDE_COLUMNS,
    Limits,
)
from cashtrail.functions import numbers
from cashtrail.operators.ordered import kept, running_totals

REQUIRED_TARGETS = ("predicted_withdrawal_lat", "predicted_withdrawal_lng", "withdrawal_probability")


class ContractViolation(ValueError):
    """A table does not have the agreed columns."""


@dataclass(frozen=True)
class ContractResult:
    missing: tuple[str, ...]
    extra: tuple[str, ...]
    wrong_type: tuple[str, ...]
    expected_columns: int
    actual_columns: int

    @property
    def names_ok(self) -> bool:
        return not self.missing and not self.extra and self.expected_columns == self.actual_columns

    @property
    def ok(self) -> bool:
        return self.names_ok and not self.wrong_type


def check_contract(df: DataFrame, contract: T.StructType = CLEAN_SCHEMA) -> ContractResult:
    """Compare names and types; only the schema is looked at."""
    expected = {f.name: f.dataType for f in contract}
    actual = {f.name: f.dataType for f in df.schema}
    return ContractResult(
        missing=tuple(c for c in expected if c not in actual),
        extra=tuple(c for c in actual if c not in expected),
        wrong_type=tuple(c for c in expected if c in actual and actual[c] != expected[c]),
        expected_columns=len(contract),
        actual_columns=len(df.columns),
    )


def require_contract(df: DataFrame, contract: T.StructType = CLEAN_SCHEMA, types_too: bool = False) -> DataFrame:
    """Gate: raise unless the column names (and, if asked, types) agree."""
    found = check_contract(df, contract)
    if not (found.ok if types_too else found.names_ok):
        raise ContractViolation(str(found))
    return df


def missing_targets(df: DataFrame, targets: Sequence[str] = REQUIRED_TARGETS) -> list[str]:
    return [c for c in targets if c not in df.columns]


def contract_report(df: DataFrame, contract: T.StructType = CLEAN_SCHEMA) -> DataFrame:
    """One row per column: expected and actual type, verdict, filled rows."""
    expected = {f.name: f.dataType.simpleString() for f in contract}
    actual = dict(df.dtypes)
    verdicts = []
    for name in [*expected, *[c for c in actual if c not in expected]]:
        if name not in actual:
            verdict = "missing"
        elif name not in expected:
            verdict = "extra"
        else:
            verdict = "ok" if expected[name] == actual[name] else "type"
        filled = F.count(F.col(name)) if name in actual else F.lit(0)
        verdicts.append(
            F.struct(
                F.lit(name).alias("column_name"),
                F.lit(expected.get(name)).cast("string").alias("expected_type"),
                F.lit(actual.get(name)).cast("string").alias("actual_type"),
                F.lit(verdict).alias("verdict"),
                filled.cast("bigint").alias("filled_rows"),
            )
        )
    return df.agg(F.array(*verdicts).alias("r")).select(F.inline("r"))


def _outside(column: str, bounds: tuple[float, float]) -> Column:
    """True also for null and NaN, which lie in no range."""
    value = F.col(column)
    return ~F.coalesce(value.between(*bounds), F.lit(False))


def violations(df: DataFrame, limits: Limits = LIMITS) -> dict[str, Column]:
    """Row conditions by name, for the columns the table has."""
    rules: dict[str, Column] = {}
    for columns, bounds in ((LATITUDE_COLUMNS, limits.latitude), (LONGITUDE_COLUMNS, limits.longitude)):
        for c in columns:
            if c in df.columns:
                rules[f"{c}_outside"] = _outside(c, bounds)
    if "withdrawal_probability" in df.columns:
        rules["probability_outside"] = _outside("withdrawal_probability", (0.0, 1.0))
    if "amount_lost" in df.columns:
        rules["amount_not_positive"] = F.coalesce(F.col("amount_lost") <= 0, F.lit(False))
    return rules


def content_checks(df: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """One row: rows seen, how many break each rule, and the verdict."""
    rules = violations(df, limits)
    counted = df.agg(
        F.count(F.lit(1)).alias("checked_rows"), *[F.count_if(rule).alias(name) for name, rule in rules.items()]
    )
    clean = F.lit(not missing_targets(df))
    for name in rules:
        clean = clean & (F.col(name) == 0)
    return counted.withColumn("ok", clean)


def flag_violations(df: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Add ``violations``, the names of the rules each row breaks."""
    broken = [F.when(rule, F.lit(name)) for name, rule in violations(df, limits).items()]
    return df.withColumn("violations", F.array_compact(F.array(*broken)))


def split_by_quality(df: DataFrame, limits: Limits = LIMITS) -> tuple[DataFrame, DataFrame]:
    """Rows that pass every rule, and the rest together with their reasons."""
    flagged = flag_violations(df, limits)
    passed = F.size("violations") == 0
    return flagged.where(passed).drop("violations"), flagged.where(~passed)


def mean_drift(
    base: DataFrame,
    current: DataFrame,
    columns: Sequence[str] = DRIFT_COLUMNS,
    threshold: float = LIMITS.drift_ratio,
) -> DataFrame:
    """Relative shift of each column's mean; columns with a zero base mean are left out."""
    shared = [c for c in columns if c in base.columns and c in current.columns]

    def means(df: DataFrame, name: str) -> DataFrame:
        return df.agg(*[F.avg(numbers.known(F.col(c))).alias(c) for c in shared]).unpivot([], shared, "column_name", name)

    ratio = F.abs(F.col("current_mean") - F.col("base_mean")) / F.abs("base_mean")
    return (
        means(base, "base_mean")
        .where("base_mean <> 0")
        .join(means(current, "current_mean"), "column_name")
        .withColumn("drift_ratio", ratio)
        .withColumn("drift_detected", F.col("drift_ratio") > threshold)
    )


def no_drift(report: DataFrame) -> bool:
    return report.where("drift_detected").isEmpty()


def _kolmogorov_p(d: Column, n_base: Column, n_current: Column, terms: int = 101) -> Column:
    """Asymptotic two-sided p-value: 2 * sum of (-1)^(k-1) * exp(-2 k^2 x^2)."""
    x2 = d * d * (n_base * n_current / (n_base + n_current))
    tail = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * x2),
    )
    return F.when(x2 < 0.04, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * tail)))


def ks_drift(
    base: DataFrame,
    current: DataFrame,
    columns: Sequence[str] | None = None,
    p_value: float = LIMITS.drift_p_value,
    buckets: int | None = None,
) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov test of every numeric column.

    Rows collapse to one per distinct value before the first shuffle, and the
    running counts are taken inside value ranges, so no task holds a whole
    column.
    """
    if columns is None:
        numeric = [f.name for f in base.schema if isinstance(f.dataType, T.NumericType)]
        columns = [c for c in numeric if c in current.columns]

    def long(df: DataFrame, in_base: int) -> DataFrame:
        cast = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
        return cast.unpivot([], list(columns), "column_name", "value").select(
            "column_name", "value", F.lit(in_base).alias("in_base")
        )

    counted = (
        long(base, 1)
        .unionByName(long(current, 0))
        .where(F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy("column_name", "value")
        .agg(F.sum("in_base").alias("n_base"), F.sum(1 - F.col("in_base")).alias("n_current"))
    )
    running = running_totals(kept(counted), "column_name", "value", ["n_base", "n_current"], buckets)
    gap = F.abs(F.col("n_base_upto") / F.col("n_base_total") - F.col("n_current_upto") / F.col("n_current_total"))
    return (
        running.groupBy(
            "column_name", F.col("n_base_total").alias("base_rows"), F.col("n_current_total").alias("current_rows")
        )
        .agg(F.max(gap).alias("ks_statistic"))
        .withColumn(
            "p_value",
            _kolmogorov_p(
                F.col("ks_statistic"), F.col("base_rows").cast("double"), F.col("current_rows").cast("double")
            ),
        )
        .withColumn("drift_detected", F.col("p_value") < p_value)
    )

