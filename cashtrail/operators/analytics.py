"""Dashboard aggregates.

Each is one partial aggregate, one exchange of its groups and, where asked, a
top-k; group counts are small next to the rows. Ties are broken by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cashtrail.contract import LIMITS
from cashtrail.functions import money, numbers, times
from cashtrail.operators import lookup

HIGH = "High"


def _cases() -> Column:
    return F.count(F.lit(1))


def _known(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("Unknown"))


def _amount() -> Column:
    return F.coalesce(numbers.known(F.col("amount_lost")), F.lit(0.0))


def risk_distribution(df: DataFrame) -> DataFrame:
    urgency = F.col("urgency_level")
    return df.agg(
        F.count_if(urgency == HIGH).alias("high"),
        F.count_if(urgency == "Medium").alias("medium"),
        F.count_if(urgency == "Low").alias("low"),
        _cases().alias("total"),
    )


def dataset_summary(df: DataFrame, high_risk_score: float = LIMITS.high_risk_score) -> DataFrame:
    return df.agg(
        _cases().alias("total_records"),
        F.count_distinct("complaint_state").alias("states_covered"),
        F.count_distinct("complaint_city").alias("cities_covered"),
        numbers.exact_sum(F.col("amount_lost")).alias("total_amount_lost"),
        F.round(numbers.exact_mean(F.col("amount_lost"), numbers.MONEY), 4).alias("average_amount_lost"),
        F.count_if(numbers.known(F.col("risk_score")) > high_risk_score).alias("high_risk_cases"),
    )


def dataset_breakdown(df: DataFrame) -> DataFrame:
    """Counts by crime type, state, urgency and month, from one scan."""
    sections = ["crime_type", "complaint_state", "urgency_level", "month"]
    keyed = df.select(*sections[:3], times.month(F.col("timestamp")).cast("string").alias("month"))
    return (
        keyed.unpivot([], sections, "section", "item")
        .where("item IS NOT NULL")
        .groupBy("section", "item")
        .agg(_cases().alias("cases"))
    )


def city_stats(df: DataFrame, n: int = 10, by_state: bool = False) -> DataFrame:
    """Incidents and mean risk per city.

    A city name can occur in several states; ``by_state`` keeps them apart.
    """
    keys = [F.col("complaint_city").alias("city")]
    if by_state:
        keys.append(F.col("complaint_state").alias("state"))
    names = ["city", "state"][: len(keys)]
    return (
        df.where(F.col("complaint_city").isNotNull())
        .groupBy(*keys)
        .agg(
            F.count("complaint_id").alias("incidents"),
            F.round(money.fraction(numbers.exact_mean(F.col("risk_score"))), 2).alias("risk_score"),
        )
        .orderBy(F.desc("incidents"), *names)
        .limit(n)
    )


def state_stats(df: DataFrame, n: int = 10) -> DataFrame:
    return (
        df.where(F.col("complaint_state").isNotNull())
        .groupBy(F.col("complaint_state").alias("state"))
        .agg(
            F.count("complaint_id").alias("cases"),
            F.round(numbers.exact_sum(F.col("amount_lost")), 2).alias("total_loss"),
            F.round(numbers.exact_mean(F.col("amount_lost"), numbers.MONEY), 2).alias("avg_loss"),
            F.round(numbers.exact_mean(F.col("risk_score")), 2).alias("avg_risk"),
            F.round(numbers.exact_mean(F.col("withdrawal_probability")), 2).alias("avg_withdrawal_prob"),
        )
        .orderBy(F.desc("cases"), "state")
        .limit(n)
    )


def state_distribution(df: DataFrame, n: int = 10) -> DataFrame:
    """Incidents, loss in crores and mean 0..1 risk of the busiest states."""
    risk = F.coalesce(F.col("risk_score"), F.lit(0.0))
    return (
        df.groupBy(_known("complaint_state").alias("state"))
        .agg(
            _cases().alias("incidents"),
            F.round(money.crores(numbers.exact_sum(_amount())), 2).alias("amount_lost"),
            F.round(money.fraction(numbers.exact_mean(risk)), 2).alias("risk_score"),
        )
        .orderBy(F.desc("incidents"), "state")
        .limit(n)
    )


def high_risk_zones(df: DataFrame, n: int = 3) -> DataFrame:
    return state_distribution(df, n).select("state", "incidents")


def crime_type_analysis(df: DataFrame) -> DataFrame:
    """Cases, share, mean loss and states reached per crime type.

    A first aggregate by (crime type, state) makes the distinct count a plain
    count. The total is taken from the same groups; it asks for all their
    columns so that the planner reuses their exchange instead of a second scan.
    """
    by_state = df.groupBy(_known("crime_type").alias("crime_type"), _known("complaint_state").alias("state")).agg(
        _cases().alias("cases"), F.sum(_amount().cast(numbers.MONEY)).alias("amount")
    )
    total = by_state.agg(F.struct(F.sum("cases").alias("cases"), F.sum("amount").alias("amount"))).scalar()["cases"]
    return (
        by_state.groupBy("crime_type")
        .agg(F.sum("cases").alias("cases"), F.sum("amount").alias("amount"), _cases().alias("states_affected"))
        .select(
            "crime_type",
            "cases",
            F.round(F.col("cases") * 100.0 / total, 1).alias("percentage"),
            F.round(F.col("amount").cast("double") / F.col("cases"), 0).alias("avg_amount"),
            "states_affected",
        )
        .orderBy(F.desc("cases"), "crime_type")
    )


def bank_incidents(df: DataFrame, n: int = 6) -> DataFrame:
    return (
        df.groupBy(_known("bank_involved").alias("bank"))
        .agg(_cases().alias("incidents"), F.round(money.crores(numbers.exact_sum(_amount())), 1).alias("amount"))
        .orderBy(F.desc("incidents"), "bank")
        .limit(n)
    )


def month_counts(df: DataFrame) -> DataFrame:
    """Complaints per month of the year, years merged."""
    return df.groupBy(times.month(F.col("timestamp")).alias("month")).agg(F.count("complaint_id").alias("cases"))


def summary_row(df: DataFrame) -> DataFrame:
    total = numbers.exact_sum(_amount())
    return df.agg(
        _cases().alias("total_cases"),
        F.round(money.crores(total), 2).alias("total_amount_lost"),
        F.count_distinct(_known("complaint_state")).alias("states_covered"),
        F.round(F.try_divide(total, _cases()), 0).alias("avg_case_value"),
    )


def system_stats(df: DataFrame) -> DataFrame:
    return df.agg(_cases().alias("total_cases"), F.count_if(F.col("urgency_level") == HIGH).alias("high_risk_cases"))


def weekly_trend(df: DataFrame) -> DataFrame:
    counts = df.groupBy(times.day_of_week(F.col("timestamp")).alias("day_of_week")).agg(
        _cases().alias("complaints"), F.count_if(F.col("urgency_level") == HIGH).alias("high_risk")
    )
    return lookup.fill_spine(lookup.weekday_spine(df.sparkSession), counts, "day_of_week").orderBy("day_of_week")


def hourly_distribution(df: DataFrame) -> DataFrame:
    counts = df.groupBy(times.hour(F.col("timestamp")).alias("hour")).agg(_cases().alias("cases"))
    filled = lookup.fill_spine(lookup.hour_spine(df.sparkSession), counts, "hour").orderBy("hour")
    return filled.select(times.hour_label(F.col("hour")).alias("hour"), "cases")


def monthly_trend(df: DataFrame, as_of: Column, months: int = 12) -> DataFrame:
    """The calendar months up to the month of ``as_of``, empty ones included."""
    first = F.add_months(F.trunc(as_of, "month"), 1 - months)
    end = F.add_months(F.trunc(as_of, "month"), 1)
    ts = F.col("timestamp")
    counts = (
        df.where((ts >= first.cast("timestamp")) & (ts < end.cast("timestamp")))
        .groupBy(F.to_date(F.date_trunc("month", ts)).alias("month_start"))
        .agg(
            _cases().alias("total_cases"),
            F.count_if(F.col("urgency_level") == HIGH).alias("high_risk"),
            F.round(money.crores(numbers.exact_sum(_amount())), 1).alias("amount_lost"),
        )
    )
    filled = lookup.fill_spine(lookup.month_spine(df.sparkSession, as_of, months), counts, "month_start")
    return filled.orderBy("month_start").select(
        times.month_label(F.col("month_start")).alias("month"), "total_cases", "high_risk", "amount_lost"
    )


def crime_growth(df: DataFrame, period: str = "month") -> DataFrame:
    """Change of each crime type against the period before; null without cases then."""
    steps = {
        "month": lambda d: F.add_months(d, 1),
        "week": lambda d: F.date_add(d, 7),
        "day": lambda d: F.date_add(d, 1),
    }
    counts = df.groupBy(
        _known("crime_type").alias("crime_type"),
        F.to_date(F.date_trunc(period, F.col("timestamp"))).alias("period_start"),
    ).agg(_cases().alias("cases"))
    order = Window.partitionBy("crime_type").orderBy("period_start")
    follows = steps[period](F.lag("period_start").over(order)) == F.col("period_start")
    before = F.when(follows, F.lag("cases").over(order))
    return counts.withColumn("previous_cases", before).select(
        "crime_type",
        F.date_format("period_start", "yyyy-MM-dd").alias("period_start"),
        "cases",
        "previous_cases",
        F.round((F.col("cases") - F.col("previous_cases")) * 100.0 / F.col("previous_cases"), 1).alias("growth_percent"),
    )
