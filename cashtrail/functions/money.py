"""Amount bands, units and the rules that read the amount lost."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cashtrail.functions import numbers

# fixed values
RUPEES_PER_CRORE = 10_000_000
URGENT_CRIMES = ("Cryptocurrency Fraud", "Digital Payment Fraud")


def crores(rupees: Column) -> Column:
    return rupees / F.lit(float(RUPEES_PER_CRORE))


def fraction(percent: Column) -> Column:
    return percent / F.lit(100.0)


def alert_priority(risk: Column, amount: Column) -> Column:
    """A missing number reaches no limit."""
    risk, amount = numbers.known(risk), numbers.known(amount)
    return (
        F.when((risk >= 80) | (amount >= 100000), "High")
        .when((risk >= 60) & (amount >= 50000), "Medium")
        .otherwise("Low")
    )


def amount_risk_level(amount: Column) -> Column:
    """Right-closed bands 1..4; null where the amount is missing or not positive."""
    amount = numbers.known(amount)
    return (
        F.when(amount <= 0, None)
        .when(amount <= 10000, 1)
        .when(amount <= 50000, 2)
        .when(amount <= 200000, 3)
        .when(amount > 200000, 4)
        .cast("int")
    )


def serving_amount_level(amount: Column) -> Column:
    amount = numbers.known(amount)
    return F.when(amount > 100000, 2).when(amount > 50000, 1).otherwise(0)


def urgency_level(amount: Column, crime: Column, urgent_crimes: tuple[str, ...] = URGENT_CRIMES) -> Column:
    amount = numbers.known(amount)
    return (
        F.when((amount > 200000) | crime.isin(*urgent_crimes), "High")
        .when(amount > 50000, "Medium")
        .otherwise("Low")
    )


def requires_bank_alert(amount: Column, urgency: Column) -> Column:
    large, urgent = F.coalesce(numbers.known(amount) > 50000, F.lit(False)), F.coalesce(urgency == "High", F.lit(False))
    return (large | urgent).cast("int")


def thousands(number: Column) -> Column:
    return F.format_number(number, 0)
