"""Risk scores, levels, lead times and radii."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cashtrail.functions import geo, numbers

# fixed values
LATE_HOURS = (22, 23, 0, 1, 2, 3)
PAYMENT_CRIMES = ("Digital Payment Fraud", "UPI Fraud")
TECH_STATES = ("Maharashtra", "Delhi", "Karnataka", "Tamil Nadu", "Telangana")
LOWER_INCOME_STATES = ("Uttar Pradesh", "Bihar", "West Bengal")


def regional_multiplier(state: Column) -> Column:
    return F.when(state.isin(*TECH_STATES), 1.5).when(state.isin(*LOWER_INCOME_STATES), 0.8).otherwise(1.0)


def composite_risk(state_factor: Column, hour: Column, amount: Column, crime: Column) -> Column:
    """Mean of four factors, at most 0.95 (unrounded); missing if any input is."""
    late = F.when(hour.isin(*LATE_HOURS), 1.2).otherwise(0.8)
    large = F.when(amount > 100000, 1.3).otherwise(0.9)
    payment = F.when(crime.isin(*PAYMENT_CRIMES), 1.1).otherwise(0.95)
    mean = F.least(F.lit(0.95), (state_factor + late + large + payment) / 4)
    return F.when(numbers.all_known(state_factor, hour, amount) & crime.isNotNull(), mean)


def composite_probability(risk: Column) -> Column:
    return F.round(risk, 3)


def composite_score(risk: Column) -> Column:
    return F.round(risk * 100, 1)


def _amount_share(amount: Column) -> Column:
    return numbers.at_most(numbers.known(amount) / F.lit(200000.0), 1.0)


def _by_urgency(urgency: Column, high: float, medium: float, low: float) -> Column:
    """Unknown or missing urgency counts as one half."""
    return (
        F.when(urgency == "High", high)
        .when(urgency == "Medium", medium)
        .when(urgency == "Low", low)
        .otherwise(0.5)
    )


def base_risk(amount: Column, urgency: Column) -> Column:
    return (_amount_share(amount) + _by_urgency(urgency, 0.8, 0.5, 0.2)) / 2


def _hour_factor(hour: int) -> float:
    if 10 <= hour <= 16:
        return 1.2
    if 18 <= hour <= 22:
        return 1.1
    return 0.8 if hour <= 6 else 1.0


def hour_factor(hour: Column) -> Column:
    """Looked up in a constant array, so the hour is worked out once per row."""
    return F.get(F.array(*[F.lit(_hour_factor(h)) for h in range(24)]), hour)


def rule_probability(
    amount: Column, urgency: Column, hour: Column, day: Column, lat: Column, lng: Column
) -> Column:
    """Withdrawal probability by rule, at most 0.95 (unrounded).

    Missing where the amount, the time or the place is; a missing urgency counts as one half.
    """
    weekend = F.when(day >= 5, 0.9).otherwise(1.0)
    product = (
        _by_urgency(urgency, 0.75, 0.50, 0.25)
        * (0.3 + _amount_share(amount) * 0.4)
        * hour_factor(hour)
        * weekend
        * geo.city_factor(lat, lng)
    )
    return F.when(numbers.all_known(amount, hour, day, lat, lng), F.least(product, F.lit(0.95)))


def hours_band(p: Column) -> tuple[Column, Column]:
    """Earliest hour, and the hour before which the withdrawal is expected."""
    low = F.when(p > 0.8, 2).when(p > 0.6, 6).when(p > 0.4, 12).when(p.isNotNull(), 24)
    high = F.when(p > 0.8, 8).when(p > 0.6, 18).when(p > 0.4, 36).when(p.isNotNull(), 72)
    return low, high


def hours_from_band(p: Column, draw: Column) -> Column:
    low, high = hours_band(p)
    return (low + F.floor(draw * (high - low))).cast("int")


def scatter_degrees(p: Column) -> Column:
    return 0.05 + 0.15 * (1 - p)


def scatter(centre: Column, reach: Column, draw: Column) -> Column:
    """Point within ``reach`` either side of ``centre``, placed by a draw in [0, 1)."""
    return centre + reach * (2 * draw - 1)


def risk_level(p: Column, high: float, medium: float) -> Column:
    return F.when(p > high, "HIGH").when(p > medium, "MEDIUM").when(p.isNotNull(), "LOW")


def confidence(p: Column) -> Column:
    return numbers.at_most(p * 1.1, 1.0)


def rule_radius_km(p: Column) -> Column:
    return 1.0 + 5.0 * (1 - p)


def model_radius_km(p: Column) -> Column:
    return 1.0 + 4.0 * (1 - p)


def level_radius_km(level: Column) -> Column:
    return F.when(level == "HIGH", 2.0).when(level == "MEDIUM", 5.0).when(level.isNotNull(), 10.0)


def clamp_probability(p: Column) -> Column:
    return numbers.between(numbers.known(p), 0.1, 0.99)


def model_hours(p: Column) -> Column:
    """Lead time from a model's probability, truncated toward zero, 1 to 72."""
    return numbers.between((24 - numbers.known(p) * 48).cast("int"), 1, 72)


def urgency_hours(p: Column, urgency: Column) -> Column:
    base = F.when(urgency == "High", 6).when(urgency == "Medium", 12).otherwise(24)
    return (base * (1 - p * 0.5)).cast("int")
