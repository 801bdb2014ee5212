"""The tables behind each dashboard page, as lazy frames.

Callers that show a whole page pass a frame they have persisted; each table
then reads the stored rows instead of the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from cashtrail.contract import LIMITS, Limits
from cashtrail.operators import analytics, clean, heatmap, profile


def system_stats(complaints: DataFrame, log: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    return {
        "cases": analytics.system_stats(complaints),
        "last_7_days": heatmap.recent_counts(log, as_of, 7),
    }


def analytics_data(complaints: DataFrame) -> dict[str, DataFrame]:
    return {
        "weekly_trend": analytics.weekly_trend(complaints),
        "risk_distribution": analytics.risk_distribution(complaints),
        "geographic_data": analytics.city_stats(complaints),
        "crime_types": profile.value_counts(complaints, "crime_type"),
    }


def enhanced_analytics(complaints: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    return {
        "summary": analytics.summary_row(complaints),
        "state_wise_distribution": analytics.state_distribution(complaints),
        "monthly_trends": analytics.monthly_trend(complaints, as_of),
        "crime_type_analysis": analytics.crime_type_analysis(complaints),
        "crime_growth": analytics.crime_growth(complaints),
        "hourly_distribution": analytics.hourly_distribution(complaints),
        "banking_partners": analytics.bank_incidents(complaints),
        "high_risk_zones": analytics.high_risk_zones(complaints),
    }


def risk_heatmap(log: DataFrame, as_of: Column, days: int = 30, city: str | None = None) -> DataFrame:
    recent = clean.within_days(log, as_of, days)
    if city is not None:
        recent = clean.where_equal(recent, "input_data.complaint_city", city)
    return heatmap.risk_heatmap(recent)


def dataset_report(complaints: DataFrame, limits: Limits = LIMITS) -> dict[str, DataFrame]:
    """What the dataset analysis prints."""
    timed = clean.add_time_features(complaints)
    return {
        "overview": profile.overview(complaints),
        "columns": profile.column_profile(complaints),
        "numbers": profile.numeric_profile(complaints),
        "categories": profile.top_categories(complaints),
        "date_range": profile.date_range(complaints),
        "peak_times": profile.peak_times(complaints),
        "states": analytics.state_stats(complaints),
        "correlations": profile.correlations(timed, floor=limits.correlation_floor),
    }


def dataset_summary(complaints: DataFrame) -> dict[str, DataFrame]:
    return {"totals": analytics.dataset_summary(complaints), "breakdown": analytics.dataset_breakdown(complaints)}

