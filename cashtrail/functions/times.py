"""Calendar and clock features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
WEEKEND_DAYS = (5, 6)
PEAK_HOURS = (9, 10, 11, 14, 15, 16)
FESTIVE_MONTHS = (11, 12, 1)
SUMMER_MONTHS = (4, 5, 6)
MONSOON_MONTHS = (7, 8, 9)


def flag(condition: Column) -> Column:
    return condition.cast("int")


def parse_timestamp(text: Column) -> Column:
    """ISO text to timestamp; malformed text fails the job under ANSI mode."""
    return F.to_timestamp(text)


def hour(ts: Column) -> Column:
    return F.hour(ts)


def day_of_week(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts)


def month(ts: Column) -> Column:
    return F.month(ts)


def is_weekend(day: Column) -> Column:
    return flag(day.isin(*WEEKEND_DAYS))


def is_peak_hours(hr: Column) -> Column:
    """Peak flag used for training; see :func:`is_peak_withdrawal` for serving."""
    return flag(hr.isin(*PEAK_HOURS))


def is_peak_withdrawal(hr: Column) -> Column:
    return flag(hr.between(10, 16))


def is_night_time(hr: Column) -> Column:
    return flag((hr >= 22) | (hr <= 6))


def is_business_hours(hr: Column, day: Column | None = None) -> Column:
    """Office hours; pass the day to exclude weekends as serving does."""
    open_now = hr.between(9, 17)
    return flag(open_now if day is None else open_now & (day < 5))


def season_multiplier(mon: Column) -> Column:
    return (
        F.when(mon.isin(*FESTIVE_MONTHS), 1.4)
        .when(mon.isin(*SUMMER_MONTHS), 1.1)
        .when(mon.isin(*MONSOON_MONTHS), 0.8)
        .otherwise(1.0)
    )


def dashboard_season_multiplier(mon: Column) -> Column:
    return F.when(mon.isin(*FESTIVE_MONTHS), 1.3).otherwise(1.0)


def day_part(hr: Column) -> Column:
    return (
        F.when(hr <= 6, "late_night")
        .when(hr <= 11, "morning")
        .when(hr <= 17, "afternoon")
        .otherwise("evening")
    )


def month_label(ts: Column) -> Column:
    return F.date_format(ts, "MMM yyyy")


def hour_label(hr: Column) -> Column:
    return F.concat(F.lpad(hr.cast("string"), 2, "0"), F.lit(":00"))


def iso_text(ts: Column) -> Column:
    """ISO-8601 text; the fraction is written only when there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))
