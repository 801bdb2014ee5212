"""Identifiers, messages and display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value
MASKED_PHONE = "+91-XXXXXXXXXX"


def complaint_id(year: Column, number: Column) -> Column:
    """``CG`` + year + number, padded to at least six digits."""
    return F.format_string("CG%d%06d", year.cast("int"), number.cast("bigint"))


def alert_id(complaint: Column, ts: Column) -> Column:
    return F.concat(F.lit("alert_"), complaint, F.lit("_"), F.unix_timestamp(ts).cast("string"))


def alert_message(lat: Column, lng: Column, hours: Column) -> Column:
    return F.format_string(
        "HIGH RISK: Withdrawal predicted at (%.4f, %.4f) within %d hours", lat, lng, hours
    )


def title_words(snake: Column) -> Column:
    return F.initcap(F.replace(snake, F.lit("_"), F.lit(" ")))


def hide_phone(phone: Column) -> Column:
    return F.when(phone.isNotNull(), F.lit(MASKED_PHONE))


def mask_phone_digits(phone: Column) -> Column:
    """Keep the country prefix and the length, hide every digit after it."""
    prefix = F.substring_index(phone, "-", 1)
    rest = F.substring(phone, F.length(prefix) + 1, F.length(phone))
    return F.concat(prefix, F.regexp_replace(rest, "[0-9]", "X"))
