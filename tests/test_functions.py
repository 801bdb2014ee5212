"""Boundary rows of every rule."""

import math

import pytest
from pyspark.sql import functions as F

from cashtrail.functions import draws, geo, money, risk, texts, times


def rows(spark, data, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(data, schema).select(*columns).collect()]


def one(spark, data, schema, column):
    return [r[0] for r in rows(spark, data, schema, column)]


def test_alert_priority(spark):
    data = [(80.0, 0.0), (79.9, 99999.99), (60.0, 50000.0), (60.0, 49999.0), (59.9, 99999.0), (10.0, 100000.0)]
    got = one(spark, data, "r double, a double", money.alert_priority(F.col("r"), F.col("a")))
    assert got == ["High", "Medium", "Medium", "Low", "Low", "High"]


def test_amount_levels(spark):
    data = [(x,) for x in (0.0, 0.01, 10000.0, 10000.01, 50000.0, 200000.0, 200000.01, None)]
    assert one(spark, data, "a double", money.amount_risk_level(F.col("a"))) == [None, 1, 1, 2, 2, 3, 4, None]
    data = [(x,) for x in (50000.0, 50000.01, 100000.0, 100000.01)]
    assert one(spark, data, "a double", money.serving_amount_level(F.col("a"))) == [0, 1, 1, 2]


def test_hour_flags(spark):
    hours = (9, 10, 11, 13, 14, 16, 17)
    data = [(h,) for h in hours]
    assert one(spark, data, "h int", times.is_peak_hours(F.col("h"))) == [1, 1, 1, 0, 1, 1, 0]
    assert one(spark, data, "h int", times.is_peak_withdrawal(F.col("h"))) == [0, 1, 1, 1, 1, 1, 0]
    night = [(h,) for h in (6, 7, 21, 22)]
    assert one(spark, night, "h int", times.is_night_time(F.col("h"))) == [1, 0, 0, 1]
    office = [(8, 0), (9, 0), (17, 0), (18, 0), (10, 5)]
    assert one(spark, office, "h int, d int", times.is_business_hours(F.col("h"))) == [0, 1, 1, 0, 1]
    assert one(spark, office, "h int, d int", times.is_business_hours(F.col("h"), F.col("d"))) == [0, 1, 1, 0, 0]
    parts = [(h,) for h in (0, 6, 7, 11, 12, 17, 18, 23)]
    got = one(spark, parts, "h int", times.day_part(F.col("h")))
    assert got == ["late_night"] * 2 + ["morning"] * 2 + ["afternoon"] * 2 + ["evening"] * 2


def test_days_and_months(spark):
    data = [("2024-01-05",), ("2024-01-06",), ("2024-01-07",), ("2024-01-08",)]
    day = times.day_of_week(F.col("d").cast("timestamp"))
    assert rows(spark, data, "d string", day, times.is_weekend(day)) == [(4, 0), (5, 1), (6, 1), (0, 0)]
    months = [(m,) for m in (1, 4, 7, 10, 11)]
    assert one(spark, months, "m int", times.season_multiplier(F.col("m"))) == [1.4, 1.1, 0.8, 1.0, 1.4]
    assert one(spark, months, "m int", times.dashboard_season_multiplier(F.col("m"))) == [1.3, 1.0, 1.0, 1.0, 1.3]


def test_time_text(spark):
    data = [("2024-03-05T07:08:09",), ("2024-03-05T07:08:09.000120",)]
    ts = times.parse_timestamp(F.col("t"))
    assert one(spark, data, "t string", times.iso_text(ts)) == [d[0] for d in data]
    assert one(spark, data[:1], "t string", times.month_label(ts)) == ["Mar 2024"]
    assert one(spark, data[:1], "t string", times.hour_label(times.hour(ts))) == ["07:00"]


def test_bad_timestamp_fails(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|CANNOT_PARSE_TIMESTAMP"):
        one(spark, [("not a time",)], "t string", times.parse_timestamp(F.col("t")))


def test_hour_factor(spark):
    data = [(h,) for h in (6, 7, 10, 16, 17, 18, 22, 23)]
    assert one(spark, data, "h int", risk.hour_factor(F.col("h"))) == [0.8, 1.0, 1.2, 1.2, 1.0, 1.1, 1.1, 1.0]


def test_city_factor(spark):
    data = [(28.6, 77.2 + d) for d in (0.49, 0.51, 0.99, 1.01)]
    assert one(spark, data, "y double, x double", geo.city_factor(F.col("y"), F.col("x"))) == [1.1, 1.05, 1.05, 1.0]
    box = [(28.6 + 0.29, 77.2 - 0.29), (28.6 + 0.31, 77.2)]
    assert one(spark, box, "y double, x double", geo.in_major_city_box(F.col("y"), F.col("x"))) == [1, 0]


def test_haversine(spark):
    data = [(10.0, 20.0, 10.0, 20.0), (0.0, 0.0, 0.0, 180.0), (28.6, 77.2, 19.0, 72.8), (19.0, 72.8, 28.6, 77.2)]
    cols = [F.col(c) for c in "abcd"]
    same, opposite, there, back = one(
        spark, data, "a double, b double, c double, d double", geo.haversine_km(*cols)
    )
    assert same == 0 and there == pytest.approx(back)
    assert opposite == pytest.approx(math.pi * 6371)
    a, b, turn = math.radians(28.6), math.radians(19.0), math.radians(77.2 - 72.8)
    angle = math.acos(math.sin(a) * math.sin(b) + math.cos(a) * math.cos(b) * math.cos(turn))
    assert there == pytest.approx(angle * 6371, rel=1e-9)


def test_risk_levels_and_bands(spark):
    data = [(0.7,), (0.701,), (0.4,), (0.8,), (0.5,)]
    p = F.col("p")
    assert one(spark, data, "p double", risk.risk_level(p, 0.7, 0.4)) == ["MEDIUM", "HIGH", "LOW", "HIGH", "MEDIUM"]
    assert one(spark, data, "p double", risk.risk_level(p, 0.8, 0.5)) == ["MEDIUM", "MEDIUM", "LOW", "MEDIUM", "LOW"]
    low, high = risk.hours_band(p)
    bands = [(0.81,), (0.8,), (0.6,), (0.4,)]
    assert rows(spark, bands, "p double", low, high) == [(2, 8), (6, 18), (12, 36), (24, 72)]


def test_model_outputs(spark):
    p = F.col("p")
    assert one(spark, [(0.99,), (0.1,), (0.77,)], "p double", risk.model_hours(p)) == [1, 19, 1]
    assert one(spark, [(0.0,), (1.0,), (0.5,)], "p double", risk.clamp_probability(p)) == [0.1, 0.99, 0.5]
    data = [("High", 0.5), ("Medium", 0.5), ("Low", 0.5)]
    assert one(spark, data, "u string, p double", risk.urgency_hours(p, F.col("u"))) == [4, 9, 18]
    assert one(spark, [("HIGH",), ("MEDIUM",), ("LOW",)], "l string", risk.level_radius_km(F.col("l"))) == [2.0, 5.0, 10.0]


def test_unknown_urgency_is_half(spark):
    data = [("High", 0.0), ("odd", 0.0), (None, 0.0)]
    assert one(spark, data, "u string, a double", risk.base_risk(F.col("a"), F.col("u"))) == [0.4, 0.25, 0.25]


def test_urgency_and_bank_alert(spark):
    data = [(200000.0, "Phishing"), (200000.01, "Phishing"), (50000.0, "Phishing"), (1.0, "Digital Payment Fraud")]
    got = one(spark, data, "a double, c string", money.urgency_level(F.col("a"), F.col("c")))
    assert got == ["Medium", "High", "Low", "High"]
    data = [(50000.0, "Low"), (50001.0, "Low"), (1.0, "High")]
    assert one(spark, data, "a double, u string", money.requires_bank_alert(F.col("a"), F.col("u"))) == [0, 1, 1]


def test_texts(spark):
    data = [(2024, 7), (2024, 1234567)]
    assert one(spark, data, "y int, n long", texts.complaint_id(F.col("y"), F.col("n"))) == ["CG2024000007", "CG20241234567"]
    assert one(spark, [("high_risk",)], "s string", texts.title_words(F.col("s"))) == ["High Risk"]
    phone = [("+91-9812345678",), (None,)]
    assert one(spark, phone, "p string", texts.hide_phone(F.col("p"))) == ["+91-XXXXXXXXXX", None]
    assert one(spark, phone, "p string", texts.mask_phone_digits(F.col("p"))) == ["+91-XXXXXXXXXX", None]
    assert one(spark, [(1234567.0,)], "x double", money.thousands(F.col("x"))) == ["1,234,567"]
    message = texts.alert_message(F.lit(28.61239), F.lit(77.2), F.lit(4))
    assert one(spark, [(1,)], "i int", message) == [
        "HIGH RISK: Withdrawal predicted at (28.6124, 77.2000) within 4 hours"
    ]


def test_draws_are_uniform_and_repeatable(spark):
    keys = spark.range(20000)
    first = keys.select(F.avg(draws.draw(F.col("id"), "a")), F.min(draws.draw(F.col("id"), "a")), F.max(draws.draw(F.col("id"), "a"))).first()
    assert first[0] == pytest.approx(0.5, abs=0.01) and first[1] >= 0 and first[2] < 1
    again = keys.repartition(7).select(F.avg(draws.draw(F.col("id"), "a"))).first()[0]
    assert again == pytest.approx(first[0], abs=1e-12)
