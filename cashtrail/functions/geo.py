"""Distances, boxes and grid keys over latitude / longitude columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cashtrail.functions import numbers

# fixed values
EARTH_RADIUS_KM = 6371.0
KM_PER_DEGREE = 111.32
MAJOR_CITY_POINTS = (
    ("Delhi", 28.6, 77.2),
    ("Mumbai", 19.0, 72.8),
    ("Bangalore", 12.9, 77.6),
    ("Chennai", 13.0, 80.2),
    ("Kolkata", 22.5, 88.3),
)
HIGH_RISK_JURISDICTIONS = ("mumbai", "delhi", "bangalore", "hyderabad")


def haversine_km(lat_a: Column, lng_a: Column, lat_b: Column, lng_b: Column) -> Column:
    """Great-circle distance; missing where a coordinate is."""
    half_lat = F.sin(F.radians(lat_b - lat_a) / 2)
    half_lng = F.sin(F.radians(lng_b - lng_a) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * half_lng * half_lng
    distance = 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(F.lit(1.0), chord)))
    return F.when(numbers.all_known(lat_a, lng_a, lat_b, lng_b), distance)


def planar_km(lat_a: Column, lng_a: Column, lat_b: Column, lng_b: Column) -> Column:
    dlat, dlng = lat_a - lat_b, lng_a - lng_b
    return F.sqrt(dlat * dlat + dlng * dlng) * KM_PER_DEGREE


def degrees_to_major_city(lat: Column, lng: Column) -> Column:
    """Manhattan distance in degrees to the closest of the five city points; missing without a place."""
    closest = F.least(*[F.abs(lat - y) + F.abs(lng - x) for _, y, x in MAJOR_CITY_POINTS])
    return F.when(numbers.all_known(lat, lng), closest)


def city_factor(lat: Column, lng: Column) -> Column:
    """Risk multiplier: 1.1 within half a degree of a major city, 1.05 within one, else 1.

    The points lie more than two degrees apart, so at most one can be within
    one degree and the closest decides. Half degrees index the three factors,
    which mentions the long distance expression once; generated code stays
    small enough to be compiled.
    """
    half_degrees = F.least(F.floor(degrees_to_major_city(lat, lng) * 2), F.lit(2)).cast("int")
    factor = F.get(F.array(F.lit(1.1), F.lit(1.05), F.lit(1.0)), half_degrees)
    return F.when(numbers.all_known(lat, lng), factor)


def in_major_city_box(lat: Column, lng: Column, half_side: float = 0.3) -> Column:
    hit = F.lit(False)
    for _, y, x in MAJOR_CITY_POINTS:
        hit = hit | ((F.abs(lat - y) < half_side) & (F.abs(lng - x) < half_side))
    return hit.cast("int")


def grid_key(degrees: Column, digits: int = 2) -> Column:
    return F.round(degrees, digits)


def in_high_risk_jurisdiction(name: Column) -> Column:
    return F.coalesce(F.lower(name).isin(*HIGH_RISK_JURISDICTIONS), F.lit(False)).cast("int")
