"""Numeric columns: tolerant parsing, shares, intervals, distances, buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: Values at or below this stand for "no value".
NO_VALUE = -1e8


def parse_number(text: Column) -> Column:
    """Commas dropped; blank and bad give null."""
    return F.regexp_replace(F.trim(text), ",", "").try_cast("double")


def coded_number(text: Column) -> Column:
    """``250,000+`` and ``2,500-`` are their bounds, ``-`` and sentinels null."""
    value = F.regexp_replace(F.regexp_replace(F.trim(text), ",", ""), r"[+-]$", "").try_cast("double")
    return F.when(F.trim(text) == "-", None).when(value <= NO_VALUE, None).otherwise(value)


def share(part: Column, whole: Column) -> Column:
    """Null where the whole is null or 0."""
    return F.when(whole.isNull() | (whole == 0), None).otherwise(part / whole)


def sum_where_row(matched: Column, *parts: Column) -> Column:
    """Nulls skipped; null where there is no row at all."""
    total = sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(0))
    return F.when(matched, total)


def wilson(good: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The 95 % interval of a proportion, rounded to 3 digits; of nothing, everything from 0 to 1."""
    p, zz = good / F.nullif(n, F.lit(0)), z * z
    middle = (p + zz / (2 * n)) / (1 + zz / n)
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    guard = lambda x, nothing: F.when(n > 0, F.round(x, 3)).when(n == 0, nothing)
    return guard(F.greatest(F.lit(0.0), middle - half), 0.0), guard(F.least(F.lit(1.0), middle + half), 1.0)


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(a))


def degrees_km(degrees: Column, lat: Column) -> Column:
    return degrees * 111.32 * F.cos(F.radians(lat))


def bucket_of(value: Column, cuts: Sequence[float]) -> Column:
    """Half-open buckets 0..n: a value at a cut is above it; null stays null."""
    return F.when(value.isNull(), None).otherwise(sum(((value >= c).cast("int") for c in cuts), F.lit(0)))


def linear_price(units: Sequence[tuple[Column, float]], per: float = 1e6) -> Column:
    """Units at their prices per million."""
    return sum((F.coalesce(u, F.lit(0)) * F.lit(p / per) for u, p in units), F.lit(0.0))
