"""Scalar functions: timestamps from text, and distances on the globe."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def parse_timestamp(text: Column) -> Column:
    """Of Unix milliseconds, `YYYY-MM-DD HH:MM:SS[.fff]`, basic ISO `YYYYMMDDTHHMMSS[.ffffff]`, or extended ISO whose zone is ignored; null otherwise."""
    basic = F.regexp_replace(text, r"^(\d{4})(\d\d)(\d\d)T(\d\d)(\d\d)(\d\d)", r"$1-$2-$3 $4:$5:$6")
    plain = F.regexp_replace(F.regexp_replace(basic, "T", " "), r"[+-]\d{2}:?\d{2}$|Z$", "")
    return F.when(text.rlike(r"^\d+$"), F.timestamp_millis(text.try_cast("long"))).otherwise(plain.try_cast("timestamp"))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * F.lit(EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))
