"""Coordinates: degree-space distance, cells, and the text forms of metadata tools."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import KM_PER_DEGREE

_DMS = r"^\s*(\d+(?:\.\d+)?)\s*deg\s*(\d+(?:\.\d+)?)'\s*(\d+(?:\.\d+)?)\"\s*([NSEWnsew])\s*\z"


def squared_degrees(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return (lat1 - lat2) * (lat1 - lat2) + (lon1 - lon2) * (lon1 - lon2)


def rough_km(squared: Column) -> Column:
    return F.sqrt(squared) * KM_PER_DEGREE


def cell_key(x: Column, factor: int = 100) -> Column:
    """Hundredths of a degree, halves away from zero."""
    y = x * factor
    return (F.signum(y) * F.floor(F.abs(y) + 0.5)).cast("long")


def grid(x: Column, step: float) -> Column:
    return F.floor(x / step).cast("long")


def parse_dms(x: Column) -> Column:
    """Degrees, minutes, seconds and hemisphere as signed degrees; null for anything else."""
    part = lambda i: F.regexp_extract(x, _DMS, i).try_cast("double")
    size = part(1) + part(2) / 60 + part(3) / 3600
    return F.when(F.upper(F.regexp_extract(x, _DMS, 4)).isin("S", "W"), -size).otherwise(size)
