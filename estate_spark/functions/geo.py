"""Distances and the similarity score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
EARTH_RADIUS_KM = 6371.0
AREA_SCALE_M2, ROOMS_WEIGHT = 20.0, 0.7


def haversine_km(lat0: Column, lon0: Column, lat1: Column, lon1: Column) -> Column:
    p0, p1 = F.radians(lat0), F.radians(lat1)
    sin_lat = F.sin((p1 - p0) / 2.0)
    sin_lon = F.sin((F.radians(lon1) - F.radians(lon0)) / 2.0)
    a = sin_lat * sin_lat + F.cos(p0) * F.cos(p1) * sin_lon * sin_lon
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.asin(F.sqrt(a))


def score(distance_km: Column, area_diff: Column, rooms_diff: Column) -> Column:
    return distance_km + area_diff / AREA_SCALE_M2 + F.lit(ROOMS_WEIGHT) * rooms_diff
