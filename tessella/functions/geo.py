"""Distances on the sphere, in miles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: mean radius of the earth in miles.
RADIUS = 3958.8
#: Bands of a search around a place: here, near, around.
BANDS = (0.5, 5.0, 15.0)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def nearest_point(points: Column, lat: Column, lon: Column) -> Column:
    """Distance from (lat, lon) to the nearest of an array of (lat, lon) structs; null for an empty array."""
    return F.array_min(F.transform(points, lambda p: haversine(p["lat"], p["lon"], lat, lon)))


def band(distance: Column) -> Column:
    here, near, around = BANDS
    return F.when(distance < here, 0).when(distance <= near, 1).when(distance <= around, 2).otherwise(3)


def box(lat: Column, lon: Column, centre_lat: Column, centre_lon: Column, miles: float) -> Column:
    """A cheap necessary condition for lying within `miles`: a test on ranges, before the exact distance."""
    degrees = miles / 69.0
    wide = F.lit(degrees) / F.greatest(F.cos(F.radians(centre_lat)), F.lit(0.01))
    return lat.between(centre_lat - degrees, centre_lat + degrees) & lon.between(centre_lon - wide, centre_lon + wide)
