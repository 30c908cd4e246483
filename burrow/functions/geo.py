"""Places: boxes around circles, and circles."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EARTH_KM = 6371.0087714


def in_box(lat: Column, lon: Column, at_lat: float, at_lon: float, radius_km: float) -> Column:
    """Whether a place lies in the box of latitudes and longitudes around a circle, across the date line and the poles."""
    turn = radius_km / EARTH_KM
    dlat = math.degrees(turn)
    rows = lat.between(at_lat - dlat, at_lat + dlat)
    if at_lat + dlat >= 90 or at_lat - dlat <= -90:
        return rows
    dlon = math.degrees(math.asin(math.sin(turn) / math.cos(math.radians(at_lat))))
    low, high = at_lon - dlon, at_lon + dlon
    if low < -180:
        return rows & ((lon >= low + 360) | (lon <= high))
    if high > 180:
        return rows & ((lon >= low) | (lon <= high - 360))
    return rows & lon.between(low, high)


def distance_km(lat: Column, lon: Column, at_lat: float, at_lon: float) -> Column:
    """Great-circle distance by the haversine formula."""
    a = F.pow(F.sin(F.radians(lat - at_lat) / 2), 2) + F.cos(F.radians(lat)) * math.cos(math.radians(at_lat)) * F.pow(
        F.sin(F.radians(lon - at_lon) / 2), 2
    )
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))
