"""Distances on the globe."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The diameter in km for ranking, the radius in metres for nearest stops.
DIAMETER_KM, RADIUS_M = 12742.0, 6371008.8


def half_chord(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    dlat, dlng = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    return F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlng), 2)


def km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    return DIAMETER_KM * F.asin(F.sqrt(half_chord(lat1, lng1, lat2, lng2)))


def metres(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    return F.round(2 * RADIUS_M * F.asin(F.sqrt(half_chord(lat1, lng1, lat2, lng2))))


KM_SQL = "12742.0 * asin(sqrt(pow(sin(radians({1}.lat - {0}.lat) / 2), 2) + cos(radians({0}.lat)) * cos(radians({1}.lat)) * pow(sin(radians({1}.lng - {0}.lng) / 2), 2)))"
