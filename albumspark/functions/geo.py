"""Coordinates, distances and regions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
# Region, least and greatest latitude, least and greatest longitude, in order of precedence. Bounds hold
# unless they are marked open.
REGIONS = (
    ("Oceania", "lat BETWEEN -50 AND -10 AND lon BETWEEN 110 AND 180"),
    ("N.America", "lat BETWEEN 10 AND 72 AND lon BETWEEN -170 AND -50"),
    ("S.America", "lat BETWEEN -55 AND 15 AND lon BETWEEN -85 AND -35"),
    ("Africa", "lat BETWEEN -35 AND 15 AND lon BETWEEN -20 AND 52"),
    ("Africa", "lat > 15 AND lat < 35 AND lon BETWEEN -20 AND 35"),
    ("Asia", "lat >= 5 AND lat < 35 AND lon BETWEEN 35 AND 150"),
    ("Asia", "lat BETWEEN 35 AND 72 AND lon BETWEEN 50 AND 180"),
    ("Europe", "lat BETWEEN 35 AND 72 AND lon >= -25 AND lon < 50"),
)
# The greatest share of a selection that a region may have.
REGION_SHARE = {"Europe": 0.40, "Asia": 0.25, "N.America": 0.10, "Africa": 0.10, "S.America": 0.08, "Oceania": 0.02, "Other": 0.05}


def coordinates(lat: Column, lon: Column, lat_ref: Column, lon_ref: Column) -> Column:
    """struct(lat, lon) from numbers or texts, signed by hemisphere; null if missing, not numeric or out of range."""
    a, b = lat.cast("string").try_cast("double"), lon.cast("string").try_cast("double")
    a = F.when((lat_ref == "S") & (a > 0), -a).otherwise(a)
    b = F.when((lon_ref == "W") & (b > 0), -b).otherwise(b)
    return F.when(a.between(-90, 90) & b.between(-180, 180), F.struct(a.alias("lat"), b.alias("lon")))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def region(lat: str = "lat", lon: str = "lon") -> Column:
    """The region of a point, by the first box that holds it."""
    cases = " ".join(f"WHEN {box.replace('lat', f'`{lat}`').replace('lon', f'`{lon}`')} THEN '{name}'" for name, box in REGIONS)
    return F.expr(f"CASE {cases} ELSE 'Other' END")
