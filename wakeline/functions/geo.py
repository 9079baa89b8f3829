"""Distances and angles on the sphere as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from wakeline.settings import EARTH_KM


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle km; the root is held at 1 so that antipodes give no NaN."""
    up, across = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(up) * F.sin(up) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(across) * F.sin(across)
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """First course from one place to the other, 0 to 360."""
    across = F.radians(lon2 - lon1)
    y = F.sin(across) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(across)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def angle_between(a: Column, b: Column) -> Column:
    """Smallest angle of two courses, 0 to 180."""
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, F.lit(360.0) - d)


def ewkt(lat: Column, lon: Column, places: int | None = None) -> Column:
    """`SRID=4326;POINT(lon lat)`; null where either is."""
    text = (lambda c: c.cast("string")) if places is None else (lambda c: F.format_string(f"%.{places}f", c))
    return F.when(lat.isNotNull() & lon.isNotNull(), F.concat(F.lit("SRID=4326;POINT("), text(lon), F.lit(" "), text(lat), F.lit(")")))


def point_of(text: Column) -> Column:
    """lat and lon of such a text; null for any other."""
    form = r"^(?:SRID=\d+;)?POINT\s*\(\s*(\S+)\s+(\S+)\s*\)$"
    number = lambda i: F.regexp_extract(text, form, i).try_cast("double")
    return F.when(text.rlike(form) & number(1).isNotNull() & number(2).isNotNull(), F.struct(number(2).alias("lat"), number(1).alias("lon")))


def as_geojson(polygons: Column) -> Column:
    """Polygons (arrays of rings of [lon, lat]) as a MultiPolygon's text."""
    return F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), polygons.alias("coordinates")))
