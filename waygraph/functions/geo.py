"""Geographic scalar functions as column expressions. Coordinates at rest are whole micro-degrees."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres: radius of the sphere for great-circle distances, and of the Web-Mercator projection.
EARTH_RADIUS, MERCATOR_RADIUS = 6_371_000.0, 6_378_137.0


def to_udeg(degrees: Column) -> Column:
    """Micro-degrees; halves go away from zero."""
    return F.round(degrees * 1e6).cast("int")


def to_degrees(udeg: Column) -> Column:
    return udeg / F.lit(1e6)


def to_radians(udeg: Column) -> Column:
    return F.radians(to_degrees(udeg))


def point(lat_degrees: Column, lon_degrees: Column) -> Column:
    return F.struct(to_udeg(lat_degrees).alias("lat_udeg"), to_udeg(lon_degrees).alias("lon_udeg"))


def mercator_x(lon_udeg: Column) -> Column:
    return F.lit(MERCATOR_RADIUS) * to_radians(lon_udeg)


def mercator_y(lat_udeg: Column) -> Column:
    return F.lit(MERCATOR_RADIUS) * F.ln(F.tan(F.lit(pi / 4) + to_radians(lat_udeg) / 2))


def inverse_mercator_lat(y: Column) -> Column:
    """Micro-degrees."""
    return to_udeg(F.degrees(F.lit(2.0) * F.atan(F.exp(y / F.lit(MERCATOR_RADIUS))) - F.lit(pi / 2)))


def inverse_mercator_lon(x: Column) -> Column:
    return to_udeg(F.degrees(x / F.lit(MERCATOR_RADIUS)))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points in micro-degrees."""
    a1, a2 = to_radians(lat1), to_radians(lat2)
    h = F.pow(F.sin((a2 - a1) / 2), F.lit(2.0)) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((to_radians(lon2) - to_radians(lon1)) / 2), F.lit(2.0))
    return F.lit(2 * EARTH_RADIUS) * F.asin(F.sqrt(h))


def nearest_t(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Where on the segment, from 0 to 1, it is nearest to the point; 0 for a segment without length."""
    dx, dy = x2 - x1, y2 - y1
    t = F.try_divide((px - x1) * dx + (py - y1) * dy, dx * dx + dy * dy)
    return F.least(F.greatest(F.coalesce(t, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def at_t(t: Column, a: Column, b: Column) -> Column:
    """The coordinate at t, and exactly b at 1, so that segments that meet agree on their common end."""
    return F.when(t >= 1.0, b).otherwise(a + t * (b - a))


def length2(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)


def envelope(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(F.least(x1, x2).alias("min_x"), F.least(y1, y2).alias("min_y"), F.greatest(x1, x2).alias("max_x"), F.greatest(y1, y2).alias("max_y"))


def edge_position(d_source: Column, d_target: Column) -> Column:
    """Distance share from the source, as FLOAT; null on an edge without length."""
    return F.try_divide(d_source, d_source + d_target).cast("float")


def partial_costs(distance: Column, position: Column) -> tuple[Column, Column]:
    """Whole metres from the position to the edge's target, and from its source to the position; 0 if the position is null."""
    d = distance.cast("float")
    rest = F.coalesce((d * (F.lit(1.0).cast("float") - position)).cast("bigint"), F.lit(0).cast("bigint"))
    done = F.coalesce((d * position).cast("bigint"), F.lit(0).cast("bigint"))
    return rest, done
