"""Geodesic column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadloom.config import EARTH_RADIUS_M

METRES_PER_DEGREE = EARTH_RADIUS_M * 3.141592653589793 / 180.0


def haversine_m(lat1: str, lon1: str, lat2: str, lon2: str) -> Column:
    """Great-circle metres between two points given as SQL expressions; null where one is null."""
    a = (
        f"pow(sin(radians(({lat2}) - ({lat1})) / 2), 2)"
        f" + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians(({lon2}) - ({lon1})) / 2), 2)"
    )
    # rounding may lift antipodes above 1
    a = f"(CASE WHEN {a} > 1 THEN 1D ELSE {a} END)"
    return F.expr(f"{2.0 * EARTH_RADIUS_M!r}D * atan2(sqrt({a}), sqrt(1 - {a}))")


def project_x_m(lon, centre_lat, centre_lon) -> Column:
    return F.lit(EARTH_RADIUS_M) * F.radians(lon - centre_lon) * F.cos(F.radians(centre_lat))


def project_y_m(lat, centre_lat) -> Column:
    return F.lit(EARTH_RADIUS_M) * F.radians(lat - centre_lat)


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing, degrees clockwise from north in [0, 360)."""
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    east = F.sin(dl) * F.cos(p2)
    north = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(east, north)) + 360.0, F.lit(360.0))


def shifted_lat(lat, bearing, metres) -> Column:
    p, b, d = F.radians(lat), F.radians(bearing), metres / F.lit(EARTH_RADIUS_M)
    return F.degrees(F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b)))


def shifted_lon(lat, lon, bearing, metres) -> Column:
    p, b, d = F.radians(lat), F.radians(bearing), metres / F.lit(EARTH_RADIUS_M)
    p2 = F.radians(shifted_lat(lat, bearing, metres))
    turn = F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(p2))
    return F.degrees(F.radians(lon) + turn)


def edge_fraction(px, py, ax, ay, bx, by) -> Column:
    """Clamped fraction along a->b of the point nearest to p; 0 for a zero-length edge."""
    len2 = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    along = ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / len2
    return F.when(len2 == 0.0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), along)))


def edge_distance(px, py, ax, ay, bx, by) -> Column:
    """Planar distance from p to the edge a->b."""
    t = edge_fraction(px, py, ax, ay, bx, by)
    dx, dy = px - (ax + t * (bx - ax)), py - (ay + t * (by - ay))
    return F.sqrt(dx * dx + dy * dy)
