"""Grid cells over latitude/longitude, so that radius predicates become equi joins.

Rows are strips of equal latitude height. Each row has its own longitude width, taken at
the row's edge nearest the equator, so a cell is never larger than its nominal size in
metres. ``cover`` lists every cell that a point within the reach can fall in.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.config import EARTH_RADIUS_M
from roadloom.functions.geo import METRES_PER_DEGREE

SLACK = 1.000001
HAIR = 1e-9


def _step(size_m: float | str) -> str:
    """Row height in degrees; a size may also be an SQL expression."""
    return f"(({size_m}) / {METRES_PER_DEGREE!r}D)" if isinstance(size_m, str) else f"{size_m / METRES_PER_DEGREE!r}D"


def _row(lat: str, size_m: float | str) -> str:
    return f"floor(({lat}) / {_step(size_m)})"


def _col(lon: str, row: str, size_m: float | str) -> str:
    step = _step(size_m)
    nearest = f"least(90D, greatest(0D, {row} * {step}, -(({row} + 1) * {step})))"
    return f"floor(({lon}) / ({step} / greatest(1e-6D, cos(radians({nearest})))))"


def key(lat: str, lon: str, size_m: float | str) -> Column:
    """The cell of a point as struct(r, c). Arguments are SQL expressions."""
    row = _row(lat, size_m)
    return F.expr(f"named_struct('r', {row}, 'c', {_col(lon, row, size_m)})")


def cover_box(lat1: str, lat2: str, lon1: str, lon2: str, reach_m: float, size_m: float | str) -> Column:
    """All cells within ``reach_m`` of the box lat1..lat2 x lon1..lon2, as an array of structs."""
    pad = reach_m * SLACK / METRES_PER_DEGREE
    south, north = f"(({lat1}) - {pad!r}D)", f"(({lat2}) + {pad!r}D)"
    pad_lon = f"({pad!r}D / greatest(1e-6D, cos(radians(least(90D, greatest(abs({south}), abs({north})))))))"
    west, east = f"(({lon1}) - {pad_lon})", f"(({lon2}) + {pad_lon})"
    # a range that crosses the date line is also entered from the other side
    ranges = f"""filter(array(
        named_struct('a', greatest({west}, -180D), 'b', least({east}, 180D)),
        named_struct('a', -180D, 'b', least({east} - 360D, 180D)),
        named_struct('a', greatest({west} + 360D, -180D), 'b', 180D)), x -> x.a <= x.b)"""
    cols = f"sequence({_col('x.a', 'r', size_m)}, {_col('x.b', 'r', size_m)})"
    return F.expr(
        f"""array_distinct(flatten(transform(sequence({_row(south, size_m)}, {_row(north, size_m)}),
        r -> flatten(transform({ranges}, x -> transform({cols}, c -> named_struct('r', r, 'c', c)))))))"""
    )


def cover(lat: str, lon: str, reach_m: float, size_m: float | str) -> Column:
    return cover_box(lat, lat, lon, lon, reach_m, size_m)


def extents(df: DataFrame, keys: Sequence[str], *more: Column) -> DataFrame:
    """One row per ``keys``: extent in degrees, ``more`` aggregates."""
    return df.groupBy(*keys).agg(
        F.min("lat").alias("lat1"), F.max("lat").alias("lat2"), F.min("lon").alias("lon1"), F.max("lon").alias("lon2"), *more
    )


def _angles(at: str) -> list[str]:
    return [
        f"radians({at}lat1) AS y1", f"radians({at}lat2) AS y2", f"radians({at}lon1) AS x1", f"radians({at}lon2) AS x2",
        f"least(cos(radians({at}lat1)), cos(radians({at}lat2))) AS c_low",
        f"CASE WHEN {at}lat1 < 0 AND {at}lat2 > 0 THEN 1D ELSE greatest(cos(radians({at}lat1)), cos(radians({at}lat2))) END AS c_high",
    ]


def angles(at: str) -> Column:
    """What ``verdict`` needs of the extent ``at``lat1..``at``lon2, so that a shuffle need not carry it."""
    return F.expr(f"struct({', '.join(_angles(at))})")


def summarise(df: DataFrame, keys: Sequence[str], *more: Column) -> DataFrame:
    """One row per ``keys``: extent in degrees and radians, range of cos(lat), ``more`` aggregates."""
    return extents(df, keys, *more).selectExpr("*", *_angles(""))


def verdict(radius_m: float) -> Column:
    """How the points of extents ``p`` and ``q`` lie to the radius: 1 all within, 0 undecided, -1 none.

    Compares squared half chords, which grow with the distance. A hair around the radius is
    left undecided, so that only the exact formula decides there.
    """
    half = "(sin(({0}) / 2) * sin(({0}) / 2))".format
    turn = f"(CASE WHEN q.x1 - p.x1 > {math.pi!r}D THEN {2 * math.pi!r}D WHEN p.x1 - q.x1 > {math.pi!r}D THEN {-2 * math.pi!r}D ELSE 0D END)"
    qx1, qx2 = f"(q.x1 - {turn})", f"(q.x2 - {turn})"
    low = f"{half('greatest(0D, q.y1 - p.y2, p.y1 - q.y2)')} + p.c_low * q.c_low * {half(f'greatest(0D, {qx1} - p.x2, p.x1 - {qx2})')}"
    high = f"{half('greatest(q.y2 - p.y1, p.y2 - q.y1)')} + p.c_high * q.c_high * {half(f'greatest({qx2} - p.x1, p.x2 - {qx1})')}"
    edge = math.sin(radius_m / (2.0 * EARTH_RADIUS_M)) ** 2
    return F.expr(
        f"CASE WHEN {high} <= {edge * (1.0 - HAIR)!r}D THEN 1 WHEN {low} > {edge * (1.0 + HAIR)!r}D THEN -1 ELSE 0 END"
    )
