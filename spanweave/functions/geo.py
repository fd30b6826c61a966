"""Geographic column expressions; all stay in the JVM."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
METRES_PER_DEGREE = 111_320.0
HILBERT_ORDER = 16


def _c(v: Column | str | float) -> Column:
    return v if isinstance(v, Column) else F.col(v) if isinstance(v, str) else F.lit(float(v))


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def ring(points: Sequence[tuple[float, float]]) -> Column:
    """Literal polygon ring of (lat, lon)."""
    return F.array(*[F.struct(F.lit(float(a)).alias("lat"), F.lit(float(o)).alias("lon")) for a, o in points])


def point_in_polygon(lat, lon, boundary: Column | str) -> Column:
    """Parity of ring edges that a ray towards growing longitude crosses; edges are half open in latitude, the ring closes itself, fewer than 3 vertices hold nothing."""
    lat, lon = _c(lat), _c(lon)
    boundary = F.col(boundary) if isinstance(boundary, str) else boundary
    n = F.size(boundary)

    def crosses(v: Column, i: Column) -> Column:
        w = F.element_at(boundary, F.when(i == 0, n).otherwise(i).cast("int"))
        straddles = (v["lat"] > lat) != (w["lat"] > lat)
        return straddles & (lon < (w["lon"] - v["lon"]) * (lat - v["lat"]) / F.when(straddles, w["lat"] - v["lat"]).otherwise(1.0) + v["lon"])

    return (n >= 3) & (F.size(F.filter(boundary, crosses)) % 2 == 1)


def bounding_box(points: Sequence[tuple[float, float]]) -> tuple[float, float, float, float]:
    """(least lat, greatest lat, least lon, greatest lon), for a filter that reaches the scan."""
    return min(p[0] for p in points), max(p[0] for p in points), min(p[1] for p in points), max(p[1] for p in points)


def within(lat, lon, points: Sequence[tuple[float, float]]) -> Column:
    """Point in a literal polygon, bounding box first."""
    lat, lon = _c(lat), _c(lon)
    if len(points) < 3:
        return F.lit(False)
    a, b, c, d = bounding_box(points)
    return lat.between(a, b) & lon.between(c, d) & point_in_polygon(lat, lon, ring(points))


def project_to_segment(lat, lon, lat_a, lon_a, lat_b, lon_b) -> Column:
    """Nearest point of a short segment in the plane around its first end: struct of lat, lon, t in [0, 1], distance_m."""
    lat, lon, lat_a, lon_a, lat_b, lon_b = map(_c, (lat, lon, lat_a, lon_a, lat_b, lon_b))
    k = F.cos(F.radians(lat_a))
    dx, dy = (lon_b - lon_a) * k, lat_b - lat_a
    size = dx * dx + dy * dy
    t = F.when(size < 1e-20, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((lon - lon_a) * k * dx + (lat - lat_a) * dy) / size)))
    p_lat, p_lon = lat_a + t * (lat_b - lat_a), lon_a + t * (lon_b - lon_a)
    return F.struct(p_lat.alias("lat"), p_lon.alias("lon"), t.alias("t"), haversine(lat, lon, p_lat, p_lon).alias("distance_m"))


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing in radians, from 0 up to a full turn."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    out = F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))
    return F.when(out < 0, out + 2 * math.pi).otherwise(out)


def circle(lat: float, lon: float, radius_m: float, sides: int = 8) -> list[tuple[float, float]]:
    """Closed ring of an inscribed regular polygon, an octagon by default."""
    r, k = radius_m / METRES_PER_DEGREE, math.cos(math.radians(lat))
    out = [(lat + r * math.cos(2 * math.pi * i / sides), lon + r / k * math.sin(2 * math.pi * i / sides)) for i in range(sides)]
    return [*out, out[0]]


def hilbert_index(x: Column, y: Column, order: int = HILBERT_ORDER) -> Column:
    """Place of a cell on the Hilbert curve, x and y in [0, 2^order); one step a bit, from the highest."""
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def step(acc: Column, s: Column) -> Column:
        side = F.expr("bigint(1)") * F.pow(F.lit(2), s).cast("long")
        px, py = F.floor(acc["x"] / side) % 2, F.floor(acc["y"] / side) % 2
        cell = F.when(px == 0, F.when(py == 0, 0).otherwise(1)).otherwise(F.when(py == 1, 2).otherwise(3))
        # lower bits of the quadrant, turned
        lx, ly = acc["x"] % side, acc["y"] % side
        fx, fy = F.when(px == 1, side - 1 - lx).otherwise(lx), F.when(px == 1, side - 1 - ly).otherwise(ly)
        return F.struct(F.when(py == 0, fy).otherwise(lx).cast("long").alias("x"), F.when(py == 0, fx).otherwise(ly).cast("long").alias("y"), (acc["d"] + cell * side * side).cast("long").alias("d"))

    return F.aggregate(F.array(*[F.lit(s) for s in range(order - 1, -1, -1)]), start, step, lambda acc: acc["d"])
