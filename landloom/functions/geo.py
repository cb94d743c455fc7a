"""Planar geometry as Column expressions.

A ring is an array of ``struct<x, y>`` whose last point repeats the first; a polygon is an array of rings, of which
even-odd counting makes holes; a path is an array of points. Coordinates are scene metres.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def edges(points: Column) -> Column:
    """Consecutive pairs of points as ``struct<a, b>``."""
    n = F.size(points)
    return F.zip_with(F.slice(points, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def bbox(points: Column) -> Column:
    lo, hi = (lambda f: F.array_min(F.transform(points, f))), (lambda f: F.array_max(F.transform(points, f)))
    x, y = (lambda p: p["x"]), (lambda p: p["y"])
    return F.struct(lo(x).alias("min_x"), lo(y).alias("min_y"), hi(x).alias("max_x"), hi(y).alias("max_y"))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule with half-open edges: an edge counts if it has one end above ``y`` and one not."""

    def crossed(e: Column) -> Column:
        a, b = e["a"], e["b"]
        at = (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]
        return F.when(((b["y"] > y) != (a["y"] > y)) & (x < at), 1).otherwise(0)

    return F.aggregate(F.transform(edges(ring), crossed), F.lit(0), lambda n, c: n + c) % 2 == 1


def in_polygon(x: Column, y: Column, rings: Column) -> Column:
    """Even-odd over all rings of a polygon, or of several polygons."""
    return F.aggregate(rings, F.lit(False), lambda inside, r: inside != in_ring(x, y, r))


def in_polygon_with_holes(x: Column, y: Column, rings: Column) -> Column:
    """Inside the first ring and in none of the others."""
    holes = F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0)))
    return in_ring(x, y, F.get(rings, F.lit(0))) & ~F.exists(holes, lambda r: in_ring(x, y, r))


def shoelace(ring: Column) -> Column:
    """Unsigned area of a ring."""
    cross = F.transform(edges(ring), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, c: s + c)) / 2


def polygon_area(rings: Column, subtract_holes: bool = True) -> Column:
    """Area of the outer ring, less its holes; without ``subtract_holes`` they are added."""
    areas = F.transform(rings, shoelace)
    rest = F.aggregate(F.slice(areas, F.lit(2), F.greatest(F.size(areas) - 1, F.lit(0))), F.lit(0.0), lambda s, a: s + a)
    return F.get(areas, F.lit(0)) + (-rest if subtract_holes else rest)


def vertex_mean(points: Column) -> Column:
    """Mean of the vertices; the closing point of a ring counts twice."""
    mean = lambda f: F.aggregate(F.transform(points, f), F.lit(0.0), lambda s, v: s + v) / F.size(points)
    return F.struct(mean(lambda p: p["x"]).alias("x"), mean(lambda p: p["y"]).alias("y"))


def segment_distance2(x: Column, y: Column, a: Column, b: Column) -> Column:
    """Squared distance to a segment, by the projection clamped to it."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.least(F.greatest(((x - a["x"]) * dx + (y - a["y"]) * dy) / size, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    ex, ey = x - (a["x"] + t * dx), y - (a["y"] + t * dy)
    return ex * ex + ey * ey


def path_distance(x: Column, y: Column, points: Column) -> Column:
    """Distance to the nearest point of a polyline; a single vertex is a point."""
    alone = F.get(points, F.lit(0))
    single = F.hypot(x - alone["x"], y - alone["y"])
    return F.when(F.size(points) > 1, F.sqrt(F.array_min(F.transform(edges(points), lambda e: segment_distance2(x, y, e["a"], e["b"]))))).otherwise(single)


def nearest_on_path(x: Column, y: Column, points: Column) -> Column:
    """``struct<d2, x, y>`` of the nearest point of a polyline."""

    def foot(e: Column) -> Column:
        a, b = e["a"], e["b"]
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        size = dx * dx + dy * dy
        t = F.when(size > 0, F.least(F.greatest(((x - a["x"]) * dx + (y - a["y"]) * dy) / size, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
        fx, fy = a["x"] + t * dx, a["y"] + t * dy
        return F.struct(((x - fx) * (x - fx) + (y - fy) * (y - fy)).alias("d2"), fx.alias("x"), fy.alias("y"))

    return F.array_min(F.transform(edges(points), foot))


def segments_cross(p: Column, q: Column, a: Column, b: Column) -> Column:
    """Whether two closed segments have a point in common."""
    side = lambda u, v, w: F.signum((v["x"] - u["x"]) * (w["y"] - u["y"]) - (v["y"] - u["y"]) * (w["x"] - u["x"]))
    within = lambda u, v, w: (w["x"].between(F.least(u["x"], v["x"]), F.greatest(u["x"], v["x"]))) & (w["y"].between(F.least(u["y"], v["y"]), F.greatest(u["y"], v["y"])))
    d1, d2, d3, d4 = side(p, q, a), side(p, q, b), side(a, b, p), side(a, b, q)
    proper = (d1 * d2 < 0) & (d3 * d4 < 0)
    touch = ((d1 == 0) & within(p, q, a)) | ((d2 == 0) & within(p, q, b)) | ((d3 == 0) & within(a, b, p)) | ((d4 == 0) & within(a, b, q))
    return proper | touch


def path_path_distance(one: Column, other: Column) -> Column:
    """Least distance of two polylines, 0 where they cross."""

    def pair(e: Column, f: Column) -> Column:
        p, q, a, b = e["a"], e["b"], f["a"], f["b"]
        ends = F.least(segment_distance2(p["x"], p["y"], a, b), segment_distance2(q["x"], q["y"], a, b), segment_distance2(a["x"], a["y"], p, q), segment_distance2(b["x"], b["y"], p, q))
        return F.when(segments_cross(p, q, a, b), F.lit(0.0)).otherwise(ends)

    return F.sqrt(F.array_min(F.transform(edges(one), lambda e: F.array_min(F.transform(edges(other), lambda f: pair(e, f))))))


def path_samples(points: Column, step: Column) -> Column:
    """Points along a polyline at most ``step`` apart, ends included."""

    def along(e: Column) -> Column:
        a, b = e["a"], e["b"]
        n = F.greatest(F.ceil(F.hypot(b["x"] - a["x"], b["y"] - a["y"]) / step).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(0), n), lambda i: F.struct((a["x"] + (b["x"] - a["x"]) * i / n).alias("x"), (a["y"] + (b["y"] - a["y"]) * i / n).alias("y")))

    return F.flatten(F.transform(edges(points), along))


# --- transverse Mercator (Krueger series to the sixth order), WGS 84 -------------------------------------

# The ellipsoid and the UTM frame.
_A, _F, _K0, _FE = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0
_N = _F / (2 - _F)
_RECT = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
# Series coefficients by powers of n, forward and inverse.
_FORWARD = (
    (1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800),
    (13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360),
    (61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440),
    (49561 / 161280, -179 / 168, 6601661 / 7257600),
    (34729 / 80640, -3418889 / 1995840),
    (212378941 / 319334400,),
)
_INVERSE = (
    (1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800),
    (1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720),
    (17 / 480, -37 / 840, -209 / 4480, 5569 / 90720),
    (4397 / 161280, -11 / 504, -830251 / 7257600),
    (4583 / 161280, -108847 / 3991680),
    (20648693 / 638668800,),
)


def _series(table) -> list[float]:
    return [sum(c * _N ** (i + 1 + j) for j, c in enumerate(row)) for i, row in enumerate(table)]


def to_utm(lon: Column, lat: Column, zone: int, south: bool = False) -> Column:
    """``struct<e, n>`` of a position in degrees."""
    lam, phi = F.radians(lon - F.lit(6.0 * zone - 183)), F.radians(lat)
    ecc = 2 * math.sqrt(_N) / (1 + _N)
    t = F.sinh(F.atanh(F.sin(phi)) - ecc * F.atanh(ecc * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_series(_FORWARD), 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.struct((_FE + _K0 * _RECT * x).alias("e"), (F.lit(1e7 if south else 0.0) + _K0 * _RECT * y).alias("n"))


def from_utm(e: Column, n: Column, zone: int, south: bool = False) -> Column:
    """``struct<lon, lat>`` in degrees of a UTM position."""
    y, x = (n - F.lit(1e7 if south else 0.0)) / (_K0 * _RECT), (e - _FE) / (_K0 * _RECT)
    xi, eta = y, x
    for j, b in enumerate(_series(_INVERSE), 1):
        xi = xi - b * F.sin(2 * j * y) * F.cosh(2 * j * x)
        eta = eta - b * F.cos(2 * j * y) * F.sinh(2 * j * x)
    lam = F.atan2(F.sinh(eta), F.cos(xi))
    ecc = 2 * math.sqrt(_N) / (1 + _N)

    def latitude(tau0: Column) -> Column:
        def step(tau: Column) -> Column:  # Newton's method on the conformal latitude
            sigma = F.sinh(ecc * F.atanh(ecc * tau / F.sqrt(1 + tau * tau)))
            t = tau * F.sqrt(1 + sigma * sigma) - sigma * F.sqrt(1 + tau * tau)
            return tau + (tau0 - t) / F.sqrt(1 + t * t) * (1 + (1 - ecc**2) * tau * tau) / ((1 - ecc**2) * F.sqrt(1 + tau * tau))

        return F.aggregate(F.sequence(F.lit(1), F.lit(4)), tau0, lambda tau, _: step(tau))

    chi = F.asin(F.sin(xi) / F.cosh(eta))
    return F.struct((F.degrees(lam) + 6.0 * zone - 183).alias("lon"), F.degrees(F.atan(bind(F.tan(chi), latitude))).alias("lat"))


def normal_path(points: Column, digits: int = 3, least: int = 2, most: int = 100_000) -> Column:
    """Points rounded, with repeats of the point before left out. Fewer than ``least`` or more than ``most`` points are refused."""
    rounded = F.transform(points, lambda p: F.struct(F.round(p["x"], digits).alias("x"), F.round(p["y"], digits).alias("y")))

    def distinct(path: Column) -> Column:
        kept = F.filter(path, lambda p, i: (i == 0) | (p != F.get(path, i - 1)))
        refused = F.raise_error(F.format_string("a path needs %d to %d points and has %d", F.lit(least), F.lit(most), F.size(kept)))
        return F.when(F.size(kept).between(least, most), kept).otherwise(refused)

    return bind(rounded, distinct)


def is_geographic(box: Column) -> Column:
    """Whether a bounding box can be degrees of longitude and latitude, not metres of a scene."""
    return (box["min_x"] >= -180) & (box["max_x"] <= 180) & (box["min_y"] >= -90) & (box["max_y"] <= 90)
