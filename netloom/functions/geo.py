"""Plane and map geometry as column expressions. A point is two columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRES_PER_DEGREE = (111320.0, 110574.0)


def hypot(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def metres_between(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    kx = METRES_PER_DEGREE[0] * F.cos(F.radians((lat1 + lat2) / 2))
    return hypot((lon1 - lon2) * kx, (lat1 - lat2) * METRES_PER_DEGREE[1])


def cross(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """From a point to a segment; a segment without length is its point."""
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    t = F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.when(n != 0, n))))
    return hypot(px - (ax + t * dx), py - (ay + t * dy))


def segments_cross(a: tuple[Column, Column], b: tuple[Column, Column], c: tuple[Column, Column], d: tuple[Column, Column]) -> Column:
    """Strictly: each segment's ends lie on different sides of the other."""

    def side(p, q, r):
        return F.signum(cross(q[0] - p[0], q[1] - p[1], r[0] - p[0], r[1] - p[1]))

    return (side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0)


def boxes_touch(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Boxes (minx, miny, maxx, maxy) overlap; open intervals."""
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def line_intersection(p: tuple[Column, Column], d: tuple[Column, Column], q: tuple[Column, Column], e: tuple[Column, Column]) -> Column:
    """Of two lines in point and direction form; null if parallel."""
    den = cross(d[0], d[1], e[0], e[1])
    t = cross(q[0] - p[0], q[1] - p[1], e[0], e[1]) / F.when(F.abs(den) >= 1e-9, den)
    return F.when(F.abs(den) >= 1e-9, F.struct((p[0] + d[0] * t).alias("x"), (p[1] + d[1] * t).alias("y")))


def octilinear(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Path from a to b with one bend, axis-parallel first and diagonal then: an array of points."""
    dx, dy = bx - ax, by - ay
    m = F.least(F.abs(dx), F.abs(dy))
    mx, my = bx - F.signum(dx) * m, by - F.signum(dy) * m
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    straight = (F.abs(dx) < 1e-9) | (F.abs(dy) < 1e-9) | (F.abs(F.abs(dx) - F.abs(dy)) < 1e-9)
    return F.when(straight, F.array(point(ax, ay), point(bx, by))).otherwise(F.array(point(ax, ay), point(mx, my), point(bx, by)))


def srgb_to_linear(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, 2.4))


def trapezoid_time(d: Column, v: Column, v0: Column, v1: Column, a: Column) -> Column:
    """Time of a move of length d that enters at v0, leaves at v1, and speeds up to v at most."""
    up, down = (v * v - v0 * v0) / (a * 2), (v * v - v1 * v1) / (a * 2)
    peak = F.sqrt(F.greatest(F.lit(0.0), (a * d * 2 + v0 * v0 + v1 * v1) / 2))
    full = (v - v0) / a + (v - v1) / a + (d - up - down) / v
    return F.when(d <= 0, F.lit(0.0)).when(up + down <= d, full).otherwise((peak - v0) / a + (peak - v1) / a)


def turned_box(x: Column, y: Column, half_w: Column, half_h: Column, cos: Column, sin: Column) -> Column:
    """Corners of a box around a point, turned by an angle: an array of structs (x, y)."""
    corner = lambda a, b: F.struct((x + a * cos - b * sin).alias("x"), (y + a * sin + b * cos).alias("y"))
    return F.array(corner(-half_w, -half_h), corner(half_w, -half_h), corner(half_w, half_h), corner(-half_w, half_h))


def convex_touch(a: Column, b: Column, eps: float = 1e-9) -> Column:
    """Whether two convex polygons (arrays of structs) overlap or touch: no normal of an edge keeps them apart.

    The polygons are held by lambda variables: else the expressions that make them are worked out at each use, some hundred times a row.
    """

    def touch(a: Column, b: Column) -> Column:
        def apart(n: Column) -> Column:
            # the least and greatest place of the corners along the normal
            on = lambda q: F.transform(q, lambda c: c["x"] * n["x"] + c["y"] * n["y"])
            ends = F.transform(F.array(a, b), lambda q: F.struct(F.array_min(on(q)).alias("lo"), F.array_max(on(q)).alias("hi")))
            slack = eps * F.sqrt(n["x"] * n["x"] + n["y"] * n["y"])
            return F.exists(F.transform(F.array(ends), lambda e: (e[0]["hi"] < e[1]["lo"] - slack) | (e[1]["hi"] < e[0]["lo"] - slack)), lambda x: x)

        normal = lambda u, v: F.struct((v["y"] - u["y"]).alias("x"), (u["x"] - v["x"]).alias("y"))
        normals = lambda p: F.transform(p, lambda u, i: normal(u, F.get(p, (i + 1) % F.size(p))))
        return ~F.exists(F.concat(normals(a), normals(b)), apart)

    return F.element_at(F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda p: touch(p["a"], p["b"])), 1)
