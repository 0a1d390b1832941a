"""Shapes kept as arrays of points in one row: hulls, simplification, clustering, snapping.

A shape is small and independent, so each is one group of an ordered fold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fold import ordered_fold


def convex_hull(points: DataFrame, key: str) -> DataFrame:
    """points(key, x, y) -> (key, ord, x, y): the corners, counter-clockwise from the least; points on edges are left out."""

    def fold(g):
        pts = sorted({(r["x"], r["y"]) for r in g})

        def half(ps):
            out = []
            for p in ps:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(p)
            return out[:-1]

        hull = pts if len(pts) < 3 else half(pts) + half(pts[::-1])
        return [(g[0][key], i, x, y) for i, (x, y) in enumerate(hull)]

    return ordered_fold(points, [key], ["x", "y"], fold, f"{key} long, ord long, x double, y double")


def simplify(points: DataFrame, key: str, eps: float) -> DataFrame:
    """points(key, ord, x, y) -> the kept ones: a stretch is a straight line if none of its points is further than eps from it."""

    def far(p, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        n = dx * dx + dy * dy
        t = 0.0 if n == 0 else max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / n))
        return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)

    def fold(g):
        p = [(r["x"], r["y"]) for r in g]
        keep, todo = {0, len(p) - 1}, [(0, len(p) - 1)]
        while todo:
            a, b = todo.pop()
            worst = max(range(a + 1, b), key=lambda i: (far(p[i], p[a], p[b]), -i), default=None)
            if worst is not None and far(p[worst], p[a], p[b]) > eps:
                keep.add(worst)
                todo += [(a, worst), (worst, b)]
        return [(g[i][key], g[i]["ord"], *p[i]) for i in sorted(keep)]

    return ordered_fold(points, [key], ["ord"], fold, f"{key} long, ord long, x double, y double")


def drop_collinear(points: DataFrame, key: str, eps: float) -> DataFrame:
    """Without points on the line from the last kept point to the next one."""

    def fold(g):
        p, out = [(r["x"], r["y"]) for r in g], [0]
        for i in range(1, len(p) - 1):
            a, b, c = p[out[-1]], p[i], p[i + 1]
            if abs((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])) > eps:
                out.append(i)
        out += [len(p) - 1] if len(p) > 1 else []
        return [(g[i][key], g[i]["ord"], *p[i]) for i in out]

    return ordered_fold(points, [key], ["ord"], fold, f"{key} long, ord long, x double, y double")


def marker_clusters(points: DataFrame, key: str, reach: float) -> DataFrame:
    """points(key, ord, x, y) -> (key, ord, cluster): each joins the first cluster with a member within reach; a point between two clusters does not merge them."""

    def fold(g):
        clusters: list[list[tuple]] = []
        for r in g:
            p = (r["x"], r["y"])
            at = next((i for i, c in enumerate(clusters) if any(math.hypot(p[0] - q[0], p[1] - q[1]) <= reach for q in c)), None)
            if at is None:
                at = len(clusters)
                clusters.append([])
            clusters[at].append(p)
            yield r[key], r["ord"], at

    return ordered_fold(points, [key], ["ord"], fold, f"{key} long, ord long, cluster long")


def snap(points: DataFrame, key: str, cell: float, rings: int = 6) -> DataFrame:
    """points(key, rank, id, x, y) -> (key, id, gx, gy): by rank, each to the nearest free grid cell within so many rings; null if none is free."""

    def fold(g):
        taken = set()
        for r in g:
            cx, cy = math.floor(r["x"] / cell + 0.5), math.floor(r["y"] / cell + 0.5)
            spot = None
            for n in range(rings + 1):
                ring = [(cx + i, cy + j) for i in range(-n, n + 1) for j in range(-n, n + 1) if max(abs(i), abs(j)) == n and (cx + i, cy + j) not in taken]
                if ring:
                    spot = min(ring, key=lambda s: (math.hypot(s[0] * cell - r["x"], s[1] * cell - r["y"]), s))  # noqa: B023
                    break
            if spot:
                taken.add(spot)
            yield r[key], r["id"], spot and spot[0], spot and spot[1]

    return ordered_fold(points, [key], ["rank", "id"], fold, f"{key} long, id long, gx long, gy long")


def merge_interchanges(pairs: DataFrame, key: str) -> DataFrame:
    """pairs(key, a, b, d, name_a, name_b) -> (key, station, target, name): by distance, b is merged into a, both followed to where they went before; names are joined unless one holds the other."""

    def fold(g):
        to, name = {}, {}

        def root(s):
            while s in to:
                s = to[s]
            return s

        for r in g:
            name.setdefault(r["a"], r["name_a"]), name.setdefault(r["b"], r["name_b"])
            a, b = root(r["a"]), root(r["b"])
            if a != b:
                to[b] = a
                x, y = name[a], name[b]
                name[a] = x if y in x else y if x in y else f"{x} / {y}"
        return [(g[0][key], s, root(s), name[root(s)]) for s in sorted(name)]

    return ordered_fold(pairs, [key], ["d", "a", "b"], fold, f"{key} long, station long, target long, name string")


def mulberry(seed: Column, n: Column) -> Column:
    """The n-th number in [0, 1), from 1, of the 32-bit generator that starts at seed; 32-bit products are split, so nothing overflows."""
    m = 0xFFFFFFFF

    def imul(a: Column, b: Column) -> Column:
        low, high = b.bitwiseAND(0xFFFF), F.shiftrightunsigned(b, 16)
        return (a * low + F.shiftleft((a * high).bitwiseAND(0xFFFF), 16)).bitwiseAND(m)

    a = (seed.cast("long") + n.cast("long") * 0x6D2B79F5).bitwiseAND(m)
    t = imul(a.bitwiseXOR(F.shiftrightunsigned(a, 15)), a.bitwiseOR(1))
    t = t.bitwiseXOR((t + imul(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(61))).bitwiseAND(m))
    return t.bitwiseXOR(F.shiftrightunsigned(t, 14)).bitwiseAND(m) / F.lit(4294967296.0)


def clip_to_box(ax: Column, ay: Column, bx: Column, by: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The part (t0, t1) of a segment inside a box; null where there is none."""
    dx, dy = bx - ax, by - ay
    lo, hi, out = F.lit(0.0), F.lit(1.0), F.lit(False)
    for p, q in ((-dx, ax - x0), (dx, x1 - ax), (-dy, ay - y0), (dy, y1 - ay)):
        t = q / F.when(p != 0, p)
        out = out | ((p == 0) & (q < 0))
        lo, hi = F.greatest(lo, F.when(p < 0, t)), F.least(hi, F.when(p > 0, t))
    return F.when(~out & (lo <= hi), F.struct(lo.alias("t0"), hi.alias("t1")))


def affine(m: Column, x: Column, y: Column) -> Column:
    """A point under a matrix struct (a, b, c, d, e, f)."""
    return F.struct((m["a"] * x + m["c"] * y + m["e"]).alias("x"), (m["b"] * x + m["d"] * y + m["f"]).alias("y"))


def quadratic(p0: Column, p1: Column, p2: Column, n: int) -> Column:
    """n + 1 points along a quadratic curve of structs (x, y)."""

    def at(i: Column) -> Column:
        t = i / F.lit(float(n))
        one = lambda c: (1 - t) * (1 - t) * p0[c] + 2 * (1 - t) * t * p1[c] + t * t * p2[c]
        return F.struct(one("x").alias("x"), one("y").alias("y"))

    return F.transform(F.sequence(F.lit(0), F.lit(n)), at)


def in_triangle(px: Column, py: Column, a: tuple, b: tuple, c: tuple) -> Column:
    def side(p, q):
        return (q[0] - p[0]) * (py - p[1]) - (q[1] - p[1]) * (px - p[0])

    s = [side(a, b), side(b, c), side(c, a)]
    return ((s[0] >= 0) & (s[1] >= 0) & (s[2] >= 0)) | ((s[0] <= 0) & (s[1] <= 0) & (s[2] <= 0))
