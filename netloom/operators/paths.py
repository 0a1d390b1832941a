"""Paths beside paths, round corners, and pieces that fit a bed. A path is rows (path, i, x, y)."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import geo
from .shared import dealt

# Longest miter (in offsets), pieces of a quarter turn, corners too flat or too sharp to round, shortest piece, steps of a search for a cut.
MITER, ARC, FLAT, SHARP = 3.0, 8, 0.02, 0.05
SCRAP, STEPS = 30.0, 12


def _along() -> Window:
    return Window.partitionBy("path").orderBy("i")


def _numbered(points: DataFrame) -> DataFrame:
    """(path, i, k, p) -> (path, i, x, y), numbered anew."""
    n = F.row_number().over(Window.partitionBy("path").orderBy("i", "k")) - 1
    return points.select("path", n.cast("long").alias("i"), "p.x", "p.y")


def offset(points: DataFrame, d: Column) -> DataFrame:
    """The path at a distance d to the left (a column; negative to the right). Where two sides meet far from the corner
    (MITER times d), or not at all, both ends are kept. Points must differ from the ones before them; a single point has no side, and no offset."""
    w = _along()
    p = points.withColumn("d", d.cast("double"))
    for c in "xy":
        p = p.withColumns({f"p{c}": F.lag(c).over(w), f"n{c}": F.lead(c).over(w)})
    unit = lambda ax, ay: F.struct((ax / geo.hypot(ax, ay)).alias("x"), (ay / geo.hypot(ax, ay)).alias("y"))
    p = p.withColumns({"u": F.when(F.col("px").isNotNull(), unit(F.col("x") - F.col("px"), F.col("y") - F.col("py"))), "v": F.when(F.col("nx").isNotNull(), unit(F.col("nx") - F.col("x"), F.col("ny") - F.col("y")))})
    beside = lambda u: F.struct((F.col("x") - F.col(f"{u}.y") * F.col("d")).alias("x"), (F.col("y") + F.col(f"{u}.x") * F.col("d")).alias("y"))
    p = p.withColumns({"a": beside("u"), "b": beside("v")})
    pair = lambda c: (F.col(f"{c}.x"), F.col(f"{c}.y"))
    p = p.withColumn("m", geo.line_intersection(pair("a"), pair("u"), pair("b"), pair("v")))
    near = F.col("m").isNotNull() & (geo.hypot(F.col("m.x") - F.col("x"), F.col("m.y") - F.col("y")) < MITER * F.abs("d"))
    own = F.struct("x", "y")
    out = F.when(F.abs("d") < 1e-9, F.array(own)).when(F.col("u").isNull(), F.array("b")).when(F.col("v").isNull(), F.array("a")).when(near, F.array("m")).otherwise(F.array("a", "b"))
    return _numbered(p.select("path", "i", F.posexplode(out).alias("k", "p")).filter("p is not null and p.x is not null"))


def fillet(points: DataFrame, radius: float) -> DataFrame:
    """The path with its corners as arcs of the radius, or of what half of the shorter side allows; corners that are nearly straight or fold back stay."""
    w = _along()
    p = points
    for c in "xy":
        p = p.withColumns({f"p{c}": F.lag(c).over(w), f"n{c}": F.lead(c).over(w)})
    a, b = geo.hypot(F.col("px") - F.col("x"), F.col("py") - F.col("y")), geo.hypot(F.col("nx") - F.col("x"), F.col("ny") - F.col("y"))
    p = p.withColumns({"a": a, "b": b})
    p = p.withColumns({f"{s}{c}": (F.col(f"{o}{c}") - F.col(c)) / F.col(n) for s, o, n in (("u", "p", "a"), ("v", "n", "b")) for c in "xy"})
    p = p.withColumn("turn", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("ux") * F.col("vx") + F.col("uy") * F.col("vy")))))
    p = p.withColumn("r", F.least(F.lit(float(radius)), F.least("a", "b") * 0.5 * F.tan(F.col("turn") / 2)))
    side, far = F.try_divide(F.col("r"), F.tan(F.col("turn") / 2)), F.try_divide(F.col("r"), F.sin(F.col("turn") / 2))
    half = geo.hypot(F.col("ux") + F.col("vx"), F.col("uy") + F.col("vy"))
    p = p.withColumns({"cx": F.col("x") + F.try_divide(F.col("ux") + F.col("vx"), half) * far, "cy": F.col("y") + F.try_divide(F.col("uy") + F.col("vy"), half) * far, "side": side})
    angle = lambda s: F.atan2(F.col("y") + F.col(f"{s}y") * F.col("side") - F.col("cy"), F.col("x") + F.col(f"{s}x") * F.col("side") - F.col("cx"))
    p = p.withColumns({"begin": angle("u"), "sweep": angle("v") - angle("u")})
    p = p.withColumn("sweep", F.when(F.col("sweep") > F.pi(), F.col("sweep") - 2 * F.pi()).when(F.col("sweep") < -F.pi(), F.col("sweep") + 2 * F.pi()).otherwise(F.col("sweep")))
    n = F.greatest(F.lit(2), F.ceil(F.abs("sweep") / (math.pi / 2) * ARC).cast("int"))
    arc = F.transform(F.sequence(F.lit(0), n), lambda k: F.struct((F.col("cx") + F.col("r") * F.cos(F.col("begin") + F.col("sweep") * k / n)).alias("x"), (F.col("cy") + F.col("r") * F.sin(F.col("begin") + F.col("sweep") * k / n)).alias("y")))
    stays = F.col("px").isNull() | F.col("nx").isNull() | (F.col("turn") > math.pi - FLAT) | (F.col("turn") < SHARP) | F.lit(radius <= 0)
    return _numbered(p.select("path", "i", F.posexplode(F.when(stays, F.array(F.struct("x", "y"))).otherwise(arc)).alias("k", "p")))


def split_for_bed(points: DataFrame, stations: DataFrame, pad: float, wide: float, high: float, rows: int = 0) -> DataFrame:
    """points(path, i, x, y), stations(path, s) -> (path, piece, i, x, y): pieces whose boxes, with ``pad`` around, fit the bed either way round.

    A path that does not fit is cut as far along as it fits: in the middle between two stations (their places s along the
    path), the last such that leaves at least SCRAP behind, else inside the segment that no longer fits. A tail shorter
    than SCRAP joins the piece before it if that still fits. A path is one task's work, from its first cut to its last; the box
    of a piece grows point by point, so the work is in proportion to the points. rows: about how many points there are, where they are many.
    """
    marks = stations.selectExpr("path", "cast(-1 as long) as i", "cast(s as double) as x", "cast(null as double) as y")
    both = points.selectExpr("path", "cast(i as long) as i", "cast(x as double) as x", "cast(y as double) as y").unionByName(marks)
    schema = StructType([both.schema["path"], *StructType.fromDDL("piece long, i long, x double, y double")])
    fields = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of path, i, x; columns, not rows, are read and made."""
        held, out = None, [[] for _ in fields]

        def made() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, fields, strict=True)], schema=fields)
            for c in out:
                c.clear()
            return done

        def one(path, i: list[int], x: list[float], y: list[float]) -> None:
            n = bisect_left(i, 0)
            for k, pts in enumerate(pieces(sorted(x[:n]), list(zip(x[n:], y[n:], strict=True)), pad, wide, high)):
                for c, values in zip(out, ([path] * len(pts), [k] * len(pts), range(len(pts)), *zip(*pts, strict=True)), strict=True):
                    c.extend(values)

        for b in batches:
            key, i = b.column("path").to_pylist(), b.column("i").to_numpy().tolist()
            x, y = (b.column(c).to_numpy(zero_copy_only=False).tolist() for c in "xy")
            if b.column("x").null_count or b.column("y").null_count > sum(v < 0 for v in i):  # a missing place stays missing, and is refused
                x, y = b.column("x").to_pylist(), b.column("y").to_pylist()
            begin = 0
            while begin < len(key):
                end = bisect_right(key, key[begin], begin) if key[begin] is not None else next((k for k in range(begin, len(key)) if key[k] is not None), len(key))
                part = i[begin:end], x[begin:end], y[begin:end]
                if held and held[0] == key[begin]:
                    held = key[begin], *(u + v for u, v in zip(held[1:], part, strict=True))
                else:
                    if held:
                        one(*held)
                    held = key[begin], *part
                begin = end
                if len(out[0]) > 20_000:
                    yield made()
        if held:
            one(*held)
        yield made()

    spread = both.repartition(max(1, math.ceil(rows / 250_000)), "path") if rows else dealt(both, ["path"], rows, always=True)
    return spread.sortWithinPartitions("path", "i", "x").mapInArrow(run, schema)


def pieces(stops: list[float], path: list[tuple[float, float]], pad: float, wide: float, high: float) -> list[list[tuple[float, float]]]:
    """The pieces of one path, cut as ``split_for_bed`` says; stops: where its stations are along it, in order."""
    if not path:
        return []
    if len(path) == 1:
        return [path]

    def holds(x0, y0, x1, y1):
        w, h = x1 - x0 + 2 * pad, y1 - y0 + 2 * pad
        return (w <= wide and h <= high) or (h <= wide and w <= high)

    cum = [0.0, *accumulate(map(math.dist, path, path[1:]))]

    def at(s):
        k = min(bisect_left(cum, s, 1), len(path) - 1)
        t = 0.0 if cum[k] == cum[k - 1] else min(1.0, max(0.0, (s - cum[k - 1]) / (cum[k] - cum[k - 1])))
        (ax, ay), (bx, by) = path[k - 1], path[k]
        return (ax + (bx - ax) * t, ay + (by - ay) * t)

    def piece(a, b):
        return [at(a), *path[bisect_right(cum, a + 1e-9) : bisect_left(cum, b - 1e-9)], at(b)]

    def fits(pts):
        x, y = zip(*pts, strict=True)
        return holds(min(x), min(y), max(x), max(y))

    gaps = [(a + b) / 2 for a, b in zip(stops, stops[1:], strict=False)]
    cuts, k, n = [0.0], 1, len(path)
    x0 = None  # the box of the piece's first point and the points before ``seen`` that lie inside it; it grows with k
    while k < n:
        begin, to = cuts[-1], cum[k]
        if to <= begin:
            k += 1
            continue
        if x0 is None:
            (x0, y0), seen = at(begin), bisect_right(cum, begin + 1e-9)
            x1, y1 = x0, y0
        while seen < n and cum[seen] < to - 1e-9:
            x, y = path[seen]
            seen += 1
            if x < x0:
                x0 = x
            if x > x1:
                x1 = x
            if y < y0:
                y0 = y
            if y > y1:
                y1 = y
        if cum[k - 1] < to:  # where the point is the first at its place, ``at`` is this
            (ax, ay), (x, y) = path[k - 1], path[k]
            x, y = ax + (x - ax), ay + (y - ay)
        else:
            x, y = at(to)
        w, h = (x if x > x1 else x1) - (x if x < x0 else x0) + 2 * pad, (y if y > y1 else y1) - (y if y < y0 else y0) + 2 * pad
        if (w <= wide and h <= high) or (h <= wide and w <= high):
            k += 1
            continue
        good = max(begin, cum[k - 1])
        cut = max((m for m in gaps if begin + SCRAP < m <= good), default=None)
        if cut is None:
            low, top = good, to
            for _ in range(STEPS):
                mid = (low + top) / 2
                low, top = (mid, top) if fits(piece(begin, mid)) else (low, mid)
            cut = low
        if cut <= begin + 1e-6:
            cut = begin + (to - begin) * 0.5
        cuts.append(cut)
        x0 = None
    if cum[-1] > cuts[-1] + 1e-6 or len(cuts) == 1:
        cuts.append(cum[-1])
    if len(cuts) > 2 and cuts[-1] - cuts[-2] < SCRAP and fits(piece(cuts[-3], cuts[-1])):
        del cuts[-2]
    return [piece(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
