"""Placement of labels by priority, all at once.

The rule is sequential: labels in order of priority take their best place that
meets no label placed before. What a label sees, though, are the few whose
possible places touch its own. So a label is settled as soon as all of those
with a higher priority are, and a round settles all labels that can be: the same
places, in as many rounds as the longest chain of labels in each other's way.
Possible places meet on a grid, once; rounds only strike out what is taken.

What is dealt to cells, and the small columns of a written round, take far more room than Spark's estimates tell, so all
joins here are asked to sort both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from .shared import saved

# Room around a text; the eight places around a marker in order of preference, then three turned ones, as
# (x and y of the corner in half widths of the marker, in widths and in heights of the box, angle, cost).
PAD = 0.6
HALF = 0.7071067811865476
PLACES = [
    ((1, 0, 0), (0, 0, -0.5), 0, 0.0), ((-1, -1, 0), (0, 0, -0.5), 0, 0.1), ((0, -0.5, 0), (1, 0, 0), 0, 0.3), ((0, -0.5, 0), (-1, 0, -1), 0, 0.3),
    ((0.8, 0, 0), (0.6, 0, 0), 0, 0.5), ((0.8, 0, 0), (-0.6, 0, -1), 0, 0.5), ((-0.8, -1, 0), (0.6, 0, 0), 0, 0.6), ((-0.8, -1, 0), (-0.6, 0, -1), 0, 0.6),
]
TURNED = [
    ((HALF, 0, HALF / 2), (HALF, 0, -HALF / 2), 45, 0.8), ((-HALF, -HALF, 0), (HALF, HALF, -HALF / 2), -45, 0.9), ((HALF, 0, -HALF / 2), (-HALF, 0, -HALF / 2), -45, 1.0),
]
# What a place costs that is out of bounds, or near a line (and how near that is); from which cost on it is none; below which it is taken at once.
OUTSIDE, NEAR, NEAR_BY, NONE, AT_ONCE = 50.0, 0.2, 1.5, 50.0, 0.05


def candidates(labels: DataFrame, gap: float, turned: bool = True) -> DataFrame:
    """labels(label, x, y, half_w, half_h, w, h, priority) -> (label, cand, ord, x, y, angle, cost, poly, x0, y0, x1, y1): possible places of each text's box, in order of preference."""
    w, h = F.col("w") + 2 * PAD, F.col("h") + 2 * PAD
    hw, hh = F.col("half_w") + gap, F.col("half_h") + gap
    at = [F.struct(F.lit(i).alias("ord"), (F.col("x") + a * hw + b * w + c * h).alias("x"), (F.col("y") + d * hh + e * w + f * h).alias("y"), F.lit(float(angle)).alias("angle"), F.lit(cost).alias("cost")) for i, ((a, b, c), (d, e, f), angle, cost) in enumerate(PLACES + (TURNED if turned else []))]
    each = labels.select("label", w.alias("w"), h.alias("h"), F.explode(F.array(*at)).alias("c")).select("label", "w", "h", "c.*")
    cos, sin = F.cos(F.radians("angle")), F.sin(F.radians("angle"))
    corner = lambda p, q: F.struct((F.col("x") + p * cos - q * sin).alias("x"), (F.col("y") + p * sin + q * cos).alias("y"))
    zero = F.lit(0.0)
    each = each.withColumn("poly", F.array(corner(zero, zero), corner(F.col("w"), zero), corner(F.col("w"), F.col("h")), corner(zero, F.col("h"))))
    xs, ys = F.transform("poly", lambda p: p["x"]), F.transform("poly", lambda p: p["y"])
    box = {"x0": F.array_min(xs), "y0": F.array_min(ys), "x1": F.array_max(xs), "y1": F.array_max(ys)}
    return each.withColumns(box | {"cand": F.struct("label", "ord")}).drop("w", "h")


def _cells(size: float, grow: float | Column = 0.0) -> list[Column]:
    span = lambda a: F.explode(F.sequence(F.floor((F.col(f"{a}0") - grow) / size), F.floor((F.col(f"{a}1") + grow) / size)))
    return [span("x"), span("y")]


def _dealt(rows: DataFrame, size: float, grow: float | Column = 0.0) -> DataFrame:
    cx, cy = _cells(size, grow)
    return rows.withColumn("cx", cx).withColumn("cy", cy)


def _first_cell(size: float, other: str, grow: float = 0.0) -> Column:
    """Two boxes that lie in several cells together are met in that of their overlap's lower corner."""
    return (F.floor(F.greatest(F.col("x0") - grow, F.col(f"{other}x0")) / size) == F.col("cx")) & (F.floor(F.greatest(F.col("y0") - grow, F.col(f"{other}y0")) / size) == F.col("cy"))


def _touch(other: str, grow: float = 0.0) -> Column:
    """Boxes that overlap or touch."""
    return (F.col("x0") - grow <= F.col(f"{other}x1")) & (F.col(f"{other}x0") <= F.col("x1") + grow) & (F.col("y0") - grow <= F.col(f"{other}y1")) & (F.col(f"{other}y0") <= F.col("y1") + grow)


def _distance(poly: Column, a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """From a convex polygon to a segment; 0 if they meet."""
    n = F.size(poly)
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(poly, i).alias("p"), F.get(poly, (i + 1) % n).alias("q")))

    def one(e: Column) -> Column:
        p, q = (e["p"]["x"], e["p"]["y"]), (e["q"]["x"], e["q"]["y"])
        return F.least(geo.segment_distance(*p, *a, *b), geo.segment_distance(*a, *p, *q), geo.segment_distance(*b, *p, *q))

    met = geo.convex_touch(poly, F.array(*[F.struct(c[0].alias("x"), c[1].alias("y")) for c in (a, b)]))
    return F.when(met, 0.0).otherwise(F.array_min(F.transform(edges, one)))


def free_places(cands: DataFrame, markers: DataFrame, lines: DataFrame, bounds: tuple[float, float, float, float], gap: float, size: float) -> DataFrame:
    """Candidates with their cost among what does not move, without those that meet a marker or a line.

    markers(poly): convex polygons; lines(ax, ay, bx, by, r): segments with half their width. A place out of the bounds
    (x0, y0, x1, y1) costs OUTSIDE more, each line within NEAR_BY of it NEAR more.
    """
    out = (F.col("x0") < bounds[0]) | (F.col("y0") < bounds[1]) | (F.col("x1") > bounds[2]) | (F.col("y1") > bounds[3])
    c = saved(cands.withColumn("cost", F.col("cost") + F.when(out, OUTSIDE).otherwise(0.0)), "places")
    xs, ys = F.transform("m_poly", lambda p: p["x"]), F.transform("m_poly", lambda p: p["y"])
    m = markers.select(F.col("poly").alias("m_poly")).withColumns({"x0": F.array_min(xs), "y0": F.array_min(ys), "x1": F.array_max(xs), "y1": F.array_max(ys)})
    m = _dealt(m, size).withColumnsRenamed({f"{a}{i}": f"m_{a}{i}" for a in "xy" for i in "01"})
    hit = _dealt(c, size, gap).join(m.hint("merge"), ["cx", "cy"]).filter(_first_cell(size, "m_", gap) & _touch("m_", gap)).filter(geo.convex_touch(F.col("poly"), F.col("m_poly"))).select("cand").distinct()
    grow = F.col("r") + NEAR_BY
    s = lines.withColumns({"x0": F.least("ax", "bx") - grow, "y0": F.least("ay", "by") - grow, "x1": F.greatest("ax", "bx") + grow, "y1": F.greatest("ay", "by") + grow})
    s = _dealt(s, size).withColumnsRenamed({f"{a}{i}": f"s_{a}{i}" for a in "xy" for i in "01"})
    near = _dealt(c, size).join(s.hint("merge"), ["cx", "cy"]).filter(_first_cell(size, "s_") & _touch("s_"))
    near = near.withColumn("d", _distance(F.col("poly"), (F.col("ax"), F.col("ay")), (F.col("bx"), F.col("by")))).groupBy("cand").agg(F.count_if(F.col("d") < F.col("r")).alias("on"), F.count_if((F.col("d") >= F.col("r")) & (F.col("d") < F.col("r") + NEAR_BY)).alias("by"))
    left = c.join(hit.hint("merge"), "cand", "left_anti").join(near.hint("merge"), "cand", "left").filter(F.coalesce("on", F.lit(0)) == 0)
    return left.withColumn("cost", F.col("cost") + NEAR * F.coalesce("by", F.lit(0))).drop("on", "by")


def place(labels: DataFrame, free: DataFrame, size: float) -> DataFrame:
    """labels(label, priority, y), their free places -> (label, x, y, angle, cost) of those that find one.

    Labels come by priority, the higher first, then by height (y), the higher first, then by number. Each takes the first of
    its places that costs less than AT_ONCE, else the cheapest (the first of equal ones), among those that meet no label
    placed before; a place that costs NONE or more is none.
    """
    turn = F.struct((-F.col("priority")).alias("p"), (-F.col("y")).alias("y"), F.col("label").alias("label"))
    c = free.filter(F.col("cost") < NONE).join(labels.select("label", turn.alias("turn")).hint("merge"), "label")
    c = saved(c.withColumn("rank", F.struct(F.when(F.col("cost") < AT_ONCE, -1.0).otherwise(F.col("cost")).alias("cost"), F.col("ord").alias("ord"))), "free")
    other = c.select(F.col("cand").alias("o_cand"), F.col("turn").alias("o_turn"), F.col("poly").alias("o_poly"), "x0", "y0", "x1", "y1")
    other = _dealt(other, size).withColumnsRenamed({f"{a}{i}": f"o_{a}{i}" for a in "xy" for i in "01"})
    meets = _dealt(c, size).join(other.hint("merge"), ["cx", "cy"]).filter(F.col("turn") > F.col("o_turn")).filter(_first_cell(size, "o_") & _touch("o_")).filter(geo.convex_touch(F.col("poly"), F.col("o_poly"), 0.0))
    meets = saved(meets.select("cand", "label", "o_cand", F.col("o_cand.label").alias("o_label")), "meets")
    waits = meets.select("label", "o_label").distinct()
    left, found = c.select("cand", "label", "rank"), None
    while True:
        held = waits.select("label").distinct()
        now = left.join(held.hint("merge"), "label", "left_anti")
        best = saved(now.groupBy("label").agg(F.min_by("cand", "rank").alias("cand")), "settled")
        if best.isEmpty():
            break
        found = best if found is None else found.unionByName(best)
        struck = meets.join(best.select(F.col("cand").alias("o_cand")).hint("merge"), "o_cand", "left_semi").select("cand").distinct()
        left = saved(left.join(best.select("label").hint("merge"), "label", "left_anti").join(struck.hint("merge"), "cand", "left_anti"), "left")
        # who has no place left, or is settled, holds up nobody
        waits = saved(waits.join(left.select(F.col("label").alias("o_label")).distinct().hint("merge"), "o_label", "left_semi").select("label", "o_label"), "waits")
    if found is None:
        return c.limit(0).select("label", "x", "y", "angle", "cost")
    return c.join(found.select("cand").hint("merge"), "cand").select("label", "x", "y", "angle", "cost")
