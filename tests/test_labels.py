"""Labels placed in rounds against the loop that places them one by one."""

import math
import random

from netloom.operators import labels as L

LABELS = "label long, x double, y double, half_w double, half_h double, w double, h double, priority long"


def turned(x, y, w, h, angle):
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    return [(x + a * c - b * s, y + a * s + b * c) for a, b in ((0, 0), (w, 0), (w, h), (0, h))]


def touch(a, b):
    for p in (a, b):
        for (x0, y0), (x1, y1) in zip(p, p[1:] + p[:1], strict=True):
            on = lambda q: [x * (y1 - y0) - y * (x1 - x0) for x, y in q]  # noqa: B023, E731
            if max(on(a)) < min(on(b)) or max(on(b)) < min(on(a)):
                return False
    return True


def off(p, q, poly):
    """From a segment to a polygon, 0 if they meet."""
    def seg(c, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = max(0, min(1, ((c[0] - a[0]) * dx + (c[1] - a[1]) * dy) / (dx * dx + dy * dy)))
        return math.dist(c, (a[0] + t * dx, a[1] + t * dy))

    if touch(poly, [p, q]):
        return 0
    return min(min(seg(a, p, q), seg(p, a, b), seg(q, a, b)) for a, b in zip(poly, poly[1:] + poly[:1], strict=True))


def one_by_one(rows, markers, lines, bounds, gap):
    done, out = [], {}
    for label, x, y, hw, hh, w, h, _ in sorted(rows, key=lambda r: (-r[7], -r[2], r[0])):
        w, h, hw, hh = w + 2 * L.PAD, h + 2 * L.PAD, hw + gap, hh + gap
        best = None
        for (a, b, c), (d, e, f), angle, cost in L.PLACES + L.TURNED:
            px, py = x + a * hw + b * w + c * h, y + d * hh + e * w + f * h
            poly = turned(px, py, w, h, angle)
            if any(px < bounds[0] or py < bounds[1] or px > bounds[2] or py > bounds[3] for px, py in poly):
                cost += L.OUTSIDE
            if any(touch(poly, m) for m in markers) or any(touch(poly, p) for p in done):
                continue
            gaps = [off(p, q, poly) - r for p, q, r in lines]
            if any(g < 0 for g in gaps):
                continue
            cost += L.NEAR * sum(g < L.NEAR_BY for g in gaps)
            if best is None or cost < best[0]:
                best = (cost, px, py, angle, poly)
            if cost < L.AT_ONCE:
                break
        if best and best[0] < L.NONE:
            done.append(best[4])
            out[label] = (round(best[1], 6), round(best[2], 6), best[3])
    return out, done


def test_labels_in_rounds_as_one_by_one(spark):
    """A crowded town with lines at all angles: as the loop, disjoint, some left without a place."""
    rng = random.Random(11)
    at = [(rng.uniform(0, 70), rng.uniform(0, 60)) for _ in range(70)]
    rows = [(i, x, y, 0.5, 0.5, rng.uniform(3, 12), 1.8, rng.randrange(4)) for i, (x, y) in enumerate(at)]
    markers = [turned(x - 0.5, y - 0.5, 1, 1, 0) for x, y in at]
    lines = [((a[0] + 1.3, a[1] + 1.1), (b[0] + 1.3, b[1] - 1.2), 0.3) for a, b in zip(at[:14], at[1:15], strict=True)]
    bounds, gap = (-2.0, -2.0, 75.0, 64.0), 0.4
    want, boxes = one_by_one(rows, markers, lines, bounds, gap)
    df = spark.createDataFrame(rows, LABELS)
    point = "array<struct<x:double,y:double>>"
    m = spark.createDataFrame([([(float(a), float(b)) for a, b in p],) for p in markers], f"poly {point}")
    s = spark.createDataFrame([(*map(float, a), *map(float, b), r) for a, b, r in lines], "ax double, ay double, bx double, by double, r double")
    free = L.free_places(L.candidates(df, gap), m, s, bounds, gap, 8.0)
    got = {r["label"]: (round(r["x"], 6), round(r["y"], 6), int(r["angle"])) for r in L.place(df, free, 8.0).collect()}
    assert got == want and 0 < len(want) < len(rows) and any(a for *_, a in want.values())
    assert not any(touch(a, b) for i, a in enumerate(boxes) for b in boxes[:i])
    assert L.place(df.limit(0), free.limit(0), 8.0).count() == 0
