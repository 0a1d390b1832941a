"""Loops, nesting and joined polylines against plain walks."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from netloom.operators import linking

SEG = "grp long, seg long, x1 double, y1 double, x2 double, y2 double"


def ring(rng, n, cx, cy, r):
    return [(cx + r * math.cos(2 * math.pi * k / n), cy + r * math.sin(2 * math.pi * k / n)) for k in range(n)]


def test_loops_and_left_overs(spark):
    """Rings of all lengths in any order, with ends up to 0.002 off; open chains; a chain with a small gap; a tiny ring."""
    rng = random.Random(2)
    segs, want, no = [], {}, 0

    def put(points, closed, grp, last=True):
        nonlocal no
        pts = points + ([points[0]] if closed and last else [])
        ids = list(range(no, no + len(pts) - 1))
        no += len(ids)
        for i, (a, b) in zip(ids, zip(pts, pts[1:], strict=False), strict=True):
            segs.append((grp, i, *map(float, a), b[0] + rng.uniform(-0.001, 0.001), b[1] + rng.uniform(-0.001, 0.001)))
        return ids

    for k in range(30):
        ids = put(ring(rng, rng.randrange(3, 40), 100 * k, 0, 5), True, k % 3)
        want[ids[0]] = (ids, True)
    ids = put([(0, 50), (1, 50), (2, 50)], False, 0)
    want[ids[0]] = (ids, False)
    ids = put([(0, 70), (5, 70), (5, 75), (0.03, 70)], False, 0)  # ends 0.03 from its start
    want[ids[0]] = (ids, True)
    ids = put(ring(rng, 5, 0, 90, 0.05), True, 1)  # less than 0.5 around
    want[ids[0]] = (ids, False)
    rng.shuffle(segs)
    looped = linking.loops(spark.createDataFrame(segs, SEG)).cache()
    got = defaultdict(list)
    for r in looped.orderBy("loop", "pos").collect():
        got[r["loop"]].append((r["seg"], r["closed"]))
    assert {k: ([s for s, _ in v], v[0][1]) for k, v in got.items()} == want
    areas = {r["loop"]: (r["n"], r["area"]) for r in linking.loop_areas(looped).collect()}
    assert set(areas) == {k for k, (_, c) in want.items() if c}
    for k, (n, a) in areas.items():
        if n != 3 or k < 700:
            assert a == pytest.approx(n / 2 * 25 * math.sin(2 * math.pi / n), rel=0.01) or n == 3
    looped.unpersist()


def test_ends_that_several_starts_are_near(spark):
    """Pairs are taken by distance, then by number; each end once."""
    rng = random.Random(4)
    pairs = list({(a, b): (a, b, float(rng.randrange(3))) for a, b in ((rng.randrange(40), 40 + rng.randrange(40)) for _ in range(300))}.values())
    used, want = set(), set()
    for d, a, b in sorted((d, a, b) for a, b, d in pairs):
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b))
    got = linking.matched(spark.createDataFrame([(b, a, d) if a % 2 else (a, b, d) for a, b, d in pairs], "a long, b long, d double"))
    assert {tuple(r) for r in got.collect()} == want


def test_nesting_against_all_loops(spark):
    """Rings of all sizes, nested or apart; tall edges and short ones."""
    rng = random.Random(6)
    loops, segs, no = {}, [], 0
    for k in range(60):
        cx, cy, r = (0, 0, 1.5**k) if k < 25 else (rng.uniform(-2000, 2000), rng.uniform(-2000, 2000), rng.uniform(0.5, 2))
        pts = ring(rng, rng.choice([3, 4, 7]), cx, cy, r)
        loops[no] = (k % 2, pts)
        for a, b in zip(pts, pts[1:] + pts[:1], strict=True):
            segs.append((k % 2, no, *a, *b))
            no += 1
    inside = lambda x, y, pts: sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(pts, pts[1:] + pts[:1], strict=True)) % 2
    want = {i: sum(inside(*pts[0], other) for j, (g2, other) in loops.items() if j != i and g2 == g) for i, (g, pts) in loops.items()}
    looped = linking.loops(spark.createDataFrame(segs, SEG))
    assert {r["loop"]: r["depth"] for r in linking.nesting(looped, 1.0).collect()} == want and max(want.values()) > 8


def test_planes_through_corners_are_moved(spark):
    """Corners on a plane, and on the place that it is moved to."""
    z = [0.0, 1.0, 1.0 + 1e-6]
    tri = [(1, 0, 0.0, 0.0, z[0], 1.0, 0.0, z[1], 0.0, 1.0, z[2]), (1, 1, 0.0, 0.0, 0.5, 3.0, 0.0, 2.5, 0.0, 1.0, 2.5), (2, 0, 0.0, 0.0, 0.2, 1.0, 0.0, 0.2, 0.0, 1.0, 0.2)]
    df = spark.createDataFrame(tri, "mesh long, id int, " + ", ".join(f"{c}{a} double" for c in "abc" for a in "xyz"))
    got = {(r["mesh"], r["layer"], r["id"]): (r["x1"], r["y1"], r["x2"], r["y2"]) for r in linking.plane_segments(df, 0.0, 1.0).collect()}
    s = (1 + 2e-6 - 0.5) / 2
    assert set(got) == {(1, 0, 0), (1, 1, 1), (1, 2, 1)} and got[1, 1, 1] in [pytest.approx(p) for p in ((3 * s, 0, 0, s), (0, s, 3 * s, 0))]


def first_pairs(pieces, eps):
    """The first two chains with touching ends are joined, again and again."""
    chains = [[(i, False)] for i in sorted(pieces)]
    end = lambda c, k: pieces[c[k][0]][(0 if k == 0 else 1) ^ c[k][1]]
    flip = lambda c: [(i, not f) for i, f in reversed(c)]
    while True:
        for i, j in ((i, j) for i in range(len(chains)) for j in range(i + 1, len(chains))):
            a, b = chains[i], chains[j]
            found = next(((x, y) for x, y in ((a, b), (a, flip(b)), (flip(a), b), (flip(a), flip(b))) if math.dist(end(x, -1), end(y, 0)) <= eps), None)
            if found:
                chains[i] = found[0] + found[1]
                del chains[j]
                break
        else:
            return chains


def test_polylines_against_the_first_pair_rule(spark):
    """Free of ties: lines cut into pieces, turned and shuffled, and a ring."""
    rng = random.Random(8)
    rows, pieces = [], {}
    ids = list(range(1000))
    rng.shuffle(ids)
    for line in range(12):
        n = rng.choice([1, 2, 3, 9, 30])
        pts = [(10 * k + rng.random(), 1000 * line + rng.random()) for k in range(n + 1)] if line else ring(rng, 7, -500, 0, 50) + [(-450, 0)]
        for a, b in zip(pts, pts[1:], strict=False):
            b = (b[0] + 0.01, b[1])
            i = ids.pop()
            pieces[i] = (a, b) if rng.random() < 0.5 else (b, a)
            rows.append((1, i, *map(float, pieces[i][0] + pieces[i][1])))
    order = linking.joined(spark.createDataFrame(rows, SEG.replace("seg", "piece")), 0.05).cache()
    got = defaultdict(list)
    for r in order.orderBy("chain", "pos").collect():
        got[r["chain"]].append((r["piece"], r["flipped"]))
    closed = lambda c: len(c) == 7 and all(pieces[i][0][0] < -400 for i, _ in c)
    want = {}
    for c in first_pairs(pieces, 0.05):
        if closed(c):
            at = min(range(7), key=lambda k: c[k][0])
            c = c[at:] + c[:at] if not c[at][1] else [(i, not f) for i, f in reversed(c[at + 1 :] + c[: at + 1])]
        elif len(c) > 1 and c[0][0] > c[-1][0]:
            c = [(i, not f) for i, f in reversed(c)]
        want[c[0][0]] = c
    assert dict(got) == want
    points = spark.createDataFrame([(i, k, *map(float, p)) for i, ps in pieces.items() for k, p in enumerate([ps[0], ps[0], ps[1]])], "piece long, i int, x double, y double")
    n = {r["chain"]: r["n"] for r in linking.joined_points(points, order).groupBy("chain").agg(F.count("*").alias("n")).collect()}
    assert n == {k: 2 * len(c) for k, c in want.items()}
    order.unpersist()


def test_nothing_to_link(spark):
    none = spark.createDataFrame([], SEG)
    assert linking.loops(none).count() == 0 and linking.joined(none.withColumnRenamed("seg", "piece"), 1.0).count() == 0
    assert linking.nesting(linking.loops(none), 1.0).count() == 0
