import math
import random
from collections import defaultdict

import numpy as np

from netloom.operators import fold, packing
from netloom.plans import state


def corners(r, xs, ys):
    t = math.radians(r["turn"])
    return [(x * math.cos(t) - y * math.sin(t) + r["dx"], x * math.sin(t) + y * math.cos(t) + r["dy"]) for x, y in zip(xs, ys, strict=True)]


def apart(a, b):
    """How far an edge's normal keeps two convex outlines apart."""
    best = -math.inf
    for poly in (a, b):
        for (x0, y0), (x1, y1) in zip(poly, poly[1:] + poly[:1], strict=True):
            n = math.hypot(x1 - x0, y1 - y0)
            on = lambda q: [((y1 - y0) * x - (x1 - x0) * y) / n for x, y in q]  # noqa: B023, E731
            best = max(best, min(on(b)) - max(on(a)), min(on(a)) - max(on(b)))
    return best


def test_packed_triangles_keep_apart(spark, data_dir):
    """All are placed on their bed, with room between them, on fewer plates than rows of rectangles take."""
    items = state.triangles_to_print(spark, data_dir)
    shape = {r["item"]: r for r in items.collect()}
    got = state.bitmap_pack(spark, data_dir).collect()
    assert {r["item"] for r in got} == set(shape) and len(got) == len(shape)
    plates = defaultdict(list)
    for r in got:
        c = corners(r, shape[r["item"]]["xs"], shape[r["item"]]["ys"])
        assert not r["oversize"] and all(-1e-9 <= v <= 180 + 1e-9 for p in c for v in p)
        plates[r["grp"], r["plate"]].append(c)
    rng = random.Random(1)
    for on in rng.sample(list(plates.values()), min(120, len(plates))):
        for i, a in enumerate(on):
            assert all(apart(a, b) >= packing.GAP - 1e-6 or apart(a, b) > 0 for b in on[:i])
    rows = fold.shelves(items.selectExpr("grp", "item", f"xs[1] + {packing.GAP} AS w", f"ys[2] + {packing.GAP} AS h"), "grp", 180.0, 180.0)
    assert len(plates) < rows.select("grp", "plate").distinct().count()


def test_first_places_against_every_place():
    """The lowest free place by trying every cell."""
    rng = np.random.default_rng(3)
    for _ in range(60):
        wide, high = int(rng.integers(8, 40)), int(rng.integers(8, 30))
        taken = rng.random((high, wide)) < 0.15
        n = int(rng.integers(3, 6))
        mask = packing.Mask((rng.random(n) * 8).tolist(), (rng.random(n) * 8).tolist(), int(rng.choice(packing.TURNS)), 1.0, 2.0)
        cells = np.array([[b >> x & 1 for x in range(mask.w)] for b in mask.bits], bool)
        want = next(((x, y) for y in range(high - mask.h + 1) for x in range(wide - mask.w + 1) if not (taken[y : y + mask.h, x : x + mask.w] & cells).any()), None)
        grid = [sum(1 << x for x in np.flatnonzero(r).tolist()) for r in taken]
        assert packing.first_place(grid, wide, mask, wide * high + 1) == want


def test_turns_oversize_and_concave_shapes(spark):
    """A strip that fits only when turned, one that never fits, and an L in whose corner a square goes."""
    rows = [
        (1, 1, [0.0, 5.0, 5.0, 0.0], [0.0, 0.0, 55.0, 55.0], 275.0), (1, 2, [0.0, 99.0, 99.0, 0.0], [0.0, 0.0, 99.0, 99.0], 9801.0),
        (2, 1, [0.0, 50.0, 50.0, 10.0, 10.0, 0.0], [0.0, 0.0, 10.0, 10.0, 26.0, 26.0], 1300.0), (2, 2, [0.0, 12.0, 12.0, 0.0], [0.0, 0.0, 12.0, 12.0], 144.0), (3, 1, [0.0, 1.0], [0.0, 1.0], 1.0),
    ]
    got = {(r["grp"], r["item"]): r for r in packing.pack(spark.createDataFrame(rows, "grp long, item long, xs array<double>, ys array<double>, area double"), "grp", (60.0, 32.0)).collect()}
    assert got[1, 2]["oversize"] and got[1, 2]["plate"] == 1 and got[1, 1]["turn"] == 90 and got[1, 1]["plate"] == 2
    assert got[2, 1]["plate"] == got[2, 2]["plate"] == 1 and got[3, 1]["plate"] == 1


def test_few_rows_of_a_shape_are_tried_at_every_place(monkeypatch):
    """four rows of a shape leave few places, which are tried with the whole shape; every row was shifted for all places. Where places fail, all rows are."""
    shapes = [packing.Mask([0.0, w, 0.0], [0.0, 0.0, h], t, 2.5, 1.25) for w, h, t in ((60.0, 70.0, 0), (25.0, 75.0, 90), (40.0, 33.0, 135))]
    for tries in (8, 1):
        monkeypatch.setattr(packing, "TRIES", tries)
        asked, plate = [], packing.Plate([0] * 144, 144)
        spread = plate.spread
        plate.spread = lambda k: asked.append(k) or spread(k)  # noqa: B023
        for m in shapes * 3:
            at = packing.first_on(plate, m, 144 * 144 + 1)
            taken = plate.spreads[0]
            assert at == next(((x, y) for y in range(144 - m.h + 1) for x in range(144 - m.w + 1) if not taken >> y * 144 + x & m.whole(144)), None)
            if at:
                plate.put(m, *at)
        assert tries == 1 or len(asked) < sum(m.h for m in shapes * 3)
