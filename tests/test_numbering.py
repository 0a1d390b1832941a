import random

from netloom.operators import matching, sequence


def test_numbers_within_keys_of_any_size(spark):
    """One key with most rows, many with one; ties of all but the last column."""
    rng = random.Random(1)
    rows = [(0 if rng.random() < 0.7 else rng.randrange(300), rng.randrange(5), i) for i in range(3000)]
    got = {r["i"]: r["n"] for r in sequence.numbered(spark.createDataFrame(rows, "k long, v long, i long").repartition(7), ["k"], "v", "i", name="n").collect()}
    want, at = {}, {}
    for k, _, i in sorted(rows):
        at[k] = at.get(k, 0) + 1
        want[i] = at[k]
    assert got == want


def test_keys_that_hold_each_other(spark):
    rng = random.Random(2)
    keys = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(0, 9))) for _ in range(300)})
    a, b = rng.sample(keys, 90), rng.sample(keys, 90)
    got = {tuple(r) for r in matching.containing(spark.createDataFrame([(x,) for x in a], "k string"), spark.createDataFrame([(x,) for x in b], "n string")).collect()}
    assert got == {(x, y) for x in a for y in b if x and y and (x in y or y in x)}


def test_shapes_of_very_different_sizes(spark):
    """Boxes and segments from a hundredth to a million sizes: dealt to few cells, and none lost."""
    import math

    from netloom.operators import proximity

    rng = random.Random(3)
    size = lambda: 10 ** rng.uniform(-2, 6)
    boxes = [(i, x := rng.uniform(-1e3, 1e3), y := rng.uniform(-1e3, 1e3), x + size(), y + size()) for i in range(60)]
    df = spark.createDataFrame(boxes, "id long, x0 double, y0 double, x1 double, y1 double")
    got = {tuple(r) for r in proximity.overlapping(df, df, 1.0).collect()}
    assert got == {(a[0], b[0]) for a in boxes for b in boxes if a[1] < b[3] and b[1] < a[3] and a[2] < b[4] and b[2] < a[4]}
    segs = [(i, *(rng.uniform(-1, 1) * size() for _ in range(4))) for i in range(40)]
    pts = [(i, rng.uniform(-1e3, 1e3), rng.uniform(-1e3, 1e3)) for i in range(50)]

    def far(p, s):
        dx, dy = s[3] - s[1], s[4] - s[2]
        t = max(0, min(1, ((p[1] - s[1]) * dx + (p[2] - s[2]) * dy) / (dx * dx + dy * dy)))
        return math.hypot(p[1] - s[1] - t * dx, p[2] - s[2] - t * dy)

    near = proximity.nearest_segment(spark.createDataFrame(pts, "id long, x double, y double"), spark.createDataFrame(segs, "seg long, ax double, ay double, bx double, by double"), 1.0)
    assert {r["id"]: r["seg"] for r in near.collect()} == {p[0]: min(segs, key=lambda s: (far(p, s), s[0]))[0] for p in pts}
