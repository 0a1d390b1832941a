import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from netloom.operators import paths

POINTS = "path long, i long, x double, y double"


def walks(seed, n):
    rng = random.Random(seed)
    out = {}
    for k in range(n):
        p = [(0.0, 0.0)]
        for _ in range(rng.randrange(1, 9)):
            a, r = rng.choice([0, 90, 180, 270, 45, 17, 163]) * math.pi / 180, rng.uniform(5, 40)
            p.append((p[-1][0] + r * math.cos(a), p[-1][1] + r * math.sin(a)))
        out[k] = p
    return out


def frame(spark, ps):
    return spark.createDataFrame([(k, i, *q) for k, p in ps.items() for i, q in enumerate(p)], POINTS)


def lines(df):
    out = defaultdict(list)
    for r in df.orderBy("path", "i").collect():
        out[r["path"]].append((r["x"], r["y"]))
    return dict(out)


def close(got, want):
    assert set(got) == set(want)
    for k in want:
        assert [c for p in got[k] for c in p] == pytest.approx([c for p in want[k] for c in p], abs=1e-6), k


def beside(p, d):
    unit = lambda a, b: ((b[0] - a[0]) / math.dist(a, b), (b[1] - a[1]) / math.dist(a, b))
    put = lambda q, u: (q[0] - u[1] * d, q[1] + u[0] * d)
    out = []
    for i, q in enumerate(p):
        u, v = unit(p[i - 1], q) if i else None, unit(q, p[i + 1]) if i + 1 < len(p) else None
        if u is None or v is None:
            out.append(put(q, u or v))
            continue
        a, b, den = put(q, u), put(q, v), u[0] * v[1] - u[1] * v[0]
        t = ((b[0] - a[0]) * v[1] - (b[1] - a[1]) * v[0]) / den if abs(den) >= 1e-9 else None
        m = (a[0] + u[0] * t, a[1] + u[1] * t) if t is not None else None
        out += [m] if m and math.dist(m, q) < 3 * abs(d) else [a, b]
    return out


def test_offsets_of_any_walks(spark):
    ps = walks(1, 60)
    for d in (2.0, -3.5):
        close(lines(paths.offset(frame(spark, ps), F.lit(d))), {k: beside(p, d) for k, p in ps.items()})
    close(lines(paths.offset(frame(spark, ps), F.lit(0.0))), ps)
    assert paths.offset(frame(spark, {0: [(1.0, 1.0)]}), F.lit(2.0)).count() == 0


def test_round_corners(spark):
    """Arcs touch both sides, their points lie a radius from one middle, and ends stay."""
    ps = {0: [(0.0, 0.0), (20.0, 0.0), (20.0, 20.0)], 1: [(0.0, 0.0), (20.0, 0.0), (20.0, 2.0)], 2: [(0.0, 0.0), (9.0, 0.0), (20.0, 0.0), (0.0, 0.001)], 3: [(0.0, 0.0), (1.0, 1.0)]}
    got = lines(paths.fillet(frame(spark, ps), 5.0))
    assert got[0][0] == (0, 0) and got[0][-1] == (20, 20) and len(got[0]) in (11, 12)
    assert all(math.dist(p, (15, 5)) == pytest.approx(5) for p in got[0][1:-1]) and got[0][1] == pytest.approx((15, 0)) and got[0][-2] == pytest.approx((20, 5))
    assert got[1][1] == pytest.approx((19, 0)) and all(math.dist(p, (19, 1)) == pytest.approx(1) for p in got[1][1:-1])
    assert got[2] == ps[2] and got[3] == ps[3]
    close(lines(paths.fillet(frame(spark, ps), 0.0)), ps)


def test_pieces_fit_and_cover_the_path(spark):
    rng = random.Random(7)
    ps = walks(2, 40) | {100: [(5.0 * i, 0.0) for i in range(101)], 101: [(0.0, 0.0), (5.0, 0.0)], 102: [(3.0, 3.0)], 103: [(0.0, 0.0), (60.0, 0.0), (60.0, 12.0)]}
    length = {k: sum(math.dist(a, b) for a, b in zip(p, p[1:], strict=False)) for k, p in ps.items()}
    marks = [(k, rng.uniform(0, length[k])) for k in range(20) for _ in range(8)] + [(100, s * 25.0) for s in range(21)]
    df = paths.split_for_bed(frame(spark, ps), spark.createDataFrame(marks, "path long, s double"), 2.0, 64.0, 40.0)
    got = defaultdict(lambda: defaultdict(list))
    for r in df.orderBy("path", "piece", "i").collect():
        got[r["path"]][r["piece"]].append((r["x"], r["y"]))
    assert set(got) == set(ps)
    for k, pieces in got.items():
        parts = [pieces[n] for n in sorted(pieces)]
        assert parts[0][0] == pytest.approx(ps[k][0]) and parts[-1][-1] == pytest.approx(ps[k][-1])
        assert all(a[-1] == pytest.approx(b[0]) for a, b in zip(parts, parts[1:], strict=False))
        sizes = [sum(math.dist(a, b) for a, b in zip(p, p[1:], strict=False)) for p in parts]
        assert sum(sizes) == pytest.approx(length[k])
        for p in parts:
            w, h = (max(q[c] for q in p) - min(q[c] for q in p) + 4 for c in (0, 1))
            assert (w <= 64 + 1e-6 and h <= 40 + 1e-6) or (h <= 64 + 1e-6 and w <= 40 + 1e-6)
    # the last middle between two stations that still fits and leaves 30 behind, each time
    assert [got[100][n][0][0] for n in sorted(got[100])] == pytest.approx([0.0, *[37.5 + 50 * n for n in range(10)]])
    assert len(got[101]) == 1 and got[102] == {0: [(3.0, 3.0)]}


def test_pieces_of_the_stairs(spark, data_dir):
    from netloom.plans import shapes as plan

    box = plan.bed_pieces(spark, data_dir).groupBy("path", "piece").agg(*[(F.max(c) - F.min(c) + 5).alias(c) for c in "xy"])
    assert box.filter("not ((x <= 60.000001 and y <= 40.000001) or (y <= 60.000001 and x <= 40.000001))").isEmpty() and box.count() > 0


def test_points_come_as_columns(spark, monkeypatch):
    """F8: neither a row of the input nor one of the result is an object of its own; keys that are missing are one path, and a path may span batches."""
    monkeypatch.setattr(paths, "ordered_fold", None, raising=False)
    k, width = F.col("id"), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        points = spark.range(60).select(F.when(k >= 20, F.floor(k / 20)).cast("long").alias("path"), (k % 20).alias("i"), (k % 20 * 10.0).alias("x"), (k % 3).cast("double").alias("y"))
        marks = spark.range(60).select(F.when(k >= 20, F.floor(k / 20)).cast("long").alias("path"), (k % 20 * 11.0).alias("s"))
        got = {}
        for r in paths.split_for_bed(points, marks, 1.0, 60.0, 40.0).orderBy("path", "piece", "i").collect():
            got.setdefault(r["path"], {}).setdefault(r["piece"], []).append((r["x"], r["y"]))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", width)
    assert set(got) == {None, 1, 2}
    for path, cut in got.items():
        assert sorted(cut) == list(range(len(cut))) and len(cut) > 3
        first = 20 * (path or 0)
        whole = [(i * 10.0, float((first + i) % 3)) for i in range(20)]
        assert {p for p in whole} <= {p for v in cut.values() for p in v} and cut[0][0] == whole[0] and cut[len(cut) - 1][-1] == whole[-1]
        assert all(max(x for x, _ in v) - min(x for x, _ in v) <= 58 + 1e-9 for v in cut.values())
        assert all(cut[n][-1] == cut[n + 1][0] for n in range(len(cut) - 1))
