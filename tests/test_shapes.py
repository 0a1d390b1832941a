import random

from pyspark.sql import functions as F

from netloom.operators import shapes


def frame(spark, pts, k=1):
    return spark.createDataFrame([(k, i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "k long, ord long, x double, y double")


def test_hull_holds_all_points(spark):
    rnd = random.Random(1)
    pts = [(rnd.randint(0, 50), rnd.randint(0, 50)) for _ in range(200)]
    hull = [(r["x"], r["y"]) for r in shapes.convex_hull(frame(spark, pts), "k").orderBy("ord").collect()]
    for a, b in zip(hull, hull[1:] + hull[:1]):
        assert all((b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= 0 for x, y in pts)
    assert len(shapes.convex_hull(frame(spark, [(1, 1), (1, 1)]), "k").collect()) == 1


def test_simplified_paths(spark):
    zigzag = [(i, (i % 2) * 0.1) for i in range(10)] + [(10, 8), (11, 0)]
    assert [r["ord"] for r in shapes.simplify(frame(spark, zigzag), "k", 0.5).orderBy("ord").collect()] == [0, 9, 10, 11]
    assert [r["ord"] for r in shapes.drop_collinear(frame(spark, [(0, 0), (1, 0), (2, 0), (2, 1)]), "k", 1e-9).orderBy("ord").collect()] == [0, 2, 3]
    assert shapes.simplify(frame(spark, [(0, 0)]), "k", 1.0).count() == 1


def test_a_bridge_does_not_merge_clusters(spark):
    got = [r["cluster"] for r in shapes.marker_clusters(frame(spark, [(0, 0), (20, 0), (10, 0)]), "k", 10.0).orderBy("ord").collect()]
    assert got == [0, 1, 0]


def test_snapped_cells_are_unique(spark):
    pts = frame(spark, [(0.1, 0.1)] * 200).select("k", F.col("ord").alias("rank"), F.col("ord").alias("id"), "x", "y")
    cells = [(r["gx"], r["gy"]) for r in shapes.snap(pts, "k", 1.0).collect()]
    placed = [c for c in cells if c[0] is not None]
    assert len(placed) == len(set(placed)) == 169 and len(cells) == 200


def test_merges_are_followed(spark):
    p = spark.createDataFrame([(1, 1, 2, 1.0, "A", "B"), (1, 2, 3, 2.0, "B", "A / B")], "k long, a long, b long, d double, name_a string, name_b string")
    got = {r["station"]: (r["target"], r["name"]) for r in shapes.merge_interchanges(p, "k").collect()}
    assert got == {1: (1, "A / B"), 2: (1, "A / B"), 3: (1, "A / B")}
