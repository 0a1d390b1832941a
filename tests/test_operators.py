"""Invariants and small cases with known results."""

import math

from pyspark.sql import functions as F

from netloom.functions import text as T
from netloom.operators import fold, graph, proximity, sequence, spans


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_upper_median_of_an_even_number_is_the_upper(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (1, 2, 3, 4)], "k int, v double")
    assert sequence.upper_median(df, ["k"], "v").first()["upper_median"] == 3.0


def test_names(spark):
    assert one(spark, T.normalize_name(F.lit("Gare de l'Église  Station"))) == "deleglise"
    assert one(spark, T.slug(F.lit("Café — Nord!"))) == "cafe-nord"
    assert one(spark, T.slug(F.lit("Москва"))) == "x"
    assert one(spark, T.ref_family(F.lit("RE 12"))) == "re"
    assert one(spark, T.ref_family(F.lit("7bis"))) == "7bis"
    assert one(spark, T.expand_abbreviations(F.lit("N. Broad St. (upper), Phila"))) == "North Broad Street Philadelphia"
    assert one(spark, T.decode_entities(F.lit("&amp;lt;"))) == "<"


def test_colours(spark):
    c = lambda s: one(spark, T.normalize_colour(F.lit(s), F.lit("#000001")))
    assert [c("Red"), c("ABC"), c("#A1B2C3"), c("rgb(1, 2, 300)"), c("nope"), c("")] == ["#e4002b", "#aabbcc", "#a1b2c3", "#010212c", "#000001", "#000001"]
    assert one(spark, T.drawing_colour(F.lit("none"))) is None


def test_durations(spark):
    f = lambda s: one(spark, T.format_duration(F.lit(s).cast("double")))
    assert [f(90.0), f(3599.0), f(90000.0), f(None)] == ["2m", "60m", "1d 1h 0m", "—"]


def test_farm_spec(spark):
    got = one(spark, T.farm_spec(F.lit("a1:3, s3,x:0,y:1")))
    assert [(r["id"], r["n"]) for r in got] == [("a1", 3), ("s3", 1), ("x", 1), ("y", 1)]


def test_spans_add_up(spark):
    a = spark.createDataFrame([(1, 0, 10), (1, 5, 20), (2, 0, 4)], "k int, lo int, hi int")
    b = spark.createDataFrame([(1, 3, 6), (1, 18, 30)], "k int, lo int, hi int")
    left = sorted(map(tuple, spans.subtract(a, b, ["k"]).collect()))
    assert left == [(1, 0, 3), (1, 6, 18), (2, 0, 4)]
    assert sorted(map(tuple, spans.covered_by(a, ["k"], 2).collect())) == [(1, 5, 10)]


def test_clusters_follow_the_running_mean(spark):
    """Points 400 m apart in a row: the third is 600 m from the mean of the first two, the fourth opens a cluster."""
    step = 400 / 110574
    nodes = spark.createDataFrame([("a", i, i, i * step, 0.0) for i in range(4)], "name string, ord int, id long, lat double, lon double")
    got = {r["id"]: r["cluster"] for r in fold.greedy_clusters(nodes, "name", "ord").collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3}


def test_schedule_longest_first(spark):
    jobs = spark.createDataFrame([(1, j, j * 3600.0, None) for j in range(1, 6)], "farm long, job long, seconds double, kind string")
    pool = spark.createDataFrame([(1, f"p{i}", "a", 1.0, i) for i in range(3)], "farm long, machine string, kind string, factor double, ord int")
    got = fold.schedule(jobs, pool, "farm", changeover_s=0.0).collect()
    assert len(got) == 5 and max(r["end_s"] for r in got) == 5 * 3600.0
    assert math.isclose(sum(r["end_s"] - r["start_s"] for r in got), 15 * 3600.0)


def test_schedule_without_a_fitting_machine(spark):
    jobs = spark.createDataFrame([(1, 1, 10.0, "z")], "farm long, job long, seconds double, kind string")
    pool = spark.createDataFrame([(1, "p", "a", 1.0, 0)], "farm long, machine string, kind string, factor double, ord int")
    assert fold.schedule(jobs, pool, "farm").collect() == []


def test_matching_is_one_to_one(spark):
    pairs = spark.createDataFrame([(1, 1, 1, 5.0), (1, 1, 2, 1.0), (1, 2, 2, 2.0), (1, 2, 1, 9.0)], "k long, a long, b long, d double")
    assert sorted((r["a"], r["b"]) for r in fold.greedy_matching(pairs, "k").collect()) == [(1, 2), (2, 1)]


def test_packed_items_do_not_overlap(spark):
    items = spark.createDataFrame([(1, i, 20.0 + i % 7, 10.0 + i % 5) for i in range(40)], "k long, item long, w double, h double")
    got = [(r["plate"], r["x"], r["y"], 20.0 + r["item"] % 7, 10.0 + r["item"] % 5) for r in fold.shelves(items, "k", 60.0, 50.0).collect()]
    assert len(got) == 40 and all(x + w <= 60 and y + h <= 50 for _, x, y, w, h in got)
    for i, (p, x, y, w, h) in enumerate(got):
        assert not any(q == p and x < u + s and u < x + w and y < v + t and v < y + h for q, u, v, s, t in got[:i])


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    got = {r["id"]: r["component"] for r in graph.connected_components(e).collect()}
    assert set(got.values()) == {1, 100} and len(got) == 42


def test_within_equals_brute_force(spark):
    pts = [(i, 40 + (i * 7919 % 1000) / 20000, -75 + (i * 104729 % 1000) / 20000) for i in range(200)]
    got = {(r["a"], r["b"]) for r in proximity.within(spark.createDataFrame(pts, "k int, lat double, lon double"), "k", 300.0).collect()}

    def d(p, q):
        return math.hypot((p[2] - q[2]) * 111320 * math.cos(math.radians((p[1] + q[1]) / 2)), (p[1] - q[1]) * 110574)

    assert got == {(p[0], q[0]) for p in pts for q in pts if p[0] < q[0] and d(p, q) <= 300}


def test_empty_tables(spark):
    e = spark.createDataFrame([], "a long, b long")
    assert graph.connected_components(e).count() == 0
    assert spans.subtract(spark.createDataFrame([], "k int, lo int, hi int"), spark.createDataFrame([], "k int, lo int, hi int"), ["k"]).count() == 0
    assert fold.greedy_matching(spark.createDataFrame([], "k long, a long, b long, d double"), "k").count() == 0
