"""What was left of round 3: plans that repeated their own steps, or grew faster than their input."""

import pytest
from pyspark.sql import functions as F

from netloom.operators import drawing, markup


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def path(spark):
    return spark.createDataFrame([(1, "M1 1l2 2zm3 3h4V9A2 2 0 0 1 5 5")], "p long, d string").withColumn("m", markup.matrix(1.0, 0.0, 0.0, 1.0, 0.0, 0.0))


def test_commands_stay_within_their_path(path):
    """F8: the places of commands, along both axes, take one shuffle and no join (the starts of subpaths were joined once an axis)."""
    p = plan(drawing.positions(drawing.commands(path, ["p"]), ["p"]))
    assert "Join" not in p and p.count("Exchange hashpartitioning") == 1


def test_arcs_are_not_written_out_in_themselves(path):
    """F8: an arc's turn was repeated at each of its uses, some hundred times."""
    assert plan(drawing.path_points(path, ["p"])).count("ATAN2") <= 6


def test_places_of_relative_and_absolute_subpaths(path):
    got = [(r["cmd"], r["x"], r["y"]) for r in drawing.positions(drawing.commands(path, ["p"]), ["p"]).orderBy("at").collect()]
    assert got == [("M", 1, 1), ("l", 3, 3), ("z", 1, 1), ("m", 4, 4), ("h", 8, 4), ("V", 8, 9), ("A", 5, 5)]


def test_texts_are_listed_by_their_writers(spark, tmp_path):
    """tasks write and list the files; neither the commit nor the reader looks at each in the driver. Keys come back as they were."""
    from netloom.sources import writers

    rows = [("007", 2, "b"), ("007", 1, "a"), ("x/y =%", 1, "é"), ("", 1, None), (None, 1, "none")]
    writers.write_texts(spark.createDataFrame(rows, "k string, n int, line string"), f"{tmp_path}/t", "k", "n", "line")
    got = writers.read_texts(spark, f"{tmp_path}/t")
    assert {r["key"]: r["text"] for r in got.collect()} == {"007": "a\nb\n", "x/y =%": "é\n", "": "\n", None: "none\n"}
    assert all(f"/{writers.INDEX}/" in f for f in got.inputFiles())
    assert not [f for f in tmp_path.rglob("key=*/_*")]


def test_tasks_follow_the_input_at_any_number_of_partitions(spark, monkeypatch):
    """partitions without a number are merged by their bytes, twelve or so at any size; a number is kept."""
    from netloom.operators import shared

    monkeypatch.setattr(shared, "ROWS_A_TASK", 500)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        assert ", 10), REPARTITION_BY_NUM" in plan(shared.dealt(spark.range(5_000), ["id"], 5_000))
        assert shared.dealt(spark.range(5_000), ["id"], 5_000).rdd.getNumPartitions() == 10
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_boxes_on_each_other_are_tried_once(spark):
    """of ten thousand boxes that reach into the same cells, only those meet of which one begins there."""
    import random

    from netloom.operators import proximity

    rng = random.Random(5)
    at = lambda: rng.choice([rng.uniform(-40, 40), float(rng.randrange(-40, 40))])
    rows = []
    for i in range(300):
        x, y, w, h = at(), at(), rng.choice([0.0, 1.0, 3.0, 8.0, 30.0]), rng.choice([0.0, 2.0, 8.0, 20.0])
        rows.append((i % 290, x, y, x + w, y + h))  # some ids twice
    boxes = spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double")
    want = sorted((a[0], b[0]) if a[0] < b[0] else (b[0], a[0]) for i, a in enumerate(rows) for b in rows[:i] if a[0] != b[0] and a[1] < b[3] and b[1] < a[3] and a[2] < b[4] and b[2] < a[4])
    got = proximity.touching(boxes, 8.0)
    assert sorted((r["a"], r["b"]) for r in got.collect()) == want and len(want) > 500
    # a box that covers 8 cells a side meets a box inside it in one of them, and those that cover the same cells in one
    deep = spark.range(1_000).select("id", (F.col("id") % 7 / 8).alias("x0"), (F.col("id") % 5 / 8).alias("y0"), F.lit(8.0).alias("x1"), F.lit(8.0).alias("y1"))
    met = proximity.touching(deep, 8.0)
    assert "pair" in plan(met).split("SortMergeJoin", 1)[1].split("]")[0] and met.count() == 499_500


def test_streets_stay_away_from_the_poles(spark, tmp_path):
    """lines were laid out ever further north; from the 19 millionth on, stops of a line came together at the pole and were merged."""
    import duckdb

    from netloom import registry

    rows = [(19_500_000 + i, 3 * i + 7 * j * (i + 1), j, j + 1) for i in range(8) for j in range(5)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    con.execute("CREATE TABLE orders (o_orderkey BIGINT, o_custkey BIGINT); CREATE TABLE customer (c_custkey BIGINT, c_nationkey BIGINT)")
    want = con.sql(f"SELECT station, target, name FROM ({registry.oracles()['interchange_merging']})").fetchall()
    got = registry.queries()["interchange_merging"](spark, str(tmp_path)).select("station", "target", "name").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 4
