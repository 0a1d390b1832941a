"""Inputs on which queries once differed from their SQL, or plans that did not grow with their input."""

from pyspark.sql import functions as F

from netloom.plans import rewrites, state


def as_sql(df, duck_sql, folder, names):
    """Rows of a query, and of its SQL over the same tables of the folder."""
    import duckdb

    con = duckdb.connect()
    for t in names:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return sorted(tuple(r) for r in df.collect()), sorted(con.execute(duck_sql).fetchall())


def test_numbers_of_five_digits(spark, tmp_path):
    """A brand of more than 9,999 parts: the SQL pads to, and cuts at, four digits."""
    k = F.col("id")
    spark.range(10_050).select(k.alias("p_partkey"), F.lit("Brand#1").alias("p_brand"), (k % 90 * 20.0).alias("p_retailprice"), (k % 50).cast("int").alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    from netloom import registry

    got, want = as_sql(state.row_column_tags(spark, str(tmp_path)), registry.oracles()["row_column_tags"], tmp_path, ["part"])
    assert got == want


def test_express_hop_over_many_stops(spark, tmp_path):
    """A pattern of fifteen stops, of which only the ends are fast: a way of fourteen hops."""
    from netloom import registry

    k = F.col("id")
    spark.range(15).select(F.lit(7).cast("long").alias("l_orderkey"), (k * 3 + 1).alias("l_partkey"), (k % 4).alias("l_suppkey"), (k + 1).cast("int").alias("l_linenumber")).write.parquet(f"{tmp_path}/lineitem.parquet")
    for t, c in (("orders", "o_orderkey long, o_custkey long"), ("customer", "c_custkey long, c_nationkey long")):
        spark.createDataFrame([(7, 7)], c).write.parquet(f"{tmp_path}/{t}.parquet")
    got, want = as_sql(rewrites.express_expansion(spark, str(tmp_path)), registry.oracles()["express_expansion"], tmp_path, ["lineitem", "orders", "customer"])
    assert len(want) == 30 and got == want


def sent_to_all(df):
    """Joins on grid cells whose dealt side is sent to all tasks; Spark's estimate of it leaves out how many cells a row is dealt to."""
    import re

    return re.findall(r"BroadcastHashJoin \[(?:r|c|cx|cy|k|sheet|line)#", df._jdf.queryExecution().executedPlan().toString())


def test_dealt_rows_are_shuffled(spark, data_dir):
    from netloom.operators import matching, proximity
    from netloom.plans import geometry

    st = geometry.stations(spark, data_dir)
    assert not sent_to_all(proximity.within(st, "station", 2500.0))
    assert not sent_to_all(geometry.stations_within_radius(spark, data_dir))
    box = spark.range(50).select("id", *[F.col("id").cast("double").alias(c) for c in ("x0", "y0")], *[(F.col("id") + 5.0).alias(c) for c in ("x1", "y1")])
    assert not sent_to_all(proximity.overlapping(box, box, 8.0))
    labels = spark.range(50).select("id", F.lit(0).alias("sheet"), F.lit(10.0).alias("em"), F.lit(0).alias("angle"), F.lit(1.0).alias("x"), (F.col("id") * 10.0).alias("y"))
    assert not sent_to_all(matching.labels_below(labels, 32.0))


def test_labels_meet_in_shuffled_cells(spark, data_dir):
    from netloom.operators import labels as L
    from netloom.plans.labels import GAP, SIZE, town_labels

    s, markers, lines = town_labels(spark, data_dir)
    free = L.free_places(L.candidates(s, GAP, turned=False), markers, lines, (-1e9, -1e9, 1e9, 1e9), GAP, SIZE)
    assert not sent_to_all(free)


def test_pairs_apart(spark):
    """Pairs over the borders of cells and bands, each once, the smaller first; those named apart are left out, either way round."""
    import math

    rows = [(i, 40 + (i * 37 % 101) / 400, -75 + (i * 53 % 97) / 400) for i in range(120)]
    points = spark.createDataFrame(rows, "id long, lat double, lon double")

    def metres(p, q):
        return math.hypot((p[2] - q[2]) * 111320 * math.cos(math.radians((p[1] + q[1]) / 2)), (p[1] - q[1]) * 110574)

    want = sorted((p[0], q[0]) for p in rows for q in rows if p[0] < q[0] and metres(p, q) <= 2500)
    from netloom.operators import proximity

    assert sorted(tuple(r)[:2] for r in proximity.within(points, "id", 2500.0).collect()) == want
    out = [want[0], want[5][::-1]]
    left = proximity.within(points, "id", 2500.0, apart=spark.createDataFrame(out, "a long, b long"))
    assert sorted(tuple(r)[:2] for r in left.collect()) == [w for i, w in enumerate(want) if i not in (0, 5)]


def settled_first(df, keys):
    import re

    return len(re.findall(rf"Aggregate \[{keys}\]", df._jdf.queryExecution().optimizedPlan().toString()))


def test_keys_are_settled_before_lines_meet_them(spark):
    """What a number, a name or a word offers, and the stations of a place, are one row before they are joined: joins grow with the lines, not with lines times labels."""
    from netloom.operators import matching

    lines = spark.createDataFrame([(i, 1, "7", "segment harbour eastwards") for i in range(40)], "c_custkey long, grp long, ref string, name string")
    pub = spark.createDataFrame([(i, 1, "Line 7" + " (old)" * (i % 2), i % 5) for i in range(60)] + [(99, 1, "segment harbour eastwards", 1)], "p_partkey long, grp long, label string, n long")
    found = matching.published(lines, pub)
    assert settled_first(found, r"grp#\d+L?, [^\]]*") == 3
    assert {tuple(r)[1:] for r in found.collect()} == {(2, 4)} and found.count() == 40
    off = spark.createDataFrame([(i, "x", "none", 10, 10) for i in range(30)], "id long, key string, alias string, x long, y long")
    st = spark.createDataFrame([(i, f"k{i}", 12, 10) for i in range(50, 80)] + [(90, "k90", 17, 10)], "station long, key string, x long, y long")
    near = matching.resolve(off, st, spark.createDataFrame([("a", 1)], "alias string, station long"), 6)
    assert settled_first(near, r"x#\d+L?, y#\d+L?") >= 2
    assert {tuple(r)[1:] for r in near.collect()} == {(50, "near")} and near.count() == 30


def test_files_of_the_matrix_hold_few_blocks(spark):
    """Twenty texts of a block each in one task: a reader holds the blocks of a file at once, so a file holds few."""
    from netloom.llm import importance

    docs = spark.range(20).coalesce(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 100_000).alias("text"))
    m = importance.matrix(docs)
    assert m.count() == 20
    assert m.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] <= 16


def test_points_meet_few_of_dense_segments(spark):
    """Nine hundred segments in a square of sixty: at a reach of two, a point meets those around it, not all of its neighbourhood's size class; the nearest is that of all."""
    import math

    from netloom.operators import proximity

    seg = [(i, float(i * 37 % 61), float(i * 91 % 59), float(i * 37 % 61 + i % 23), float(i * 91 % 59 + i % 17)) for i in range(900)]
    pts = [(i, float(i * 53 % 71), float(i * 29 % 67)) for i in range(40)]
    s, p = spark.createDataFrame(seg, "seg long, ax double, ay double, bx double, by double"), spark.createDataFrame(pts, "id long, x double, y double")

    def dist(x, y, ax, ay, bx, by):
        dx, dy = bx - ax, by - ay
        n = dx * dx + dy * dy
        t = 0.0 if n == 0 else max(0.0, min(1.0, ((x - ax) * dx + (y - ay) * dy) / n))
        return math.hypot(x - (ax + t * dx), y - (ay + t * dy))

    d = {(i, k): dist(x, y, *e) for i, x, y in pts for k, *e in seg}
    near = {(r["id"], r["seg"]) for r in proximity.met_segments(p, s, 2.0).collect()}
    assert near == {k for k, v in d.items() if v <= 2.0}
    got = {r["id"]: r["d"] for r in proximity.nearest_segment(p, s, 32.0).collect()}
    assert all(abs(got[i] - min(v for (j, _), v in d.items() if j == i)) < 1e-9 for i, *_ in pts)
