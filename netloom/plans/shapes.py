"""Shapes and what is left of scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import graph, paths, proximity, shapes
from ..operators.shared import saved
from ..registry import query
from .tables import STOPS, stops, table, towns


def _points(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("k"), k.alias("ord"), (k * 7919 % 1009).cast("double").alias("x"), (k * 104729 % 1013).cast("double").alias("y"))


@query("F31")
def convex_hulls(spark: SparkSession, d: str) -> DataFrame:
    return shapes.convex_hull(_points(spark, d), "k")


@query("G19")
def simplified_paths(spark: SparkSession, d: str) -> DataFrame:
    return shapes.simplify(_points(spark, d), "k", 200.0)


@query("W22 W01")
def collinear_paths(spark: SparkSession, d: str) -> DataFrame:
    return shapes.drop_collinear(_points(spark, d), "k", 1e-6)


@query("G12")
def marker_clusters(spark: SparkSession, d: str) -> DataFrame:
    return shapes.marker_clusters(_points(spark, d), "k", 150.0)


@query("G15 T06")
def snapped_points(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d).select("k", F.col("ord").alias("id"), (F.col("x") % 7).alias("rank"), "x", "y")
    return shapes.snap(p, "k", 200.0)


@query("G03 J06")
def merged_interchanges(spark: SparkSession, d: str) -> DataFrame:
    """Near stations of one brand merged by distance. Merges never leave a component of the near pairs, so each is a group."""
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(k.alias("s"), "p_name", "p_brand", *towns(k))
    pairs = saved(proximity.within(p, "s", 300.0, by="p_brand"), "near")
    a, b = p.select(F.col("s").alias("a"), F.col("p_name").alias("name_a")), p.select(F.col("s").alias("b"), F.col("p_name").alias("name_b"))
    part = graph.connected_components(pairs).select(F.col("id").alias("a"), F.col("component").alias("k"))
    return shapes.merge_interchanges(pairs.join(part, "a").join(a, "a").join(b, "b").select("k", "a", "b", F.col("metres").alias("d"), "name_a", "name_b"), "k")


@query(
    "F25",
    """WITH a AS (SELECT p_partkey, ((p_partkey + 3 * 1831565813::BIGINT) & 4294967295)::HUGEINT AS a FROM part), t AS (SELECT p_partkey, (xor(a, a >> 15) * (a | 1)) & 4294967295 AS t FROM a),
    u AS (SELECT p_partkey, xor(t, (t + ((xor(t, t >> 7) * (t | 61)) & 4294967295)) & 4294967295) AS t FROM t) SELECT p_partkey, (xor(t, t >> 14) & 4294967295)::BIGINT AS n FROM u""",
)
def random_jitter(spark: SparkSession, d: str) -> DataFrame:
    """The third number of each part's own generator, as 32 bits."""
    return table(spark, d, "part").select("p_partkey", (shapes.mulberry(F.col("p_partkey"), F.lit(3)) * 4294967296.0).cast("long").alias("n"))


@query(
    "F29",
    """WITH s AS (SELECT p_partkey, (p_partkey % 97)::DOUBLE - 20 AS ax, (p_partkey % 89)::DOUBLE - 20 AS ay, (p_partkey * 7 % 83)::DOUBLE AS bx, (p_partkey * 5 % 79)::DOUBLE AS by_ FROM part),
    p AS (SELECT p_partkey, unnest([ax - bx, bx - ax, ay - by_, by_ - ay]) AS p, unnest([ax - 10, 50 - ax, ay - 10, 50 - ay]) AS q FROM s),
    t AS (SELECT p_partkey, greatest(0, coalesce(max(q / p) FILTER (p < 0), 0)) AS t0, least(1, coalesce(min(q / p) FILTER (p > 0), 1)) AS t1, bool_or(p = 0 AND q < 0) AS out_ FROM p GROUP BY 1)
    SELECT p_partkey, CAST(floor(t0 * 1e6 + 0.5) AS BIGINT) AS t0, CAST(floor(t1 * 1e6 + 0.5) AS BIGINT) AS t1 FROM t WHERE NOT out_ AND t0 <= t1""",
)
def clipped_segments(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    s = table(spark, d, "part").select("p_partkey", ((k % 97).cast("double") - 20).alias("ax"), ((k % 89).cast("double") - 20).alias("ay"), (k * 7 % 83).cast("double").alias("bx"), (k * 5 % 79).cast("double").alias("by"))
    c = shapes.clip_to_box(*(F.col(x) for x in ("ax", "ay", "bx", "by")), *(F.lit(v) for v in (10.0, 10.0, 50.0, 50.0)))
    return s.withColumn("c", c).filter("c is not null").select("p_partkey", F.floor(F.col("c.t0") * 1e6 + 0.5).alias("t0"), F.floor(F.col("c.t1") * 1e6 + 0.5).alias("t1"))


@query(
    "F32 F33 F17",
    """WITH p AS (SELECT p_partkey, (2 * (p_partkey % 50) + 3)::DOUBLE AS x, (p_partkey % 40 - 5)::DOUBLE AS y FROM part)
    SELECT p_partkey, x, y, (x - 0) * (0 - 0) - (y - 0) * (60 - 0) <= 0 AND (0 - 60) * (y - 0) - (30 - 0) * (x - 60) >= 0 AND (0 - 0) * (y - 30) - (0 - 30) * (x - 0) >= 0 AS inside FROM p""",
)
def transformed_points(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    m = F.struct(*[F.lit(v).alias(c) for c, v in zip("abcdef", (2.0, 0.0, 0.0, 1.0, 3.0, -5.0), strict=True)])
    p = table(spark, d, "part").select("p_partkey", shapes.affine(m, (k % 50).cast("double"), (k % 40).cast("double")).alias("p")).select("p_partkey", "p.x", "p.y")
    z, a, b = (F.lit(0.0), F.lit(0.0)), (F.lit(60.0), F.lit(0.0)), (F.lit(0.0), F.lit(30.0))
    return p.withColumn("inside", shapes.in_triangle(F.col("x"), F.col("y"), z, a, b))


@query(
    "F34",
    """WITH i AS (SELECT p_partkey, unnest(range(0, 9)) AS i FROM part) SELECT p_partkey, i::BIGINT AS i, CAST(floor((2 * (1 - i / 8.0::DOUBLE) * (i / 8.0::DOUBLE) * (p_partkey % 100) + (i / 8.0::DOUBLE) * (i / 8.0::DOUBLE) * 50) * 1000 + 0.5) AS BIGINT) AS x FROM i""",
)
def flattened_curves(spark: SparkSession, d: str) -> DataFrame:
    pt = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    curve = shapes.quadratic(pt(F.lit(0), F.lit(0)), pt(F.col("p_partkey") % 100, F.lit(7)), pt(F.lit(50), F.lit(0)), 8)
    return table(spark, d, "part").select("p_partkey", F.posexplode(curve).alias("i", "p")).select("p_partkey", F.col("i").cast("long").alias("i"), F.floor(F.col("p.x") * 1000 + 0.5).alias("x"))


@query("F42 S14 F10 F08", "SELECT c_custkey, md5(replace(c_name, ' ', '_')) AS digest, '\"' || replace(c_name, '\"', '\"\"') || '\"' AS quoted, md5(replace(c_name, ' ', '_'))[1:1] || '/' || md5(replace(c_name, ' ', '_'))[1:2] || '/' || replace(c_name, ' ', '_') AS path FROM customer")
def file_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths of shared media files: a name's digest gives its folders."""
    name = F.replace("c_name", F.lit(" "), F.lit("_"))
    h = F.md5(F.encode(name, "UTF-8"))
    quoted = F.concat(F.lit('"'), F.replace("c_name", F.lit('"'), F.lit('""')), F.lit('"'))
    return table(spark, d, "customer").select("c_custkey", h.alias("digest"), quoted.alias("quoted"), F.concat_ws("/", F.substring(h, 1, 1), F.substring(h, 1, 2), name).alias("path"))


@query(
    "F39",
    """SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'master' ELSE 'route' END AS ref, 'route' AS kind, greatest(0.12, least(0.6, c_acctbal / 10000.0)) AS half_span FROM customer""",
)
def merged_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags of a route under those of its master, which win."""
    route = F.create_map(F.lit("ref"), F.lit("route"), F.lit("kind"), F.lit("route"))
    master = F.when(F.col("c_acctbal") > 0, F.create_map(F.lit("ref"), F.lit("master"))).otherwise(F.create_map().cast("map<string,string>"))
    tags = F.map_concat(F.map_filter(route, lambda k, _: F.try_element_at(master, k).isNull()), master)
    return table(spark, d, "customer").select("c_custkey", tags["ref"].alias("ref"), tags["kind"].alias("kind"), F.greatest(F.lit(0.12), F.least(F.lit(0.6), F.col("c_acctbal") / 10000.0)).alias("half_span"))


@query(
    "J11",
    """WITH l AS (SELECT c_nationkey AS line, c_custkey AS st, (c_custkey * 37 % 991)::DOUBLE AS x, (c_custkey * 91 % 997)::DOUBLE AS y FROM customer), k AS (SELECT n_nationkey AS colour, (n_nationkey * 41 % 991)::DOUBLE AS x, (n_nationkey * 57 % 997)::DOUBLE AS y FROM nation),
    h AS (SELECT line, colour, count(*) AS n, count(*) FILTER (sqrt(pow(l.x - k.x, 2) + pow(l.y - k.y, 2)) <= 300) AS hits, avg(sqrt(pow(l.x - k.x, 2) + pow(l.y - k.y, 2))) AS d FROM l, k GROUP BY 1, 2),
    s AS (SELECT line, colour, hits, CAST(floor((hits / n::DOUBLE) * (0.4 + 0.6 * greatest(0, 1 - d / 300)) * 1e9 + 0.5) AS BIGINT) AS score FROM h)
    SELECT line::BIGINT AS line, colour::BIGINT AS colour, score FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY score DESC, colour) AS r FROM s WHERE score > 150000000 OR hits >= 3) WHERE r = 1""",
)
def scored_colours(spark: SparkSession, d: str) -> DataFrame:
    """The best colour of each line by stations near it. Stations and strokes meet in cells as wide as the reach; distances to all
    stations of a line are taken for the colours that are near one of them only, as others score nothing."""
    reach = 300
    l = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("line"), (F.col("c_custkey") * 37 % 991).cast("double").alias("x"), (F.col("c_custkey") * 91 % 997).cast("double").alias("y"))  # noqa: E741
    k = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("colour"), (F.col("n_nationkey") * 41 % 991).cast("double").alias("kx"), (F.col("n_nationkey") * 57 % 997).cast("double").alias("ky"))
    dist = geo.hypot(F.col("x") - F.col("kx"), F.col("y") - F.col("ky"))
    cell = lambda c: F.floor(F.col(c) / reach)
    around = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
    near = l.withColumns({"cx": cell("x"), "cy": cell("y")}).join(k.withColumn("cx", around("kx")).withColumn("cy", around("ky")), ["cx", "cy"])
    hits = near.filter(dist <= reach).groupBy("line", "colour").agg(F.count("*").alias("hits"))
    g = hits.join(k, "colour").join(l, "line").groupBy("line", "colour", "hits").agg(F.count("*").alias("n"), F.avg(dist).alias("d"))
    score = F.floor(F.col("hits") / F.col("n").cast("double") * (F.lit(0.4) + F.lit(0.6) * F.greatest(F.lit(0.0), 1 - F.col("d") / 300)) * 1e9 + 0.5)
    ok = g.withColumn("score", score).filter("score > 150000000 or hits >= 3")
    best = ok.groupBy("line").agg(F.min(F.struct((-F.col("score")).alias("s"), "colour")).alias("b"))
    return best.select("line", F.col("b.colour").alias("colour"), (-F.col("b.s")).alias("score"))


@query(
    "A23 P15 T05",
    """WITH p AS (SELECT p_brand, p_partkey, p_size * (p_partkey % 9) AS area, p_size * 9 AS box FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY area DESC, p_partkey) AS r FROM p WHERE area >= 1)
    SELECT p_brand, CAST(min(area) AS BIGINT) AS smallest, CAST(sum(box - area) AS BIGINT) AS waste, '| ' || p_brand || ' | ' || count(*) || ' | ' || string_agg(p_partkey::VARCHAR, ', ' ORDER BY r) FILTER (r <= 3) || ' |' AS line FROM k GROUP BY 1""",
)
def piece_report(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of each brand without vanished ones: the smallest, the waste, and a table line with the three largest."""
    area = F.col("p_size") * (F.col("p_partkey") % 9)
    p = table(spark, d, "part").select("p_brand", "p_partkey", area.alias("area"), (F.col("p_size") * 9 - area).alias("left")).filter("area >= 1")
    g = p.groupBy("p_brand").agg(F.min("area").alias("smallest"), F.sum("left").alias("waste"), F.count("*").alias("n"))
    three = graph.top(p, ["p_brand"], 3, F.col("area").desc(), "p_partkey", spread="p_partkey")
    three = three.groupBy("p_brand").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", "p_partkey"))), lambda x: x["p_partkey"].cast("string")), ", ").alias("three"))
    line = F.concat(F.lit("| "), "p_brand", F.lit(" | "), F.col("n").cast("string"), F.lit(" | "), "three", F.lit(" |"))
    return g.join(three, "p_brand").select("p_brand", F.col("smallest").cast("long"), "waste", line.alias("line"))


def stop_paths(spark: SparkSession, d: str) -> DataFrame:
    """A path for each pattern: stairs over its stops, so every side is level or upright."""
    s = stops(spark, d)
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    o, k = F.col("ord"), F.col("station") % 7 + 1
    rise = F.sum(F.when(o % 2 == 0, -k).otherwise(k)).over(Window.partitionBy("seq").orderBy("ord"))
    s = s.withColumn("up", rise).withColumn("before", F.coalesce(F.lag("up").over(Window.partitionBy("seq").orderBy("ord")), F.lit(0)))
    return s.select(F.col("seq").alias("path"), F.posexplode(F.array(at(o * 20, F.col("before")), at(o * 20, F.col("up")))).alias("k", "p"), "ord").select("path", (F.col("ord") * 2 + F.col("k")).alias("i"), "p.x", "p.y")


@query(
    "G20 F18",
    f"""WITH {STOPS}, u AS (SELECT seq, ord, CASE WHEN ord % 2 = 0 THEN -(station % 7 + 1) ELSE station % 7 + 1 END AS k, sum(CASE WHEN ord % 2 = 0 THEN -(station % 7 + 1) ELSE station % 7 + 1 END) OVER (PARTITION BY seq ORDER BY ord) AS up FROM stops),
    p AS (SELECT seq AS path, ord * 2 + b AS i, ord * 20 AS x, CASE WHEN b = 0 THEN up - k ELSE up END AS y, CASE WHEN k > 0 THEN 1 ELSE -1 END AS v, b, ord, count(*) OVER (PARTITION BY seq) // 2 AS n FROM u, (SELECT unnest([0, 1]) AS b)),
    s AS (SELECT *, b = 0 AND ord = 1 AS first, b = 1 AND ord = n AS last FROM p)
    SELECT path, CAST(i - 2 AS BIGINT) AS i, x - 1.5 * v::DOUBLE AS x, y + CASE WHEN first OR last THEN 0 ELSE 1.5 END::DOUBLE AS y FROM s""",
)
def offset_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths one and a half to the left of the stairs."""
    return paths.offset(stop_paths(spark, d), F.lit(1.5))


@query("W21 G20")
def bed_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The stairs with round corners, in pieces that fit a bed of 60 by 40."""
    p = paths.fillet(stop_paths(spark, d), 2.0)
    marks = stops(spark, d).select(F.col("seq").alias("path"), (F.col("ord") * 23.0).alias("s"))
    return paths.split_for_bed(p, marks, 2.5, 60.0, 40.0, 18 * table(spark, d, "lineitem").count())  # two corners of nine points for each stop
