"""Meshes, layers, labels in the plane, farms and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import fold
from ..operators.shared import dealt
from ..registry import query
from .tables import table

TRI = "tri AS (SELECT l_orderkey AS mesh, l_linenumber AS id, (l_partkey % 31)::DOUBLE AS ax, (l_partkey % 29)::DOUBLE AS ay, (l_partkey % 23)::DOUBLE AS az, (l_suppkey % 19)::DOUBLE AS bx, (l_suppkey % 17)::DOUBLE AS by_, (l_suppkey % 13)::DOUBLE AS bz, (l_quantity % 11)::DOUBLE AS cx, (l_linenumber % 7)::DOUBLE AS cy, (l_orderkey % 37)::DOUBLE AS cz FROM lineitem)"


def _triangles(spark: SparkSession, d: str) -> DataFrame:
    of = {"ax": ("l_partkey", 31), "ay": ("l_partkey", 29), "az": ("l_partkey", 23), "bx": ("l_suppkey", 19), "by": ("l_suppkey", 17), "bz": ("l_suppkey", 13), "cx": ("l_quantity", 11), "cy": ("l_linenumber", 7), "cz": ("l_orderkey", 37)}
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("mesh"), F.col("l_linenumber").alias("id"), *[(F.col(c) % n).cast("double").alias(k) for k, (c, n) in of.items()])


@query(
    "A26",
    f"""WITH {TRI} SELECT mesh, CAST(sum(CAST(floor((ax * (by_ * cz - bz * cy) + ay * (bz * cx - bx * cz) + az * (bx * cy - by_ * cx)) + 0.5) AS BIGINT)) AS BIGINT) AS six_volumes,
    CAST(sum(CAST(floor((pow((by_ - ay) * (cz - az) - (bz - az) * (cy - ay), 2) + pow((bz - az) * (cx - ax) - (bx - ax) * (cz - az), 2) + pow((bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax), 2)) + 0.5) AS BIGINT)) AS BIGINT) AS squared_areas FROM tri GROUP BY 1""",
)
def mesh_volume(spark: SparkSession, d: str) -> DataFrame:
    """Six times the volume of each mesh by signed tetrahedra, and the sum of squares of its triangles' doubled areas."""
    c = F.col
    det = c("ax") * (c("by") * c("cz") - c("bz") * c("cy")) + c("ay") * (c("bz") * c("cx") - c("bx") * c("cz")) + c("az") * (c("bx") * c("cy") - c("by") * c("cx"))
    ux, uy, uz, vx, vy, vz = (c(a) - c(b) for a, b in (("bx", "ax"), ("by", "ay"), ("bz", "az"), ("cx", "ax"), ("cy", "ay"), ("cz", "az")))
    area = F.pow(uy * vz - uz * vy, 2) + F.pow(uz * vx - ux * vz, 2) + F.pow(ux * vy - uy * vx, 2)
    return _triangles(spark, d).groupBy("mesh").agg(F.sum(F.floor(det + 0.5)).alias("six_volumes"), F.sum(F.floor(area + 0.5)).alias("squared_areas"))


@query(
    "J27",
    f"""WITH {TRI}, z AS (SELECT mesh, id, least(az, bz, cz) AS lo, greatest(az, bz, cz) AS hi FROM tri), layer AS (SELECT i::BIGINT AS layer, (i + 0.5) * 2 AS z FROM (SELECT unnest(range(0, 20)) AS i))
    SELECT mesh, layer, count(*) AS n FROM z JOIN layer ON lo < z AND z < hi GROUP BY 1, 2""",
)
def layer_triangles(spark: SparkSession, d: str) -> DataFrame:
    """How many triangles of a mesh each layer cuts. Layers are regular, so a triangle lists those between its ends: no join over intervals."""
    t = _triangles(spark, d).select("mesh", F.least("az", "bz", "cz").alias("lo"), F.greatest("az", "bz", "cz").alias("hi"))
    first, last = F.floor(F.col("lo") / 2 - 0.5) + 1, F.ceil(F.col("hi") / 2 - 0.5) - 1
    return t.filter(first <= last).select("mesh", F.explode(F.sequence(first, last)).alias("layer")).groupBy("mesh", "layer").agg(F.count("*").alias("n"))


@query(
    "J28",
    f"""WITH {TRI}, e AS (SELECT mesh, ay AS y0, by_ AS y1 FROM tri UNION ALL SELECT mesh, by_, cy FROM tri UNION ALL SELECT mesh, cy, ay FROM tri), s AS (SELECT (i + 0.25)::DOUBLE AS y, i::BIGINT AS scan FROM (SELECT unnest(range(0, 31)) AS i))
    SELECT mesh, scan, count(*) AS n FROM e JOIN s ON least(y0, y1) <= y AND y < greatest(y0, y1) GROUP BY 1, 2""",
)
def scan_crossings(spark: SparkSession, d: str) -> DataFrame:
    """Edges that each scan line meets, the lower end in, the upper out: edges are dealt to the buckets of the scan lines that
    they span. A mesh is at one place before that, so no edge is shuffled for each of its lines."""
    t = _triangles(spark, d).select("mesh", "ay", "by", "cy")
    e = dealt(t, ["mesh"], t.count(), always=True).select("mesh", F.explode(F.array(*[F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")) for a, b in (("ay", "by"), ("by", "cy"), ("cy", "ay"))])).alias("e")).select("mesh", "e.lo", "e.hi")
    first, last = F.ceil(F.col("lo") - 0.25), F.ceil(F.col("hi") - 0.25) - 1
    return e.filter(first <= last).select("mesh", F.explode(F.sequence(first, last)).alias("scan")).groupBy("mesh", "scan").agg(F.count("*").alias("n"))


EV = "ev AS (SELECT user_id AS k, event_id AS i, event_type AS t, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord FROM events)"


@query(
    "W15 W16",
    f"""WITH {EV}, s AS (SELECT k, i, ord, v, sum(floor(abs(v)) + 1) OVER (PARTITION BY k ORDER BY ord) AS done, sum(floor(abs(v)) + 1) OVER (PARTITION BY k) AS whole FROM ev)
    SELECT k, i, least(99, floor(done * 100 / whole))::BIGINT AS percent, floor((whole - done) / 60 + 0.5)::BIGINT AS minutes, (ord = min(CASE WHEN v > 60 THEN ord END) OVER (PARTITION BY k)) IS TRUE AS change FROM s""",
)
def progress_marks(spark: SparkSession, d: str) -> DataFrame:
    """Percent done (99 at most) and minutes left after each step of a job, and the first step above the height of the colour change."""
    e = table(spark, d, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("i"), F.col("value").alias("v"), "ts")
    w, whole = Window.partitionBy("k").orderBy("ts", "i"), Window.partitionBy("k")
    sec = (F.floor(F.abs("v")) + 1).cast("long")
    e = e.withColumns({"ord": F.row_number().over(w), "done": F.sum(sec).over(w.rowsBetween(Window.unboundedPreceding, 0)), "whole": F.sum(sec).over(whole)})
    first = F.min(F.when(F.col("v") > 60, F.col("ord"))).over(whole)
    return e.select("k", "i", F.least(F.lit(99).cast("long"), F.floor(F.col("done") * 100 / F.col("whole"))).alias("percent"), F.floor((F.col("whole") - F.col("done")) / 60 + 0.5).alias("minutes"), F.coalesce(F.col("ord") == first, F.lit(False)).alias("change"))


@query("K05")
def what_if_farms(spark: SparkSession, d: str) -> DataFrame:
    """The same jobs on four pools of one to four machines: each customer's jobs are scheduled on each pool."""
    pools = spark.range(1, 5).select(F.col("id").alias("pool"))
    jobs = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("job"), F.col("o_totalprice").alias("seconds"), F.lit(None).cast("string").alias("kind"))
    jobs = jobs.join(F.broadcast(pools)).withColumn("farm", F.col("o_custkey") * 10 + F.col("pool"))
    spec = spark.range(0, 4).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("machine"), F.lit("m").alias("kind"), F.lit(1.0).alias("factor"), F.col("id").cast("int").alias("ord"))
    farms = table(spark, d, "customer").select("c_custkey").join(F.broadcast(pools)).join(F.broadcast(spec), F.col("ord") < F.col("pool")).select((F.col("c_custkey") * 10 + F.col("pool")).alias("farm"), "machine", "kind", "factor", "ord")
    ends = fold.schedule(jobs.select("farm", "job", "seconds", "kind"), farms, "farm").groupBy("farm").agg(F.max("end_s").alias("makespan"), F.count("*").alias("jobs"))
    return ends.select(F.floor(F.col("farm") / 10).alias("c_custkey"), (F.col("farm") % 10).alias("pool"), "makespan", "jobs")


@query(
    "A07 A08 O09 V02",
    """WITH m AS (SELECT c_mktsegment AS city, o_orderpriority AS width, count(*) AS plates, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS grams FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
    SELECT city, width, '| ' || city || ' | ' || width || ' | ' || plates || ' | ' || CAST(floor(grams * 22 / 1000.0 + 0.5) AS BIGINT) || ' |' AS line FROM m""",
)
def matrix_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a Markdown table: plates and cost, at 0.022 a gram, by city and width."""
    o, c = table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_totalprice"), table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    m = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy(F.col("c_mktsegment").alias("city"), F.col("o_orderpriority").alias("width")).agg(F.count("*").alias("plates"), F.sum(F.floor("o_totalprice")).alias("grams"))
    cost = F.floor(F.col("grams") * 22 / F.lit(1000.0) + 0.5)
    return m.select("city", "width", F.concat(F.lit("| "), F.concat_ws(" | ", "city", "width", F.col("plates").cast("string"), cost.cast("string")), F.lit(" |")).alias("line")).orderBy("city", "width")


@query(
    "F23",
    """WITH p AS (SELECT p_partkey, (p_partkey * 7 % 360)::DOUBLE AS a FROM part)
    SELECT p_partkey, CASE WHEN abs(a - 90 * floor(a / 90 + 0.5)) <= 30 THEN 90 * floor(a / 90 + 0.5) ELSE 45 + 90 * floor(a / 90) END::BIGINT % 360 AS snapped, (15 * floor(a / 15 + 0.5))::BIGINT AS step FROM p""",
)
def snapped_angles(spark: SparkSession, d: str) -> DataFrame:
    """Angles at an axis if it is within 30 degrees, else at the diagonal; and at steps of 15, halves up."""
    a = (F.col("p_partkey") * 7 % 360).cast("double")
    axis = 90 * F.floor(a / 90 + 0.5)
    return table(spark, d, "part").select("p_partkey", (F.when(F.abs(a - axis) <= 30, axis).otherwise(45 + 90 * F.floor(a / 90)) % 360).alias("snapped"), (15 * F.floor(a / 15 + 0.5)).alias("step"))


@query(
    "G28",
    """WITH p AS (SELECT p_partkey, 100 + p_partkey % 900 AS w, 100 + p_partkey * 7 % 700 AS h FROM part), t AS (SELECT p_partkey, ceil(w / 180.0::DOUBLE)::BIGINT AS c1, ceil(h / 160.0::DOUBLE)::BIGINT AS r1, ceil(w / 160.0::DOUBLE)::BIGINT AS c2, ceil(h / 180.0::DOUBLE)::BIGINT AS r2 FROM p)
    SELECT p_partkey, CASE WHEN c2 * r2 < c1 * r1 THEN c2 ELSE c1 END AS cols, CASE WHEN c2 * r2 < c1 * r1 THEN r2 ELSE r1 END AS rows FROM t""",
)
def tile_grids(spark: SparkSession, d: str) -> DataFrame:
    """Columns and rows of tiles over a drawing, along or across: what needs fewer."""
    k = F.col("p_partkey")
    w, h = 100 + k % 900, 100 + k * 7 % 700
    up = lambda a, n: F.ceil(a / F.lit(n))
    c1, r1, c2, r2 = up(w, 180.0), up(h, 160.0), up(w, 160.0), up(h, 180.0)
    turned = c2 * r2 < c1 * r1
    return table(spark, d, "part").select("p_partkey", F.when(turned, c2).otherwise(c1).alias("cols"), F.when(turned, r2).otherwise(r1).alias("rows"))


@query(
    "K12 K16 T09",
    """WITH v AS (SELECT o_custkey AS plate, (o_orderkey * 7919 % 211)::DOUBLE AS x, (o_orderkey * 104729 % 223)::DOUBLE AS y, o_custkey % 2 = 1 AS turned FROM orders),
    b AS (SELECT plate, max(CASE WHEN turned THEN y ELSE x END) - min(CASE WHEN turned THEN y ELSE x END) AS w, max(CASE WHEN turned THEN x ELSE y END) - min(CASE WHEN turned THEN x ELSE y END) AS h FROM v GROUP BY 1)
    SELECT plate, w, h, CASE WHEN w <= 120.5 AND h <= 120.5 THEN 'mini' WHEN w <= 180.5 AND h <= 180.5 THEN 'small' WHEN w <= 256.5 AND h <= 256.5 THEN 'large' END AS bed FROM b""",
)
def plate_beds(spark: SparkSession, d: str) -> DataFrame:
    """The extent of each plate's corners, turned where the plate is, and the smallest bed, by area, that holds it within half a millimetre."""
    k = F.col("o_orderkey")
    x, y, turned = (k * 7919 % 211).cast("double"), (k * 104729 % 223).cast("double"), F.col("o_custkey") % 2 == 1
    v = table(spark, d, "orders").select(F.col("o_custkey").alias("plate"), F.when(turned, y).otherwise(x).alias("x"), F.when(turned, x).otherwise(y).alias("y"))
    b = v.groupBy("plate").agg((F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"))
    beds = F.array(*[F.struct(F.lit(n * n).alias("area"), F.lit(n).alias("n"), F.lit(name).alias("bed")) for name, n in (("large", 256.0), ("small", 180.0), ("mini", 120.0))])
    fits = F.array_min(F.filter(beds, lambda p: (F.col("w") <= p["n"] + 0.5) & (F.col("h") <= p["n"] + 0.5)))
    return b.select("plate", "w", "h", fits["bed"].alias("bed"))


@query(
    "F30 F44",
    """WITH p AS (SELECT p_partkey, (p_partkey % 50)::DOUBLE AS x, (p_partkey * 7 % 50)::DOUBLE AS y FROM part), c AS (SELECT p_partkey, x, y, unnest([[-6, -2], [6, -2], [6, 2], [-6, 2]]) AS o FROM p),
    r AS (SELECT p_partkey, x + o[1] * 0.8::DOUBLE - o[2] * 0.6::DOUBLE AS cx, y + o[1] * 0.6::DOUBLE + o[2] * 0.8::DOUBLE AS cy FROM c)
    SELECT p_partkey, max(cx) >= 20 - 1e-9 AND min(cx) <= 30 + 1e-9 AND max(cy) >= 20 - 1e-9 AND min(cy) <= 30 + 1e-9 AND max(cx * 0.8::DOUBLE + cy * 0.6::DOUBLE) >= 28 - 1e-9 AND min(cx * 0.8::DOUBLE + cy * 0.6::DOUBLE) <= 42 + 1e-9
      AND max(cy * 0.8::DOUBLE - cx * 0.6::DOUBLE) >= -2 - 1e-9 AND min(cy * 0.8::DOUBLE - cx * 0.6::DOUBLE) <= 12 + 1e-9 AS touches FROM r GROUP BY 1""",
)
def turned_labels(spark: SparkSession, d: str) -> DataFrame:
    """Whether turned label boxes touch a square, by separating axes."""
    k = F.col("p_partkey")
    box = geo.turned_box((k % 50).cast("double"), (k * 7 % 50).cast("double"), F.lit(6.0), F.lit(2.0), F.lit(0.8), F.lit(0.6))
    square = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((20, 20), (30, 20), (30, 30), (20, 30))])
    return table(spark, d, "part").select("p_partkey", geo.convex_touch(box, square).alias("touches"))


@query(
    "V03 P14",
    """WITH s AS (SELECT c_nationkey AS net, count(*) AS n, count(*) FILTER (c_acctbal < 0) AS gone FROM customer GROUP BY 1)
    SELECT n_nationkey::BIGINT AS net, coalesce(n - gone, 0) AS kept, CASE WHEN n_nationkey % 6 = 0 THEN 'error: no facts for ' || n_name WHEN coalesce(gone, 0) > 0 THEN 'warning: ' || gone || ' parts vanished' END AS message FROM nation LEFT JOIN s ON net = n_nationkey""",
)
def network_messages(spark: SparkSession, d: str) -> DataFrame:
    """Each network with what is left of it, and an error or a warning about vanished parts as a row, not as an end of the run."""
    s = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("net")).agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("gone"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("net"), "n_name").join(s, "net", "left")
    lost = F.when(F.coalesce("gone", F.lit(0)) > 0, F.concat(F.lit("warning: "), F.col("gone").cast("string"), F.lit(" parts vanished")))
    return n.select(F.col("net").cast("long"), F.coalesce(F.col("n") - F.col("gone"), F.lit(0)).alias("kept"), F.when(F.col("net") % 6 == 0, F.concat(F.lit("error: no facts for "), "n_name")).otherwise(lost).alias("message"))
