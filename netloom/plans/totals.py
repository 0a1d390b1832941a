"""Joins of routes, stops and stations, and totals of layers, schedules, assembly, labels and checks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import sequence
from ..registry import query
from .tables import STATION, STOPS, lat, lon, stops, table

# Minutes to put up a part of each kind, of any other kind, and what looking for pieces adds.
ASSEMBLY_MIN = {"tile": 2.5, "line": 1.5, "dot": 0.25, "ring": 0.5, "plug": 0.35, "labelPlate": 0.8, "labelText": 0.0, "tape": 0.5, "tapeText": 0.0}
OTHER_MIN, BREAKS = 0.5, 1.15
# Filament in mm, its density in g/cm3 and its price a gram; seconds between two plates; the tape's share that text takes, its least size, and the text size that is still printed.
FILAMENT_MM, DENSITY, PRICE, CHANGEOVER_S = 1.75, 1.24, 0.022, 300
TAPE_SHARE, TAPE_LEAST, PRINTED = 0.55, 3.0, 3.6
AREA = math.pi * FILAMENT_MM * FILAMENT_MM / 4


@query(
    "J01",
    "SELECT o_orderkey AS route, coalesce(master, -1) AS master FROM orders LEFT JOIN (SELECT l_orderkey, arg_max(l_suppkey, {'n': l_linenumber, 's': l_suppkey, 'p': l_partkey}) AS master FROM lineitem WHERE l_quantity > 25 GROUP BY 1) ON l_orderkey = o_orderkey",
)
def route_masters(spark: SparkSession, d: str) -> DataFrame:
    """The master of each route: of several that name it the last one counts, and routes without one stay."""
    named = table(spark, d, "lineitem").filter("l_quantity > 25").groupBy("l_orderkey").agg(F.max_by("l_suppkey", F.struct("l_linenumber", "l_suppkey", "l_partkey")).alias("master"))
    o = table(spark, d, "orders").select("o_orderkey")
    return o.join(named, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(F.col("o_orderkey").alias("route"), F.coalesce("master", F.lit(-1)).alias("master"))


@query(
    "J02 J03 W01",
    f"""WITH {STOPS}, n AS (SELECT seq, ord, p_partkey - p_partkey % 4 AS cluster FROM stops JOIN part ON p_partkey = station WHERE p_size > 5),
    c AS (SELECT DISTINCT p_partkey - p_partkey % 4 AS cluster, (p_partkey - p_partkey % 4) * 10 AS station FROM part WHERE p_partkey % 4 = 0 AND p_partkey % 12 <> 8),
    j AS (SELECT seq, ord, station, lag(station) OVER (PARTITION BY seq ORDER BY ord) AS before FROM n JOIN c USING (cluster))
    SELECT seq, CAST(ord AS INT) AS ord, station FROM j WHERE before IS NULL OR before <> station""",
)
def stop_stations(spark: SparkSession, d: str) -> DataFrame:
    """Stops by way of their nodes and clusters to stations; what is missing on the way is passed over, and order is kept."""
    p = table(spark, d, "part")
    nodes = p.filter("p_size > 5").select("p_partkey", (F.col("p_partkey") - F.col("p_partkey") % 4).alias("cluster"))
    clusters = p.filter("p_partkey % 4 = 0 and p_partkey % 12 <> 8").select(F.col("p_partkey").alias("cluster"), (F.col("p_partkey") * 10).alias("place"))
    s = stops(spark, d)
    found = s.join(nodes, s["station"] == nodes["p_partkey"]).join(clusters, "cluster").select("seq", F.col("ord").cast("int").alias("ord"), F.col("place").alias("station"))
    return sequence.drop_consecutive_duplicates(found, ["seq"], "ord", "station")


KINDS = [*ASSEMBLY_MIN, "clip"]
KIND = f"([{', '.join(repr(k) for k in KINDS)}])[(p_partkey % {len(KINDS)} + 1)::INT]"


@query(
    "A06",
    f"""WITH w AS (SELECT unnest([{', '.join(repr(k) for k in ASSEMBLY_MIN)}]) AS kind, unnest([{', '.join(str(round(v * 100)) for v in ASSEMBLY_MIN.values())}]) AS cents),
    p AS (SELECT p_brand, {KIND} AS kind FROM part)
    SELECT p_brand AS city, count(*) AS parts, floor(sum(coalesce(cents, {round(OTHER_MIN * 100)})) * {BREAKS}::DOUBLE / 100 / 6 + 0.5) / 10 AS hours FROM p LEFT JOIN w USING (kind) GROUP BY 1""",
)
def assembly_hours(spark: SparkSession, d: str) -> DataFrame:
    """Hours to put up the parts of each build, by minutes of each kind (summed in hundredths, so in any order)."""
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("p_partkey") % len(KINDS) + 1).cast("int"))
    w = spark.createDataFrame([(k, round(v * 100)) for k, v in ASSEMBLY_MIN.items()], "kind string, cents long")
    p = table(spark, d, "part").select(F.col("p_brand").alias("city"), kind.alias("kind")).join(F.broadcast(w), "kind", "left")
    total = F.sum(F.coalesce("cents", F.lit(round(OTHER_MIN * 100)))) * F.lit(BREAKS) / 100
    return p.groupBy("city").agg(F.count("*").alias("parts"), (F.floor(total / 6 + 0.5) / F.lit(10.0)).alias("hours"))


@query(
    "A20 F36",
    f"""WITH t AS (SELECT l_orderkey AS plate, count(DISTINCT l_linenumber) AS layers, CAST(sum(CAST(floor(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS centis, CAST(sum(CAST(floor(l_quantity) AS BIGINT)) AS BIGINT) AS mm FROM lineitem GROUP BY 1)
    SELECT *, CAST(floor(mm * {AREA}::DOUBLE / 1000 * {DENSITY}::DOUBLE * 1000 + 0.5) AS BIGINT) AS milligrams, CAST(floor(mm * {AREA}::DOUBLE / 1000 * {DENSITY}::DOUBLE * {PRICE}::DOUBLE * 100000 + 0.5) AS BIGINT) AS price FROM t""",
)
def layer_totals(spark: SparkSession, d: str) -> DataFrame:
    """Layers, time and filament of each plate, with its mass and price (in thousandths of a cent)."""
    t = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("plate")).agg(F.countDistinct("l_linenumber").alias("layers"), F.sum(F.floor(F.col("l_extendedprice") * 100)).alias("centis"), F.sum(F.floor("l_quantity")).alias("mm"))
    grams = F.col("mm") * F.lit(AREA) / 1000 * F.lit(DENSITY)
    return t.select("*", F.floor(grams * 1000 + 0.5).alias("milligrams"), F.floor(grams * F.lit(PRICE) * 100000 + 0.5).alias("price"))


@query(
    "A21",
    f"""WITH j AS (SELECT o_custkey AS farm, o_orderkey % 3 AS printer, o_orderkey AS job, CAST(floor(o_totalprice) AS BIGINT) AS sec FROM orders),
    s AS (SELECT *, sum(sec + {CHANGEOVER_S}) OVER (PARTITION BY farm, printer ORDER BY job) - {CHANGEOVER_S} AS ends FROM j), p AS (SELECT farm, printer, max(ends) AS busy, sum(sec) AS printing FROM s GROUP BY 1, 2)
    SELECT farm, CAST(max(busy) AS BIGINT) AS makespan, CAST(sum(printing) AS BIGINT) AS printing, count(*) AS printers, CAST(min(busy) AS BIGINT) AS least_busy FROM p GROUP BY 1""",
)
def schedule_totals(spark: SparkSession, d: str) -> DataFrame:
    """Makespan and printing time of each farm; a printer is busy until its last job ends, changes of plates included."""
    j = table(spark, d, "orders").select(F.col("o_custkey").alias("farm"), (F.col("o_orderkey") % 3).alias("printer"), F.col("o_orderkey").alias("job"), F.floor("o_totalprice").alias("sec"))
    ends = F.sum(F.col("sec") + CHANGEOVER_S).over(Window.partitionBy("farm", "printer").orderBy("job")) - CHANGEOVER_S
    p = j.withColumn("ends", ends).groupBy("farm", "printer").agg(F.max("ends").alias("busy"), F.sum("sec").alias("printing"))
    return p.groupBy("farm").agg(F.max("busy").alias("makespan"), F.sum("printing").alias("printing"), F.count("*").alias("printers"), F.min("busy").alias("least_busy"))


@query(
    "F16",
    f"""WITH s AS (SELECT {STATION}, p_brand AS net FROM part), m AS (SELECT net, avg(lat) AS lat0, avg(lon) AS lon0 FROM s GROUP BY 1)
    SELECT station, net, CAST(floor((lon - lon0) * 111320 * cos(radians(lat0)) * 10 + 0.5) AS BIGINT) AS x, CAST(floor((lat - lat0) * 110574 * 10 + 0.5) AS BIGINT) AS y FROM s JOIN m USING (net)""",
)
def projected_stations(spark: SparkSession, d: str) -> DataFrame:
    """Stations on the plane that touches their network's middle, in tenths of metres; middles are aggregated and joined back."""
    s = table(spark, d, "part").select(F.col("p_partkey").alias("station"), F.col("p_brand").alias("net"), lat(F.col("p_partkey")).alias("lat"), lon(F.col("p_partkey")).alias("lon"))
    m = s.groupBy("net").agg(F.avg("lat").alias("lat0"), F.avg("lon").alias("lon0"))
    x, y = (F.col("lon") - F.col("lon0")) * 111320 * F.cos(F.radians("lat0")), (F.col("lat") - F.col("lat0")) * 110574
    return s.join(m, "net").select("station", "net", F.floor(x * 10 + 0.5).alias("x"), F.floor(y * 10 + 0.5).alias("y"))


@query(
    "F45",
    """WITH p AS (SELECT p_partkey, p_partkey % 4 AS turns, unnest([[0, 0, 0], [p_size, 0, 1], [p_size, 7, 2]]) AS c, generate_subscripts([1, 2, 3], 1) - 1 AS i FROM part)
    SELECT p_partkey, i::INT AS i, (CASE turns WHEN 0 THEN c[1] WHEN 1 THEN -c[2] WHEN 2 THEN -c[1] ELSE c[2] END + p_partkey % 180)::BIGINT AS x, (CASE turns WHEN 0 THEN c[2] WHEN 1 THEN c[1] WHEN 2 THEN -c[2] ELSE -c[1] END + p_partkey % 170)::BIGINT AS y, (c[3] + 3)::BIGINT AS z FROM p""",
)
def placed_corners(spark: SparkSession, d: str) -> DataFrame:
    """Corners of parts turned by quarters, moved onto their plate and lifted."""
    k = F.col("p_partkey")
    corners = F.array(*[F.struct(F.lit(x).cast("double").alias("x") if not isinstance(x, str) else F.col(x).cast("double").alias("x"), F.lit(float(y)).alias("y"), F.lit(float(z)).alias("z")) for x, y, z in ((0, 0, 0), ("p_size", 0, 1), ("p_size", 7, 2))])
    c, s = F.round(F.cos(F.radians(k % 4 * 90.0))), F.round(F.sin(F.radians(k % 4 * 90.0)))
    p = table(spark, d, "part").select("p_partkey", c.alias("c"), s.alias("s"), F.posexplode(corners).alias("i", "p"))
    x, y = F.col("c") * F.col("p.x") - F.col("s") * F.col("p.y") + k % 180, F.col("s") * F.col("p.x") + F.col("c") * F.col("p.y") + k % 170
    return p.select("p_partkey", "i", x.cast("long").alias("x"), y.cast("long").alias("y"), (F.col("p.z") + 3).cast("long").alias("z"))


@query(
    "F43",
    f"""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN false WHEN p_size % 5 = 1 THEN true WHEN p_size % 5 = 2 THEN false ELSE p_size / 10.0::DOUBLE < {PRINTED} END AS tape, greatest({TAPE_LEAST}, (p_size % 13) * {TAPE_SHARE}::DOUBLE) AS font, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 = 0 THEN p_type ELSE p_name END AS label FROM part""",
)
def tape_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Whether labels go on tape (none: no; by mode; else if the text is too small to print), the text size on it, and the name in the wanted language if there is one."""
    z, k = F.col("p_size"), F.col("p_partkey")
    tape = F.when(z % 5 == 0, False).when(z % 5 == 1, True).when(z % 5 == 2, False).otherwise(z / 10.0 < PRINTED)
    other = F.when(k % 3 == 0, F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", tape.alias("tape"), F.greatest(F.lit(TAPE_LEAST), z % 13 * F.lit(TAPE_SHARE)).alias("font"), F.coalesce(F.when(k % 2 == 0, other), "p_name").alias("label"))


@query(
    "V09",
    "SELECT p_brand AS city, CASE WHEN p_size % 7 = 0 THEN 'none' ELSE p_size % 5 || ' mm ' || (p_partkey % 3) * 45 || ' deg' END AS class, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1, 2",
)
def label_audit(spark: SparkSession, d: str) -> DataFrame:
    """Labels of each build by size and angle, and stations without one."""
    c = F.when(F.col("p_size") % 7 == 0, "none").otherwise(F.concat((F.col("p_size") % 5).cast("string"), F.lit(" mm "), (F.col("p_partkey") % 3 * 45).cast("string"), F.lit(" deg")))
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("city"), c.alias("class")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


@query("V10", "SELECT l_suppkey % 23 AS colour, CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS length, CAST(max(l_quantity) AS DOUBLE) AS widest, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY length DESC, colour LIMIT 14")
def extract_audit(spark: SparkSession, d: str) -> DataFrame:
    """The fourteen colours with the longest strokes."""
    g = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 23).alias("colour")).agg(F.sum(F.floor("l_extendedprice")).alias("length"), F.max(F.col("l_quantity").cast("double")).alias("widest"), F.count("*").alias("n"))
    return g.orderBy(F.col("length").desc(), "colour").limit(14)


@query(
    "K11 V02",
    """WITH c AS (SELECT l_orderkey, count(*) FILTER (l_quantity > 45) AS errors, count(*) FILTER (l_quantity < 3) AS warnings, CAST(max(l_quantity) - min(l_quantity) AS BIGINT) AS wide FROM lineitem GROUP BY 1)
    SELECT l_orderkey AS file, '| ' || l_orderkey || ' | ' || CASE WHEN errors = 0 THEN '✅ pass' ELSE '❌ **REJECTED**' END || CASE WHEN warnings > 0 THEN ' (' || warnings || ' warning' || CASE WHEN warnings > 1 THEN 's' ELSE '' END || ')' ELSE '' END || ' | ' || wide || ' |' AS line FROM c""",
)
def check_report(spark: SparkSession, d: str) -> DataFrame:
    """A line of the check report for each file: verdict, warnings and extent."""
    q = F.col("l_quantity")
    c = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("file")).agg(F.count_if(q > 45).alias("errors"), F.count_if(q < 3).alias("warnings"), (F.max(q) - F.min(q)).cast("long").alias("wide"))
    verdict = F.when(F.col("errors") == 0, "✅ pass").otherwise("❌ **REJECTED**")
    warned = F.when(F.col("warnings") > 0, F.concat(F.lit(" ("), F.col("warnings").cast("string"), F.lit(" warning"), F.when(F.col("warnings") > 1, "s").otherwise(""), F.lit(")"))).otherwise("")
    return c.select("file", F.concat(F.lit("| "), F.col("file").cast("string"), F.lit(" | "), verdict, warned, F.lit(" | "), F.col("wide").cast("string"), F.lit(" |")).alias("line"))
