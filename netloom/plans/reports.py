"""Roll-ups, lookups and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.text import FALLBACK_COLOURS
from ..operators import graph, sequence
from ..registry import query
from .tables import table


@query(
    "A14 A16",
    """SELECT o_custkey, min(o_totalprice) AS minx, max(o_totalprice) AS maxx, min(o_orderkey) AS miny, max(o_orderkey) AS maxy, CAST(floor(avg(o_orderkey) * 100 + 0.5) AS BIGINT) AS cy, (max(o_totalprice) - min(o_totalprice) > 100000) AS outsize FROM orders GROUP BY 1""",
)
def bounding_boxes(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy("o_custkey")
    b = o.agg(F.min("o_totalprice").alias("minx"), F.max("o_totalprice").alias("maxx"), F.min("o_orderkey").alias("miny"), F.max("o_orderkey").alias("maxy"), F.floor(F.avg("o_orderkey") * 100 + 0.5).alias("cy"))
    return b.withColumn("outsize", F.col("maxx") - F.col("minx") > 100000)


@query(
    "A18 A17",
    """SELECT c_nationkey::BIGINT AS line, count(DISTINCT c_custkey) AS n, string_agg(DISTINCT c_mktsegment, '|' ORDER BY c_mktsegment) AS segments FROM customer c
    WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%') AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey) GROUP BY 1""",
)
def guarded_counts(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), table(spark, d, "orders")
    for bad in (o.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), o.filter(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias("c_custkey")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"))):
        c = c.join(bad, "c_custkey", "left_anti")
    return c.groupBy(F.col("c_nationkey").cast("long").alias("line")).agg(F.countDistinct("c_custkey").alias("n"), F.array_join(F.array_sort(F.collect_set("c_mktsegment")), "|").alias("segments"))


@query(
    "A22 P11 P12",
    """SELECT p_brand AS colour, CAST(sum(p_size) AS BIGINT) AS length, max(p_retailprice) AS width, count(*) AS n, CAST(coalesce(sum(p_size) FILTER (p_retailprice > 1200 AND p_size > 10), 0) AS BIGINT) AS route_like FROM part GROUP BY 1 HAVING sum(p_size) > 50""",
)
def stroke_statistics(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "part").groupBy(F.col("p_brand").alias("colour"))
    long_ = F.coalesce(F.sum(F.when((F.col("p_retailprice") > 1200) & (F.col("p_size") > 10), F.col("p_size"))), F.lit(0))
    return g.agg(F.sum("p_size").alias("length"), F.max("p_retailprice").alias("width"), F.count("*").alias("n"), long_.alias("route_like")).filter("length > 50")


@query(
    "A25 T10",
    """WITH m AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WHERE o_orderstatus <> 'F')
    SELECT o_custkey, max(n) AS missing, string_agg(o_orderkey::VARCHAR, ', ' ORDER BY o_orderkey) FILTER (r <= 8) || CASE WHEN max(n) > 8 THEN ' (+' || (max(n) - 8) || ')' ELSE '' END AS sample FROM m GROUP BY 1""",
)
def missing_lists(spark: SparkSession, d: str) -> DataFrame:
    """Open orders of each customer, the first eight by name: the report's own bound."""
    m = table(spark, d, "orders").filter("o_orderstatus <> 'F'").select("o_custkey", "o_orderkey")
    n = m.groupBy("o_custkey").agg(F.count("*").alias("missing"))
    g = graph.top(m, ["o_custkey"], 8, "o_orderkey", spread="o_orderkey").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("l")).join(n, "o_custkey")
    more = F.when(F.col("missing") > 8, F.concat(F.lit(" (+"), (F.col("missing") - 8).cast("string"), F.lit(")"))).otherwise("")
    return g.select("o_custkey", "missing", F.concat(F.array_join("l", ", "), more).alias("sample"))


@query(
    "J17",
    """SELECT l_orderkey, l_linenumber::INT AS l_linenumber, l_partkey, l_suppkey, coalesce(s.s_name, p.p_name, '?') AS plate FROM lineitem LEFT JOIN supplier s ON s.s_suppkey = l_partkey LEFT JOIN part p ON p.p_partkey = l_partkey AND p.p_size > 10""",
)
def coalesced_lookup(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_partkey"), "s_name")
    p = table(spark, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return li.join(s, "l_partkey", "left").join(p, "l_partkey", "left").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.coalesce("s_name", "p_name", F.lit("?")).alias("plate"))


@query("J18", "SELECT DISTINCT s_suppkey, p_partkey FROM supplier, part WHERE p_partkey = s_suppkey OR p_size * 40 = s_suppkey")
def either_key_join(spark: SparkSession, d: str) -> DataFrame:
    """A join on one key or another: two equi-joins, not a nested loop."""
    s, p = table(spark, d, "supplier").select("s_suppkey"), table(spark, d, "part").select("p_partkey", (F.col("p_size").cast("long") * 40).alias("grp"))
    a = s.join(p, s["s_suppkey"] == p["p_partkey"]).select("s_suppkey", "p_partkey")
    b = s.join(p, s["s_suppkey"] == p["grp"]).select("s_suppkey", "p_partkey")
    return a.unionByName(b).distinct()


@query(
    "U01",
    """WITH e AS (SELECT c_custkey, unnest([c_mktsegment, 'SEG ' || (c_custkey % 5)]) AS part, c_nationkey FROM customer), pin AS (SELECT n_nationkey, 'SEG ' || (n_nationkey % 7) AS entry FROM nation)
    SELECT DISTINCT c_custkey, entry FROM e JOIN pin ON entry = part AND n_nationkey = c_nationkey""",
)
def pinned_lookup(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "customer").select("c_custkey", F.explode(F.array("c_mktsegment", F.concat(F.lit("SEG "), (F.col("c_custkey") % 5).cast("string")))).alias("part"), "c_nationkey")
    pin = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("SEG "), (F.col("n_nationkey") % 7).cast("string")).alias("entry"))
    return e.join(pin, (F.col("entry") == F.col("part")) & (F.col("n_nationkey") == F.col("c_nationkey"))).select("c_custkey", "entry").distinct()


@query(
    "W05",
    f"""WITH l AS (SELECT c_nationkey, c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i FROM customer)
    SELECT c_nationkey, c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN '#111111' ELSE ([{", ".join(f"'{c}'" for c in FALLBACK_COLOURS)}])[(i % 16 + 1)::INT] END AS colour FROM l""",
)
def fallback_colours(spark: SparkSession, d: str) -> DataFrame:
    """Lines without a colour take the fallback ones in turn, by their number within their network."""
    c = sequence.numbered(table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_mktsegment"), ["c_nationkey"], "c_custkey", name="i").withColumn("i", F.col("i") - 1)
    turn = F.element_at(F.array(*[F.lit(x) for x in FALLBACK_COLOURS]), (F.col("i") % 16 + 1).cast("int"))
    return c.select("c_nationkey", "c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", "#111111").otherwise(turn).alias("colour"))


@query(
    "W12",
    """WITH e AS (SELECT user_id, event_id, value, lag(value) OVER w AS before FROM events WHERE event_type <> 'view' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, count(*) FILTER (abs(value - before) > 60) AS jumps, min(event_id) FILTER (value > 90) AS first_high FROM e GROUP BY 1""",
)
def jumps(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").filter("event_type <> 'view'").select("user_id", "event_id", "value", "ts")
    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.withColumn("before", before).groupBy("user_id").agg(F.count_if(F.abs(F.col("value") - F.col("before")) > 60).alias("jumps"), F.min(F.when(F.col("value") > 90, F.col("event_id"))).alias("first_high"))


@query(
    "V14 A05",
    """SELECT p_brand AS kind, (p_size // 10)::BIGINT AS bucket, count(*) AS n, count(*) FILTER (p_type LIKE '%STEEL%' OR p_size = 1) AS odd, CAST(sum(CAST(floor(p_retailprice * 100) AS BIGINT)) AS BIGINT) AS volume FROM part GROUP BY 1, 2""",
)
def histograms(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    odd = F.col("p_type").contains("STEEL") | (F.col("p_size") == 1)
    return p.groupBy(F.col("p_brand").alias("kind"), F.floor(F.col("p_size") / 10).alias("bucket")).agg(F.count("*").alias("n"), F.count_if(odd).alias("odd"), F.sum(F.floor(F.col("p_retailprice") * 100)).alias("volume"))


@query(
    "V11",
    """WITH a AS (SELECT c_custkey AS k, count(*) AS n_a FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n_b FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
    SELECT coalesce(a.k, b.k) AS k, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b, abs(coalesce(n_a, 0) - coalesce(n_b, 0)) <= 1 AS near FROM a FULL JOIN b ON a.k = b.k""",
)
def side_by_side(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    a = o.filter("o_orderstatus = 'F'").groupBy("k").agg(F.count("*").alias("n_a"))
    b = o.filter("o_orderstatus <> 'F'").groupBy("k").agg(F.count("*").alias("n_b"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return a.join(b, "k", "full").select("k", zero("n_a").alias("n_a"), zero("n_b").alias("n_b"), (F.abs(zero("n_a") - zero("n_b")) <= 1).alias("near"))


@query(
    "F26 G18",
    """WITH p AS (SELECT p_partkey, (p_partkey % 97)::DOUBLE AS ax, (p_partkey % 89)::DOUBLE AS ay, (p_partkey * 7 % 83)::DOUBLE AS bx, (p_partkey * 5 % 79)::DOUBLE AS by_ FROM part),
    q AS (SELECT *, bx - ax AS dx, by_ - ay AS dy, least(abs(bx - ax), abs(by_ - ay)) AS m FROM p)
    SELECT p_partkey, CASE WHEN abs(dx) < 1e-9 OR abs(dy) < 1e-9 OR abs(abs(dx) - abs(dy)) < 1e-9 THEN 2 ELSE 3 END::BIGINT AS n, CASE WHEN abs(dx) < 1e-9 OR abs(dy) < 1e-9 OR abs(abs(dx) - abs(dy)) < 1e-9 THEN NULL ELSE bx - sign(dx) * m END AS mx,
      CAST(floor(CASE WHEN p_partkey % 256 / 255.0::DOUBLE <= 0.04045 THEN (p_partkey % 256 / 255.0::DOUBLE) / 12.92 ELSE pow(((p_partkey % 256 / 255.0::DOUBLE) + 0.055) / 1.055, 2.4) END * 1000000 + 0.5) AS BIGINT) AS linear FROM q""",
)
def octilinear_paths(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, d, "part").select("p_partkey", (k % 97).cast("double").alias("ax"), (k % 89).cast("double").alias("ay"), (k * 7 % 83).cast("double").alias("bx"), (k * 5 % 79).cast("double").alias("by"))
    p = p.withColumn("path", geo.octilinear(*(F.col(c) for c in ("ax", "ay", "bx", "by"))))
    linear = F.floor(geo.srgb_to_linear(k % 256 / F.lit(255.0)) * 1000000 + 0.5)
    return p.select("p_partkey", F.size("path").cast("long").alias("n"), F.when(F.size("path") == 3, F.col("path")[1]["x"]).alias("mx"), linear.alias("linear"))


@query(
    "W20",
    """WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord FROM events), c AS (SELECT user_id, ord AS a, lead(ord) OVER (PARTITION BY user_id ORDER BY ord) AS b FROM e WHERE event_type IN ('purchase', 'signup'))
    SELECT c.user_id, a, b, count(e.event_id) AS inside FROM c LEFT JOIN e ON e.user_id = c.user_id AND e.ord > a AND e.ord < b WHERE b IS NOT NULL GROUP BY 1, 2, 3""",
)
def paths_between_cuts(spark: SparkSession, d: str) -> DataFrame:
    """Sequences split at cuts; how many entries lie strictly between two cuts. One window per sequence, no range join."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    e = sequence.renumber(e, ["user_id"], "ts", "event_id")
    cuts = e.filter(F.col("event_type").isin("purchase", "signup"))
    nxt = F.lead("ord").over(Window.partitionBy("user_id").orderBy("ord"))
    return cuts.select("user_id", F.col("ord").alias("a"), nxt.alias("b")).filter("b is not null").withColumn("inside", F.col("b") - F.col("a") - 1)
