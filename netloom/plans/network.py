"""Stop patterns, lines and the station graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph, matching, sequence
from ..operators.shared import dealt
from ..registry import query
from .tables import STOPS, line_stops, patterns, stops, table


@query("A01 J01 J04", f"WITH {STOPS} SELECT line::BIGINT AS line, count(DISTINCT station) AS n_stations FROM line_stops GROUP BY line")
def line_station_counts(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("seq"), F.col("l_partkey").alias("station"))
    return li.join(patterns(spark, d), "seq").groupBy(F.col("line").cast("long").alias("line")).agg(F.countDistinct("station").alias("n_stations"))


@query(
    "W01 S05",
    f"WITH {STOPS} SELECT seq, ord, station FROM (SELECT *, lag(station) OVER (PARTITION BY seq ORDER BY ord) AS b FROM stops) WHERE b IS NULL OR b <> station",
)
def stops_dedup_consecutive(spark: SparkSession, d: str) -> DataFrame:
    return sequence.drop_consecutive_duplicates(stops(spark, d), ["seq"], "ord", "station")


EDGES = "edges AS (SELECT seq, least(station, b) AS a, greatest(station, b) AS b FROM (SELECT seq, station, lead(station) OVER (PARTITION BY seq ORDER BY ord) AS b FROM stops) WHERE b <> station)"


@query("W02", f"WITH {STOPS}, {EDGES} SELECT a, b, count(*) AS n FROM edges GROUP BY a, b")
def edges_undirected(spark: SparkSession, d: str) -> DataFrame:
    e = sequence.undirected(sequence.steps(stops(spark, d), ["seq"], "ord", "station"))
    return dealt(e, ["a", "b"], table(spark, d, "lineitem").count()).groupBy("a", "b").agg(F.count("*").alias("n"))


@query("A24", f"WITH {STOPS} SELECT seq, arg_min(station, ord) AS first_value, arg_max(station, ord) AS last_value FROM stops GROUP BY seq")
def pattern_termini(spark: SparkSession, d: str) -> DataFrame:
    return sequence.termini(stops(spark, d), ["seq"], "ord", "station")


@query("J04 U01", f"WITH {STOPS} SELECT DISTINCT station, line::BIGINT AS line FROM line_stops")
def station_lines_bridge(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("seq"), F.col("l_partkey").alias("station"))
    return li.join(patterns(spark, d), "seq").select("station", F.col("line").cast("long").alias("line")).distinct()


DEGREE = "both_ways AS (SELECT a AS station, b AS other FROM edges UNION ALL SELECT b, a FROM edges), degree AS (SELECT station, count(DISTINCT other) AS degree FROM both_ways GROUP BY station)"


@query("A12", f"WITH {STOPS}, {EDGES}, {DEGREE} SELECT * FROM degree")
def station_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(sequence.steps(stops(spark, d), ["seq"], "ord", "station"))


@query(
    "G05 A11",
    f"""WITH {STOPS}, {EDGES}, {DEGREE}, colours AS (SELECT station, count(DISTINCT n_regionkey) AS n_colours FROM line_stops JOIN nation ON n_nationkey = line GROUP BY station)
    SELECT station, coalesce(degree, 0)::BIGINT AS degree, n_colours, (n_colours > 1 OR coalesce(degree, 0) <> 2) AS major FROM colours LEFT JOIN degree USING (station)""",
)
def station_major(spark: SparkSession, d: str) -> DataFrame:
    ls = line_stops(spark, d)
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("line"), "n_regionkey")
    colours = ls.join(nation, "line").groupBy("station").agg(F.countDistinct("n_regionkey").alias("n_colours"))
    return graph.majors(colours, graph.degrees(sequence.steps(stops(spark, d), ["seq"], "ord", "station")))


@query(
    "W02 J04 A17",
    f"WITH {STOPS}, {EDGES} SELECT a, b, string_agg(DISTINCT lpad(line::VARCHAR, 3, '0'), ',' ORDER BY lpad(line::VARCHAR, 3, '0')) AS lines FROM edges JOIN patterns USING (seq) GROUP BY a, b",
)
def edge_lines(spark: SparkSession, d: str) -> DataFrame:
    e = sequence.undirected(sequence.steps(stops(spark, d), ["seq"], "ord", "station")).join(patterns(spark, d), "seq")
    return e.groupBy("a", "b").agg(F.array_join(F.array_sort(F.collect_set(F.lpad(F.col("line").cast("string"), 3, "0"))), ",").alias("lines"))


@query(
    "J05 A10",
    f"""WITH {STOPS}, s AS (SELECT DISTINCT line, station FROM line_stops), n AS (SELECT line, count(*) AS n FROM s GROUP BY line),
    p AS (SELECT x.line AS a, y.line AS b, count(*) AS shared FROM s x JOIN s y ON x.station = y.station AND x.line < y.line GROUP BY 1, 2)
    SELECT a::BIGINT AS a, b::BIGINT AS b, shared, na.n AS n_a, nb.n AS n_b, (shared >= greatest(3, 0.9 * least(na.n, nb.n))) AS similar
    FROM p JOIN n na ON na.line = a JOIN n nb ON nb.line = b JOIN nation x ON x.n_nationkey = a JOIN nation y ON y.n_nationkey = b WHERE x.n_regionkey = y.n_regionkey""",
)
def line_pair_overlap(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("line"), F.col("n_regionkey").alias("colour"))
    served = line_stops(spark, d).select("line", "station").distinct().join(nation, "line")
    return graph.shared_stations(served, group="colour").select(
        F.col("a").cast("long"), F.col("b").cast("long"), "shared", "n_a", "n_b", (F.col("shared") >= F.greatest(F.lit(3.0), 0.9 * F.least("n_a", "n_b"))).alias("similar")
    )


@query(
    "P05 P06",
    """WITH r AS (SELECT o_orderkey, o_custkey, regexp_matches(o_orderpriority, '(?i)(urgent|not spec)') AS variant FROM orders)
    SELECT o_orderkey, o_custkey, variant FROM (SELECT *, bool_or(NOT variant) OVER (PARTITION BY o_custkey) AS regular FROM r) WHERE NOT variant OR NOT regular""",
)
def regular_variant_filter(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").rlike("(?i)(urgent|not spec)").alias("variant"))
    return keep_regular(r, "o_custkey", "variant")


def keep_regular(routes: DataFrame, line: str, variant: str) -> DataFrame:
    """Drops variant routes of lines that have a regular one. One aggregation and a join, so a busy line is no single window."""
    regular = routes.filter(~F.col(variant)).select(F.col(line).alias("_line")).distinct()
    left = routes.filter(F.col(variant)).join(regular, F.col(line) == F.col("_line"), "left_anti")
    return routes.filter(~F.col(variant)).unionByName(left)


@query(
    "P04",
    """WITH g AS (SELECT l_orderkey, list(DISTINCT l_suppkey) FILTER (l_returnflag = 'A') AS a, list(DISTINCT l_suppkey) FILTER (l_returnflag = 'R') AS b, list(DISTINCT l_suppkey) AS c FROM lineitem GROUP BY 1),
    t AS (SELECT l_orderkey, CASE WHEN len(a) >= 2 THEN 1 WHEN len(b) >= 2 THEN 2 WHEN len(c) >= 2 THEN 3 END AS tier, CASE WHEN len(a) >= 2 THEN a WHEN len(b) >= 2 THEN b WHEN len(c) >= 2 THEN c END AS s FROM g)
    SELECT l_orderkey, tier::INT AS tier, len(s)::BIGINT AS n_stops, array_to_string(list_sort(s), ',') AS stops FROM t WHERE tier IS NOT NULL""",
)
def tiered_stop_fallback(spark: SparkSession, d: str) -> DataFrame:
    def of(flag):
        return F.array_sort(F.collect_set(F.when(flag, F.col("l_suppkey"))))

    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(of(F.col("l_returnflag") == "A").alias("a"), of(F.col("l_returnflag") == "R").alias("b"), of(F.lit(True)).alias("c"))
    tier = F.when(F.size("a") >= 2, 1).when(F.size("b") >= 2, 2).when(F.size("c") >= 2, 3)
    s = F.when(F.size("a") >= 2, F.col("a")).when(F.size("b") >= 2, F.col("b")).when(F.size("c") >= 2, F.col("c"))
    return g.select("l_orderkey", tier.alias("tier"), s.alias("s")).filter("tier is not null").select("l_orderkey", "tier", F.size("s").cast("long").alias("n_stops"), F.array_join("s", ",").alias("stops"))


@query(
    "P02",
    """WITH local AS (SELECT DISTINCT lower(trim(unnest(string_split(p_brand || ';' || p_type, ';')))) AS n FROM part),
    k AS (SELECT c_custkey, unnest([lower(c_mktsegment), 'brand#' || (c_custkey % 77)]) AS k FROM customer)
    SELECT DISTINCT c_custkey FROM k WHERE EXISTS (SELECT 1 FROM local WHERE k.k = n OR (length(n) > 3 AND (contains(k.k, n) OR contains(n, k.k))))""",
)
def local_operator_filter(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    local = part.select(F.explode(F.split(F.concat_ws(";", "p_brand", "p_type"), ";")).alias("n")).select(F.lower(F.trim("n")).alias("n")).distinct()
    keys = table(spark, d, "customer").select("c_custkey", F.explode(F.array(F.lower("c_mktsegment"), F.concat(F.lit("brand#"), (F.col("c_custkey") % 77).cast("string")))).alias("k"))
    distinct = keys.select("k").distinct()
    hit = matching.containing(distinct, local).filter((F.col("k") == F.col("n")) | (F.length("n") > 3)).select("k").distinct()
    return keys.join(hit, "k", "left_semi").select("c_custkey").distinct()


@query(
    "P08 P07",
    f"""WITH {STOPS}, {EDGES}, {DEGREE}, ends AS (SELECT arg_min(station, ord) AS station FROM stops GROUP BY seq UNION SELECT arg_max(station, ord) FROM stops GROUP BY seq),
    fam AS (SELECT station, count(DISTINCT n_regionkey) AS families, bool_or(line % 5 = 0) AS rail FROM line_stops JOIN nation ON n_nationkey = line GROUP BY station)
    SELECT station, rail, station IN (SELECT station FROM ends) AS terminus, families FROM fam LEFT JOIN degree USING (station)
    WHERE rail OR station IN (SELECT station FROM ends) OR coalesce(degree, 0) > 2 OR families > 1""",
)
def thin_stops(spark: SparkSession, d: str) -> DataFrame:
    st = stops(spark, d)
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("line"), "n_regionkey")
    flags = line_stops(spark, d).join(nation, "line").groupBy("station").agg(F.countDistinct("n_regionkey").alias("families"), F.bool_or(F.col("line") % 5 == 0).alias("rail"))
    t = sequence.termini(st, ["seq"], "ord", "station")
    ends = t.select(F.explode(F.array("first_value", "last_value")).alias("station")).distinct().withColumn("terminus", F.lit(True))
    both = flags.join(ends, "station", "left").join(graph.degrees(sequence.steps(st, ["seq"], "ord", "station")), "station", "left")
    both = both.withColumn("terminus", F.coalesce("terminus", F.lit(False)))
    return both.filter(F.col("rail") | F.col("terminus") | (F.coalesce("degree", F.lit(0)) > 2) | (F.col("families") > 1)).select("station", "rail", "terminus", "families")


@query(
    "W19 W18 W17",
    """WITH r AS (SELECT o_custkey, o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS n FROM orders),
    k AS (SELECT * FROM r WHERE n = 1), m AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS k FROM k)
    SELECT o_custkey, o_orderstatus, o_orderkey, ((i - 1) - (k - 1) / 2.0) * 1.6 AS shift FROM (SELECT o_custkey, o_orderstatus, o_orderkey, i, k FROM m)""".replace("AS shift", "::DOUBLE AS shift").replace("((i - 1) - (k - 1) / 2.0) * 1.6", "(((i - 1) - (k - 1) / 2.0::DOUBLE) * 1.6::DOUBLE)"),
)
def parallel_offsets(spark: SparkSession, d: str) -> DataFrame:
    """One ribbon per corridor and colour, ribbons side by side around the corridor's middle."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderkey")
    ribbons = o.groupBy("o_custkey", "o_orderstatus").agg(F.min("o_orderkey").alias("o_orderkey"))
    w = Window.partitionBy("o_custkey")
    i, k = F.row_number().over(w.orderBy("o_orderkey")), F.count("*").over(w)
    return ribbons.withColumn("shift", ((i - 1) - (k - 1) / F.lit(2.0)) * F.lit(1.6))
