"""Order of lines, tiers of matching, overlays, pins and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import matching, sequence
from ..registry import query
from .tables import table

REF = "CASE c_custkey % 4 WHEN 0 THEN (c_custkey % 120) || 'bis' WHEN 1 THEN (c_custkey % 30)::VARCHAR WHEN 2 THEN 'b' || (c_custkey % 7) ELSE 'B' || (c_custkey % 9) END"


def _ref() -> Column:
    k = F.col("c_custkey")
    s = lambda n: (k % n).cast("string")
    return F.when(k % 4 == 0, F.concat(s(120), F.lit("bis"))).when(k % 4 == 1, s(30)).when(k % 4 == 2, F.concat(F.lit("b"), s(7))).otherwise(F.concat(F.lit("B"), s(9)))


@query(
    "T01",
    f"""WITH r AS (SELECT c_custkey, c_nationkey, {REF} AS ref FROM customer)
    SELECT c_custkey, ref, row_number() OVER (PARTITION BY c_nationkey ORDER BY coalesce(try_cast(regexp_extract(ref, '^(\\d+)', 1) AS BIGINT), 1000000), lower(ref), ref DESC, c_custkey)::INT AS place FROM r""",
)
def natural_line_order(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a network by the leading number of their reference, others behind, then by letters, lower case first."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", _ref().alias("ref"))
    return sequence.numbered(c, ["c_nationkey"], *matching.natural_order(F.col("ref")), "c_custkey", name="place").select("c_custkey", "ref", F.col("place").cast("int").alias("place"))


@query(
    "J20",
    """WITH l AS (SELECT c_custkey, c_nationkey AS grp, (c_custkey % 60)::VARCHAR AS ref, 'segment ' || lower(c_mktsegment) AS name FROM customer),
    p AS (SELECT p_partkey, p_partkey % 25 AS grp, CASE WHEN p_partkey % 5 < 3 THEN 'Line ' || (p_partkey % 97) || CASE WHEN p_partkey % 2 = 0 THEN ' (old)' ELSE '' END
        ELSE 'segment ' || lower(split_part(p_type, ' ', 1)) || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' automobile' END END AS label, p_size::BIGINT AS n FROM part),
    h AS (SELECT c_custkey, p_partkey, n, contains(label, '(') AS par, count(*) OVER (PARTITION BY c_custkey) AS k FROM l JOIN p ON l.grp = p.grp AND regexp_extract(label, '(?i)^line (\\w+)', 1) = ref),
    e AS (SELECT c_custkey, p_partkey, n FROM l JOIN p ON l.grp = p.grp AND label = name),
    w AS (SELECT DISTINCT c_custkey, p_partkey FROM (SELECT c_custkey, grp, unnest(string_split(name, ' ')) AS word FROM l) a JOIN (SELECT p_partkey, grp, unnest(string_split(label, ' ')) AS word FROM p) b ON a.grp = b.grp AND a.word = b.word AND length(a.word) > 7),
    u AS (SELECT c_custkey, min(p_partkey) AS p_partkey FROM w GROUP BY 1 HAVING count(*) = 1),
    a AS (SELECT c_custkey, 1 AS tier, p_partkey, 0 AS par, 0 AS n FROM h WHERE k = 1 UNION ALL SELECT c_custkey, 2, p_partkey, par::INT, n FROM h WHERE k > 1 UNION ALL SELECT c_custkey, 3, p_partkey, 0, n FROM e UNION ALL SELECT c_custkey, 4, p_partkey, 0, 0 FROM u)
    SELECT c_custkey, tier, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY tier, par, n DESC, p_partkey) AS r FROM a) WHERE r = 1""",
)
def published_line(spark: SparkSession, d: str) -> DataFrame:
    """The published line of each line: the only one with its number; else, of several, one without parenthesis and with most stations; else an equal name; else the only one with a long word in common."""
    line = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("grp"), (F.col("c_custkey") % 60).cast("string").alias("ref"), F.concat(F.lit("segment "), F.lower("c_mktsegment")).alias("name"))
    k = F.col("p_partkey")
    numbered = F.concat(F.lit("Line "), (k % 97).cast("string"), F.when(k % 2 == 0, " (old)").otherwise(""))
    named = F.concat(F.lit("segment "), F.lower(F.substring_index("p_type", " ", 1)), F.when(k % 3 == 0, "").otherwise(" automobile"))
    pub = table(spark, d, "part").select("p_partkey", (k % 25).alias("grp"), F.when(k % 5 < 3, numbered).otherwise(named).alias("label"), F.col("p_size").cast("long").alias("n"))
    return matching.published(line, pub)


@query(
    "J21 J30",
    """WITH f AS (SELECT c_custkey, list_filter([lower(c_mktsegment), 'n' || c_nationkey, substr(lower(c_name), 10)], lambda x: length(x) > 1) AS mine, ['auto', 'n' || (c_custkey % 25), 'building works', 'n' || (c_custkey % 7)] AS theirs FROM customer)
    SELECT c_custkey, len(list_filter(mine, lambda a: len(list_filter(theirs, lambda b: contains(a, b) OR contains(b, a))) > 0)) >= least(2, len(mine)) AS same_ends FROM f""",
)
def shared_termini(spark: SparkSession, d: str) -> DataFrame:
    """Whether two of a line's ends, or all if it has fewer, hold or are held by published ends."""
    k = F.col("c_custkey")
    mine = F.filter(F.array(F.lower("c_mktsegment"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), F.substring(F.lower("c_name"), 10, 1000)), lambda x: F.length(x) > 1)
    theirs = F.array(F.lit("auto"), F.concat(F.lit("n"), (k % 25).cast("string")), F.lit("building works"), F.concat(F.lit("n"), (k % 7).cast("string")))
    return table(spark, d, "customer").select("c_custkey", matching.share_ends(mine, theirs).alias("same_ends"))


@query(
    "J22 G25",
    """WITH o AS (SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'k' || s_suppkey WHEN 1 THEN 'gone' || s_suppkey ELSE 'x' || s_suppkey END AS key, 'a' || (s_suppkey % 50) AS alias, s_suppkey * 53 % 499 AS x, s_suppkey * 29 % 497 AS y FROM supplier),
    st AS (SELECT p_partkey AS station, 'k' || (p_partkey * 3) AS key, p_partkey * 53 % 499 AS x, p_partkey * 29 % 497 AS y FROM part), al AS (SELECT 'a' || n_nationkey AS alias, n_nationkey * 2 + 1 AS station FROM nation),
    a AS (SELECT id, min(station) AS s FROM o JOIN st USING (key) GROUP BY 1), b AS (SELECT id, min(station) AS s FROM o JOIN al USING (alias) GROUP BY 1),
    c AS (SELECT id, arg_min(station, (o.x - st.x) * (o.x - st.x) + (o.y - st.y) * (o.y - st.y)) AS s, count(*) FROM o JOIN st ON abs(o.x - st.x) <= 6 AND abs(o.y - st.y) <= 6 GROUP BY 1)
    SELECT o.id, coalesce(a.s, b.s, -1)::BIGINT AS station, CASE WHEN a.s IS NOT NULL THEN 'key' WHEN b.s IS NOT NULL THEN 'alias' WHEN c.s IS NOT NULL THEN 'near' ELSE 'missing' END AS how
    FROM o LEFT JOIN a USING (id) LEFT JOIN b USING (id) LEFT JOIN c USING (id)""",
)
def overlay_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Official stations found by key, else by alias, else by coordinates, else reported as missing."""
    k, p, n = F.col("s_suppkey"), F.col("p_partkey"), F.col("n_nationkey")
    named = lambda a, c: F.concat(F.lit(a), c.cast("string"))
    o = table(spark, d, "supplier").select(k.alias("id"), F.when(k % 3 == 0, named("k", k)).when(k % 3 == 1, named("gone", k)).otherwise(named("x", k)).alias("key"), named("a", k % 50).alias("alias"), (k * 53 % 499).alias("x"), (k * 29 % 497).alias("y"))
    st = table(spark, d, "part").select(p.alias("station"), named("k", p * 3).alias("key"), (p * 53 % 499).alias("x"), (p * 29 % 497).alias("y"))
    al = table(spark, d, "nation").select(named("a", n).alias("alias"), (n * 2 + 1).cast("long").alias("station"))
    return matching.resolve(o, st, al, 6).select("id", F.coalesce(F.when(F.col("how") != "near", F.col("station")), F.lit(-1).cast("long")).alias("station"), "how")


@query(
    "J24",
    """WITH s AS (SELECT p_partkey, 'N' || (p_partkey % 40) || ' / M' || (p_partkey % 13) AS name, (p_partkey % 25) AS line FROM part), parts AS (SELECT p_partkey, line, name AS part FROM s UNION SELECT p_partkey, line, unnest(string_split(name, ' / ')) FROM s),
    pin AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'N' || (c_custkey % 45) ELSE 'M' || (c_custkey % 15) || '@' || (c_custkey % 30) END AS entry FROM customer)
    SELECT c_custkey, entry, coalesce(min(p_partkey), -1) AS station FROM pin LEFT JOIN parts ON part = split_part(entry, '@', 1) AND (NOT contains(entry, '@') OR line = try_cast(split_part(entry, '@', 2) AS BIGINT)) GROUP BY 1, 2""",
)
def pinned_names(spark: SparkSession, d: str) -> DataFrame:
    """Entries Name or Name@REF: a station whose name, or a part of it, is the name, on the line REF if one is given; here -1 stands for none."""
    p, k = F.col("p_partkey"), F.col("c_custkey")
    st = table(spark, d, "part").select(p.alias("station"), F.concat(F.lit("N"), (p % 40).cast("string"), F.lit(" / M"), (p % 13).cast("string")).alias("name"), (p % 25).cast("string").alias("line"))
    pin = F.when(k % 3 == 0, F.concat(F.lit("N"), (k % 45).cast("string"))).otherwise(F.concat(F.lit("M"), (k % 15).cast("string"), F.lit("@"), (k % 30).cast("string")))
    found = matching.pinned(table(spark, d, "customer").select("c_custkey", pin.alias("entry")), st)
    return found.withColumn("station", F.coalesce("station", F.lit(-1).cast("long")))


@query(
    "J25",
    """WITH l AS (SELECT p_partkey AS id, p_partkey // 100 AS sheet, 10.0::DOUBLE + (p_partkey % 4) AS em, (p_partkey % 2) * 90 AS angle, (p_partkey * 7919 % 101)::DOUBLE AS x, (p_partkey * 104729 % 103)::DOUBLE AS y FROM part),
    c AS (SELECT a.id, b.id AS below, row_number() OVER (PARTITION BY a.id ORDER BY b.y, b.x, b.id) AS r FROM l a JOIN l b ON a.sheet = b.sheet AND a.id <> b.id AND a.angle = b.angle AND abs(b.em - a.em) <= 0.15::DOUBLE * a.em AND b.y - a.y BETWEEN 0.8::DOUBLE * a.em AND 1.6::DOUBLE * a.em AND abs(b.x - a.x) <= 0.6::DOUBLE * a.em)
    SELECT a.id, a.below, coalesce(b.below, -1) AS third FROM c a LEFT JOIN c b ON b.id = a.below AND b.r = 1 WHERE a.r = 1""",
)
def stacked_labels(spark: SparkSession, d: str) -> DataFrame:
    """The label that goes on below each label, and the one below that: alike in size and angle, 0.8 to 1.6 em lower, within 0.6 em aside; the first in order of y and x."""
    k = F.col("p_partkey")
    l = table(spark, d, "part").select(  # noqa: E741
        k.alias("id"), F.floor(k / 100).alias("sheet"), (10.0 + k % 4).alias("em"), (k % 2 * 90).alias("angle"), (k * 7919 % 101).cast("double").alias("x"), (k * 104729 % 103).cast("double").alias("y")
    )
    below = matching.labels_below(l, 32.0)
    return below.join(below.select(F.col("id").alias("below"), F.col("below").alias("third")), "below", "left").select("id", "below", F.coalesce("third", F.lit(-1).cast("long")).alias("third"))


@query(
    "J29",
    """WITH a AS (SELECT p_partkey, upper(CASE WHEN p_partkey % 2 = 0 THEN 'l' ELSE '' END || 'r' || (p_partkey % 300) || 'c1') AS tag FROM part), b AS (SELECT s_suppkey, 'LR' || (s_suppkey % 450) || 'C1' AS tag FROM supplier)
    SELECT p_partkey, coalesce(min(s_suppkey), -1) AS piece FROM a LEFT JOIN b ON b.tag = a.tag OR b.tag = 'L' || a.tag GROUP BY 1""",
)
def tag_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Pieces by tags as people type them: in any case, the leading L may be missing."""
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    typed = table(spark, d, "part").select("p_partkey", F.upper(F.concat(F.when(k % 2 == 0, "l").otherwise(""), F.lit("r"), (k % 300).cast("string"), F.lit("c1"))).alias("tag"))
    pieces = table(spark, d, "supplier").groupBy(F.concat(F.lit("LR"), (s % 450).cast("string"), F.lit("C1")).alias("tag")).agg(F.min("s_suppkey").alias("piece"))
    full = F.when(F.startswith("tag", F.lit("L")), F.col("tag")).otherwise(F.concat(F.lit("L"), "tag"))
    return typed.withColumn("tag", full).join(pieces, "tag", "left").select("p_partkey", F.coalesce("piece", F.lit(-1).cast("long")).alias("piece"))


@query(
    "P13",
    "SELECT c_custkey, regexp_matches(coalesce(nullif(c_mktsegment, 'BUILDING'), '') || ' ' || coalesce(c_name, '') || ' ' || coalesce(c_nationkey::VARCHAR, ''), '(?i)(^ |auto|000[13]5)') AS overlaid FROM customer",
)
def overlay_match(spark: SparkSession, d: str) -> DataFrame:
    """Networks, operators and names as one string under a pattern; what is missing leaves its separator."""
    part = lambda c: F.coalesce(c, F.lit(""))
    whole = F.concat(part(F.nullif("c_mktsegment", F.lit("BUILDING"))), F.lit(" "), part(F.col("c_name")), F.lit(" "), part(F.col("c_nationkey").cast("string")))
    return table(spark, d, "customer").select("c_custkey", whole.rlike("(?i)(^ |auto|000[13]5)").alias("overlaid"))


@query(
    "P16",
    """SELECT c_custkey, coalesce(nullif(c_nationkey, 3)::BIGINT, 7) AS scale, CASE WHEN c_custkey % 2 = 0 THEN 'own' ELSE 'red' END AS route, 'grey' AS base, CASE WHEN c_custkey % 3 = 0 THEN 'extra' END AS extra FROM customer""",
)
def merged_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Parameters over their defaults: single values replace, maps are merged key by key."""
    k = F.col("c_custkey")
    own = F.map_concat(F.when(k % 2 == 0, F.create_map(F.lit("route"), F.lit("own"))).otherwise(F.create_map().cast("map<string,string>")), F.when(k % 3 == 0, F.create_map(F.lit("extra"), F.lit("extra"))).otherwise(F.create_map().cast("map<string,string>")))
    colours = matching.merged(F.create_map(F.lit("route"), F.lit("red"), F.lit("base"), F.lit("grey")), own)
    c = table(spark, d, "customer").select("c_custkey", F.coalesce(F.nullif("c_nationkey", F.lit(3)).cast("long"), F.lit(7).cast("long")).alias("scale"), colours.alias("m"))
    return c.select("c_custkey", "scale", *[F.try_element_at("m", F.lit(x)).alias(x) for x in ("route", "base", "extra")])


@query(
    "P17 F07",
    """WITH n AS (SELECT s_suppkey, 'Main &amp; Co &lt;' || s_suppkey || '&gt; / ' || CASE WHEN s_suppkey % 2 = 0 THEN 'Station' ELSE 'Gare &amp;quot;X&amp;quot;' END || ' / main CO' || s_suppkey AS raw FROM supplier),
    t AS (SELECT s_suppkey, replace(replace(replace(replace(raw, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"') AS name FROM n),
    k AS (SELECT s_suppkey, name, list_transform(list_concat([name], string_split(name, ' / ')), lambda x: regexp_replace(regexp_replace(lower(x), '\\b(station|gare)\\b', ' ', 'g'), '[^a-z0-9]+', '', 'g')) AS ks FROM t)
    SELECT s_suppkey, name, array_to_string(list_filter(ks, lambda x, i: x <> '' AND NOT list_contains(ks[1:i-1], x)), '|') AS keys FROM k""",
)
def name_keys(spark: SparkSession, d: str) -> DataFrame:
    """Names with their entities decoded, and the keys under which they are looked up: the whole, then its parts."""
    k = F.col("s_suppkey")
    tail = F.when(k % 2 == 0, "Station").otherwise("Gare &amp;quot;X&amp;quot;")
    s = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("Main &amp; Co &lt;"), k.cast("string"), F.lit("&gt; / "), tail, F.lit(" / main CO"), k.cast("string")).alias("raw"))
    s = s.select("s_suppkey", T.decode_entities(F.col("raw")).alias("name"))
    return s.select("s_suppkey", "name", F.array_join(T.text_keys(F.col("name")), "|").alias("keys"))


@query(
    "S01 S17 S18 S19",
    """WITH f AS (SELECT p_partkey, p_brand AS q, p_size / 50.0::DOUBLE + CASE WHEN p_type LIKE '%BRASS' THEN 1 ELSE 0 END + CASE WHEN p_type LIKE 'PROMO%' THEN 0.5 ELSE 0 END AS score FROM part)
    SELECT q, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, p_partkey) AS r FROM f) WHERE r = 1""",
)
def ranked_places(spark: SparkSession, d: str) -> DataFrame:
    """The best answer to each question: importance, one more for boundaries, half a one for towns; the first of ties. One aggregation."""
    score = F.col("p_size") / F.lit(50.0) + F.when(F.endswith("p_type", F.lit("BRASS")), 1).otherwise(0) + F.when(F.startswith("p_type", F.lit("PROMO")), 0.5).otherwise(0)
    p = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("q"), score.alias("score"))
    return p.groupBy("q").agg(F.min(F.struct((-F.col("score")).alias("s"), "p_partkey"))["p_partkey"].alias("p_partkey"))


@query(
    "S04",
    """WITH m AS (SELECT c_nationkey, min(CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3 END) AS first_ FROM customer WHERE c_acctbal > 0 GROUP BY 1)
    SELECT c_custkey FROM customer JOIN m USING (c_nationkey) WHERE c_acctbal > 0 AND c_mktsegment = ['MACHINERY', 'BUILDING', 'FURNITURE'][first_]""",
)
def first_wanted_mode(spark: SparkSession, d: str) -> DataFrame:
    """Routes of the first wanted mode of which a city has any."""
    c = table(spark, d, "customer").filter("c_acctbal > 0").select("c_custkey", "c_nationkey", "c_mktsegment")
    place = F.array_position(F.array(*[F.lit(x) for x in ("MACHINERY", "BUILDING", "FURNITURE")]), F.col("c_mktsegment"))
    c = c.withColumn("place", place).filter("place > 0")
    best = c.groupBy("c_nationkey").agg(F.min("place").alias("place"))
    return c.join(best, ["c_nationkey", "place"], "left_semi").select("c_custkey")


@query(
    "S03 P01",
    """WITH r AS (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND regexp_matches(o_orderpriority, '^[1-3]-')), n AS (SELECT DISTINCT l_partkey AS node FROM lineitem JOIN r ON l_orderkey = o_orderkey),
    m AS (SELECT DISTINCT o_custkey AS master FROM orders JOIN r USING (o_orderkey))
    SELECT 'route' AS kind, o_orderkey AS id FROM r UNION ALL SELECT 'node', node FROM n UNION ALL SELECT 'master', master FROM m""",
)
def selected_elements(spark: SparkSession, d: str) -> DataFrame:
    """Routes of the wanted modes, the nodes on them and the masters above them: one filter, two semi-joins."""
    o = table(spark, d, "orders").filter((F.col("o_orderstatus") != "P") & F.col("o_orderpriority").rlike("^[1-3]-")).select("o_orderkey", "o_custkey")
    nodes = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select(F.lit("node").alias("kind"), F.col("l_partkey").alias("id")).distinct()
    masters = o.select(F.lit("master").alias("kind"), F.col("o_custkey").alias("id")).distinct()
    return o.select(F.lit("route").alias("kind"), F.col("o_orderkey").alias("id")).unionByName(nodes).unionByName(masters)
