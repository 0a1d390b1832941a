"""Names, colours, markup and matching of names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import matching, sequence
from ..registry import query
from .tables import table

GENERIC = "station|metro|métro|underground|subway|bahnhof|u-bahn|estación|estacion|stazione|gare"
NORM = r"regexp_replace(regexp_replace(lower(strip_accents({0})), '\b(" + GENERIC + r")\b', ' ', 'g'), '[^\p{{L}}\p{{N}}]+', '', 'g')"
SLUG = r"coalesce(nullif(regexp_replace(regexp_replace(lower(strip_accents({0})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'x')"


@query(
    "F02 W04",
    f"""WITH s AS (SELECT p_partkey, {SLUG.format('p_type')} AS base FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS n FROM s)
    SELECT p_partkey, base, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS id FROM r""",
)
def unique_slugs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", T.slug(F.col("p_type")).alias("base"))
    return sequence.unique_ids(p, "base", "p_partkey")


@query("F01 F06", f"SELECT doc_id, md5({NORM.format('text')}) AS h FROM documents")
def normalize_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(F.encode(T.normalize_name(F.col("text")), "UTF-8")).alias("h"))


@query(
    "F03",
    r"""WITH r AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'B' || (c_custkey % 120) WHEN 1 THEN 'RE ' || (c_custkey % 30) WHEN 2 THEN c_mktsegment ELSE (c_custkey % 9) || 'bis' END AS ref FROM customer)
    SELECT c_custkey, ref, lower(CASE WHEN regexp_full_match(trim(ref), '[A-Za-z]{1,3}\s?-?\d{1,2}') THEN regexp_extract(trim(ref), '^[A-Za-z]+') ELSE trim(ref) END) AS family FROM r""",
)
def ref_family(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    ref = (
        F.when(k % 4 == 0, F.concat(F.lit("B"), (k % 120).cast("string")))
        .when(k % 4 == 1, F.concat(F.lit("RE "), (k % 30).cast("string")))
        .when(k % 4 == 2, F.col("c_mktsegment"))
        .otherwise(F.concat((k % 9).cast("string"), F.lit("bis")))
    )
    return table(spark, d, "customer").select("c_custkey", ref.alias("ref")).withColumn("family", T.ref_family(F.col("ref")))


@query(
    "F05",
    r"""WITH s AS (SELECT s_suppkey, 'N. Main St., ' || s_name || ' Ave (East & West) / ' || CASE s_suppkey % 3 WHEN 0 THEN 'Mt Airy Sq' WHEN 1 THEN 'Trans. Ctr. Blvd' ELSE 'Phila Jct' END AS name FROM supplier)
    SELECT s_suppkey, name, replace(array_to_string(list_transform(string_split(trim(regexp_replace(replace(regexp_replace(name, '\s*\([^)]*\)\s*', ' ', 'g'), ',', ' '), '\s+', ' ', 'g')), ' '), lambda w: coalesce(map_extract(MAP {'N.': 'North', 'St.': 'Street', 'Ave': 'Avenue', 'Mt': 'Mount', 'Sq': 'Square', 'Trans.': 'Transportation', 'Ctr.': 'Center', 'Blvd': 'Boulevard', 'Phila': 'Philadelphia', 'Jct': 'Junction'}, w)[1], w)), ' '), ' / ', '-') AS full_name FROM s""",
)
def expand_abbrev(spark: SparkSession, d: str) -> DataFrame:
    last = F.when(F.col("s_suppkey") % 3 == 0, "Mt Airy Sq").when(F.col("s_suppkey") % 3 == 1, "Trans. Ctr. Blvd").otherwise("Phila Jct")
    s = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("N. Main St., "), "s_name", F.lit(" Ave (East & West) / "), last).alias("name"))
    return s.withColumn("full_name", T.expand_abbreviations(F.col("name")))


_NAMES = ", ".join(f"'{k}': '{v}'" for k, v in T.ROUTE_COLOURS.items())


@query(
    "F04 F22 W05",
    f"""WITH r AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Red' WHEN 1 THEN '#' || substr(md5(p_partkey::VARCHAR), 1, 6) WHEN 2 THEN substr(md5(p_partkey::VARCHAR), 1, 3) ELSE p_brand END AS raw FROM part),
    n AS (SELECT p_partkey, raw, coalesce(map_extract(MAP {{{_NAMES}}}, lower(raw))[1], CASE WHEN regexp_full_match(raw, '#[0-9a-f]{{6}}') THEN raw
      WHEN regexp_full_match(raw, '[0-9a-f]{{3}}') THEN '#' || regexp_replace(raw, '(.)', '\\1\\1', 'g') ELSE '#8c8c8c' END) AS colour FROM r)
    SELECT p_partkey, raw, colour, CAST(floor(sqrt(pow(('0x' || colour[2:3])::INT - 228, 2) + pow(('0x' || colour[4:5])::INT - 0, 2) + pow(('0x' || colour[6:7])::INT - 43, 2)) * 1000 + 0.5) AS BIGINT) AS red_distance FROM n""",
)
def normalize_colours(spark: SparkSession, d: str) -> DataFrame:
    k, digest = F.col("p_partkey"), F.md5(F.encode(F.col("p_partkey").cast("string"), "UTF-8"))
    raw = F.when(k % 4 == 0, "Red").when(k % 4 == 1, F.concat(F.lit("#"), F.substring(digest, 1, 6))).when(k % 4 == 2, F.substring(digest, 1, 3)).otherwise(F.col("p_brand"))
    p = table(spark, d, "part").select("p_partkey", raw.alias("raw")).withColumn("colour", T.normalize_colour(F.col("raw"), F.lit("#8c8c8c")))
    return p.withColumn("red_distance", F.floor(T.colour_distance(F.col("colour"), F.lit("#e4002b")) * 1000 + 0.5))


@query(
    "S06",
    r"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<(/?[a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM pages)
    SELECT page_id, lower(tag) AS tag, count(*) AS n FROM t GROUP BY 1, 2""",
)
def html_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<(/?[a-zA-Z][a-zA-Z0-9]*)"), F.lit(1))).alias("tag"))
    return t.groupBy("page_id", F.lower("tag").alias("tag")).agg(F.count("*").alias("n"))


@query(
    "S07",
    r"""WITH s AS (SELECT page_id, unnest(regexp_extract_all(html, '<style>([^<]*)</style>', 1)) || 'p,h1{margin:1em;color:red}' AS css FROM pages),
    b AS (SELECT page_id, unnest(regexp_extract_all(css, '[^{}]+\{[^}]*\}')) AS b, unnest(range(0, len(regexp_extract_all(css, '[^{}]+\{[^}]*\}')))) AS i FROM s),
    e AS (SELECT page_id, i, trim(unnest(string_split(split_part(b, '{', 1), ','))) AS selector, rtrim(split_part(b, '{', 2), '}') AS body FROM b),
    p AS (SELECT page_id, i, selector, unnest(string_split(body, ';')) AS decl, unnest(range(0, len(string_split(body, ';')))) AS j FROM e)
    SELECT page_id, selector, trim(split_part(decl, ':', 1)) AS property, arg_max(trim(regexp_replace(decl, '^[^:]*:', '')), i * 1000 + j) AS value FROM p WHERE contains(decl, ':') GROUP BY 1, 2, 3""",
)
def css_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Style sheets of pages, with one more block behind them: the last rule of each selector and property wins."""
    s = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<style>([^<]*)</style>"), F.lit(1))).alias("css"))
    rules = s.select("page_id", F.inline(T.css_rules(F.concat("css", F.lit("p,h1{margin:1em;color:red}")))))
    return rules.groupBy("page_id", "selector", "property").agg(F.max_by("value", "ord").alias("value"))


KEYS = f"""labels_ AS (SELECT c_custkey AS id, lower(substr(md5(c_custkey::VARCHAR), 1, 6 + (c_custkey % 4)::INT)) AS k FROM customer),
    stations_ AS (SELECT s_suppkey AS sid, lower(substr(md5((s_suppkey * 3)::VARCHAR), 1, 9)) AS sk FROM supplier)"""


@query(
    "J09 J10",
    f"""WITH {KEYS}, c AS (
      SELECT id, sid, CASE WHEN k = sk THEN 2.0::DOUBLE WHEN (starts_with(sk, k) OR starts_with(k, sk)) AND least(length(k), length(sk)) / greatest(length(k), length(sk))::DOUBLE >= 0.45
        THEN least(length(k), length(sk)) / greatest(length(k), length(sk))::DOUBLE + 0.5 WHEN contains(sk, k) OR contains(k, sk) THEN least(length(k), length(sk)) / greatest(length(k), length(sk))::DOUBLE END AS score
      FROM labels_, stations_ WHERE length(k) >= 4 AND length(sk) >= 4)
    SELECT id, sid, CAST(floor(score * 1000 + 0.5) AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, sid) AS r FROM c WHERE score > 0.55) WHERE r = 1""",
)
def fuzzy_key_match(spark: SparkSession, d: str) -> DataFrame:
    def digest(c):
        return F.md5(F.encode(c.cast("string"), "UTF-8"))

    labels = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), digest(F.col("c_custkey")).alias("h")).select("id", F.expr("lower(substr(h, 1, cast(6 + id % 4 as int)))").alias("k"))
    stations = table(spark, d, "supplier").select(F.col("s_suppkey").alias("sid"), F.substring(digest(F.col("s_suppkey") * 3), 1, 9).alias("sk"))
    best = matching.fuzzy_best(labels, stations)
    return best.select("id", "sid", F.floor(F.col("score") * 1000 + 0.5).alias("score"))


@query(
    "T07",
    """WITH c AS (SELECT c_custkey, c_name, lower(c_mktsegment) AS ref FROM customer), p AS (SELECT p_partkey, lower(p_brand) AS label, p_size::BIGINT AS stations FROM part),
    l AS (SELECT c_custkey, 'brand#' || (11 + c_custkey % 60) AS ref FROM customer), m AS (SELECT c_custkey, p_partkey, label, stations, CASE WHEN label = ref THEN 1 WHEN contains(label, ref) OR contains(ref, label) THEN 2 END AS tier FROM l JOIN p ON contains(label, ref) OR contains(ref, label))
    SELECT c_custkey, p_partkey, tier::INT AS tier FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY tier, stations DESC, p_partkey) AS r FROM m) WHERE r = 1""",
)
def tiered_line_match(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("brand#"), (11 + F.col("c_custkey") % 60).cast("string")).alias("ref"))
    cands = table(spark, d, "part").select("p_partkey", F.lower("p_brand").alias("label"), F.col("p_size").cast("long").alias("stations"))
    return matching.tiered(lines, cands)


@query(
    "V01 A19",
    """WITH n AS (SELECT c_nationkey AS line, count(DISTINCT o_custkey) AS found FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
    p AS (SELECT c_nationkey AS line, count(*) AS published, bool_or(c_custkey % 2 = 0) AS hard FROM customer GROUP BY 1),
    k AS (SELECT n_nationkey::BIGINT AS line, found - published AS delta, published, hard FROM nation LEFT JOIN n ON n.line = n_nationkey LEFT JOIN p ON p.line = n_nationkey)
    SELECT line, delta, CASE WHEN published IS NULL THEN 'unmatched' WHEN abs(delta) > 2 AND hard AND line % 3 <> 0 THEN 'fail' WHEN delta <> 0 THEN 'warn' ELSE 'pass' END AS status FROM k""",
)
def check_status(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders").select("o_custkey").distinct(), table(spark, d, "customer")
    found = c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi").groupBy(F.col("c_nationkey").alias("line")).agg(F.count("*").alias("found"))
    published = c.groupBy(F.col("c_nationkey").alias("line")).agg(F.count("*").alias("published"), F.bool_or(F.col("c_custkey") % 2 == 0).alias("hard"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("line")).join(found, "line", "left").join(published, "line", "left")
    n = n.select(F.col("line").cast("long"), (F.col("found") - F.col("published")).alias("delta"), "published", (F.col("hard") & (F.col("line") % 3 != 0)).alias("hard"))
    return n.select("line", "delta", matching.status(F.col("published"), F.col("delta"), F.col("hard")).alias("status"))


@query("F40 S10", "SELECT p_partkey, p_name, p_brand, p_size::BIGINT AS p_size, p_retailprice FROM part")
def json_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Rows written as JSON documents and read back."""
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", F.col("p_size").cast("long").alias("p_size"), "p_retailprice")
    j = p.select(F.to_json(F.struct(*p.columns)).alias("j"))
    return j.select(F.from_json("j", p.schema).alias("r")).select("r.*")


@query(
    "F11 K02",
    """WITH s AS (SELECT c_custkey, 'a1:' || (c_custkey % 4) || ', s3' || CASE WHEN c_custkey % 2 = 0 THEN ':2' ELSE '' END AS spec FROM customer),
    i AS (SELECT c_custkey, trim(unnest(string_split(spec, ','))) AS x FROM s), e AS (SELECT c_custkey, split_part(x, ':', 1) AS id, greatest(1, coalesce(try_cast(split_part(x, ':', 2) AS INT), 1)) AS n FROM i)
    SELECT c_custkey, id, (unnest(range(1, n + 1)))::INT AS machine FROM e""",
)
def farm_spec(spark: SparkSession, d: str) -> DataFrame:
    tail = F.when(F.col("c_custkey") % 2 == 0, ":2").otherwise("")
    s = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("a1:"), (F.col("c_custkey") % 4).cast("string"), F.lit(", s3"), tail).alias("spec"))
    return s.select("c_custkey", F.inline(T.farm_spec(F.col("spec")))).select("c_custkey", "id", F.explode(F.expr("sequence(1, n)")).alias("machine"))


@query(
    "U06 J23 U04",
    """WITH over_ AS (SELECT s_suppkey AS k, 'overlay ' || s_name AS name FROM supplier WHERE s_acctbal < 0), hit AS (SELECT p_partkey AS k, p_name AS name FROM part)
    SELECT k, name, 'overlay' AS origin FROM over_ UNION ALL SELECT k, name, 'base' FROM hit WHERE k NOT IN (SELECT k FROM over_)""",
)
def overlay_replace(spark: SparkSession, d: str) -> DataFrame:
    over = table(spark, d, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("k"), F.concat(F.lit("overlay "), "s_name").alias("name"))
    base = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"))
    return matching.overlay(base, over, "k")


@query(
    "S13",
    r"""WITH a AS (SELECT doc_id, substr(' |stations = ' || (doc_id % 97) || ' x | Stations=' || (doc_id % 31) || ' ' || text, 1, 20000) AS t FROM documents)
    SELECT doc_id, list_max(list_transform(regexp_extract_all(t, '(?i)\|\s*stations\s*=\s*(\d+)', 1), lambda x: x::BIGINT)) AS n FROM a""",
)
def wikitext_counts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    t = F.concat(F.lit(" |stations = "), (k % 97).cast("string"), F.lit(" x | Stations="), (k % 31).cast("string"), F.lit(" "), "text")
    return table(spark, d, "documents").select("doc_id", T.wikitext_station_count(t).alias("n"))


@query(
    "F09 A21",
    """SELECT o_orderkey, CASE WHEN d > 0 THEN d || 'd ' ELSE '' END || CASE WHEN d > 0 OR h > 0 THEN h || 'h ' ELSE '' END || m || 'm' AS took
    FROM (SELECT o_orderkey, floor(o_totalprice / 86400)::BIGINT AS d, floor((o_totalprice % 86400) / 3600)::BIGINT AS h, floor((o_totalprice % 3600) / 60 + 0.5)::BIGINT AS m FROM orders)""",
)
def durations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", T.format_duration(F.col("o_totalprice")).alias("took"))


@query(
    "T07",
    """SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY (c_acctbal > 5000) DESC, (c_mktsegment = 'BUILDING') DESC, abs(length(c_name) - 18), c_custkey) AS r FROM customer) WHERE r = 1""",
)
def preference_pick(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal", "c_mktsegment", "c_name")
    best = F.struct((F.col("c_acctbal") <= 5000).alias("a"), (F.col("c_mktsegment") != "BUILDING").alias("b"), F.abs(F.length("c_name") - 18).alias("c"), F.col("c_custkey").alias("k"))
    return c.groupBy("c_nationkey").agg(F.min(best)["k"].alias("c_custkey"))


