"""Queries over markup: web pages as they are, and drawings that Spark writes from the stops of each pattern."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents, markup
from ..registry import query
from .tables import STOPS, stops, table

SPANS = ["a", "b", "br"]


def page_nodes(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    chars = pages.agg(F.coalesce(F.sum(F.length("html")), F.lit(0))).first()[0]
    return markup.tree(markup.tokens(pages, "page_id", "html", chars), markup.VOID_TAGS, chars)


#: Pages walked token by token with a list as stack: the other way of building the tree.
WALK = rf"""
RECURSIVE toks AS (
  SELECT doc, list(t ORDER BY o) AS ts, list(o ORDER BY o) AS os, max(o) AS final FROM (
    SELECT page_id AS doc, unnest(regexp_extract_all(html, '{markup.TOKEN.replace("'", "''")}')) AS t, generate_subscripts(regexp_extract_all(html, '{markup.TOKEN.replace("'", "''")}'), 1) - 1 AS o FROM pages
  ) WHERE NOT regexp_matches(t, '^<(\?|!)') OR starts_with(t, '<![CDATA[') GROUP BY doc
), walk AS (
  SELECT doc, 0 AS k, CAST([] AS BIGINT[]) AS stack, CAST(NULL AS BIGINT) AS node, CAST(NULL AS BIGINT) AS parent, CAST(NULL AS BIGINT) AS closed, CAST(NULL AS VARCHAR) AS t, 0 AS depth FROM toks
  UNION ALL
  SELECT w.doc, k + 1,
    CASE WHEN starts_with(ts[k + 1], '</') THEN stack[:-2] WHEN starts_with(ts[k + 1], '<') AND NOT starts_with(ts[k + 1], '<!') AND NOT ends_with(ts[k + 1], '/>')
      AND lower(regexp_extract(ts[k + 1], '^<([\w:.-]+)', 1)) NOT IN ({", ".join(f"'{v}'" for v in markup.VOID_TAGS)}) THEN list_append(stack, os[k + 1]) ELSE stack END,
    os[k + 1], stack[-1], CASE WHEN starts_with(ts[k + 1], '</') THEN stack[-1] END, ts[k + 1], len(stack)
  FROM walk w JOIN toks USING (doc) WHERE k < len(ts)
), plain AS (SELECT doc, node, parent, depth, t FROM walk WHERE t IS NOT NULL AND NOT starts_with(t, '</')),
own AS (
  SELECT doc, parent AS node, string_agg(CASE WHEN starts_with(t, '<![CDATA[') THEN t[10:-4] ELSE
    replace(replace(replace(replace(replace(t, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', '''') END, '' ORDER BY node) AS text
  FROM plain WHERE (NOT starts_with(t, '<') AND trim(regexp_replace(t, '\s+', ' ', 'g')) <> '') OR starts_with(t, '<![CDATA[') GROUP BY 1, 2
), nodes AS (
  SELECT p.doc, p.node, p.parent, CAST(p.depth AS INT) AS depth, regexp_extract(p.t, '^<([\w:.-]+)', 1) AS tag, coalesce(text, '') AS text,
    CASE WHEN ends_with(p.t, '/>') OR lower(regexp_extract(p.t, '^<([\w:.-]+)', 1)) IN ({", ".join(f"'{v}'" for v in markup.VOID_TAGS)}) THEN p.node ELSE coalesce(c.node, final) END AS last
  FROM plain p JOIN toks ON p.doc = toks.doc LEFT JOIN walk c ON c.doc = p.doc AND c.closed = p.node LEFT JOIN own ON own.doc = p.doc AND own.node = p.node
  WHERE starts_with(p.t, '<') AND NOT starts_with(p.t, '<!')
)"""


@query("S06 F07", f"WITH {WALK} SELECT doc, CAST(node AS INT) AS node, CAST(coalesce(parent, -1) AS INT) AS parent, depth, tag, text, CAST(last AS INT) AS last FROM nodes")
def markup_tree(spark: SparkSession, d: str) -> DataFrame:
    """Elements of pages with parent, depth, own text and the token that ends them."""
    return page_nodes(spark, d).select("doc", "node", F.coalesce("parent", F.lit(-1)).cast("int").alias("parent"), "depth", "tag", "text", "last")


@query(
    "S22",
    f"""WITH {WALK}, up AS (
      SELECT doc, node AS pos, node, text, tag, parent FROM nodes
      UNION ALL SELECT u.doc, u.pos, p.node, u.text, p.tag, p.parent FROM up u JOIN nodes p ON u.doc = p.doc AND u.parent = p.node WHERE u.tag IN ({", ".join(f"'{x}'" for x in SPANS)})
    ) SELECT doc, CAST(node AS INT) AS node, trim(regexp_replace(string_agg(text, ' ' ORDER BY pos), '\\s+', ' ', 'g')) AS text FROM up WHERE tag NOT IN ({", ".join(f"'{x}'" for x in SPANS)}) GROUP BY 1, 2""",
)
def markup_text(spark: SparkSession, d: str) -> DataFrame:
    """The text of each element of pages with that of the links, bold parts and breaks below it."""
    return markup.collected_text(page_nodes(spark, d), SPANS)


@query("S22", f"WITH {WALK} SELECT n.doc, CAST(n.node AS INT) AS node, CAST(coalesce(min(a.node), -1) AS INT) AS first FROM nodes n LEFT JOIN nodes a ON a.doc = n.doc AND a.tag = 'a' AND a.node BETWEEN n.node AND n.last GROUP BY 1, 2")
def markup_first(spark: SparkSession, d: str) -> DataFrame:
    """The first link at or below each element of pages."""
    f = markup.first_within(page_nodes(spark, d), "a")
    return f.withColumn("first", F.coalesce("first", F.lit(-1)).cast("int"))


def drawings(spark: SparkSession, d: str) -> DataFrame:
    """(seq, svg): a drawing for each pattern. Each stop is a group within that of the stop before, moved and scaled, with
    styles of all four sources; it shows a template by reference, and a path of its own."""
    s, o = F.col("station"), F.col("ord")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    own = F.concat(F.when(s % 5 == 0, F.lit(' stroke="#0072bc"')).otherwise(F.lit("")), F.when(s % 7 == 0, F.lit(" style='stroke: #009b48; opacity:1'")).otherwise(F.lit("")))
    scale = F.element_at(F.array(*[F.lit(x) for x in ("0.5", "1", "2")]), (s % 3 + 1).cast("int"))
    group = text('<g id="n', o, '" class="x c', s % 4, '" transform="translate(', s % 13 - 6, ",", s % 7 - 3, ") scale(", scale, ')"', own, ">")
    inner = text('<use href="#t" x="', o, '" y="1"/><path d="M', s % 10, " 2l", s % 5, " 4h3 V", s % 6, ' z m1,1 L 4 4"/>')
    parts = stops(spark, d).groupBy("seq").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", text(group, inner).alias("t")))), lambda x: x["t"]), "").alias("body"), F.count("*").alias("n"))
    head = '<?xml version="1.0"?><svg viewBox="10 20 900 900"><!-- a < b --><style><![CDATA[.c0{stroke:#e4002b;fill:none} .c1,.c9{stroke:#f7941d}.c1{stroke:#8e258d}#n3{stroke:blue}]]></style><defs><g id="t" transform="translate(1,2)"><line x1="0" y1="0" x2="8" y2="0"/></g></defs>'
    return parts.select("seq", F.concat(F.lit(head), "body", F.repeat(F.lit("</g>"), F.col("n").cast("int")), F.lit("</svg>")).alias("svg"))


STYLED = f"""{STOPS}, own AS (
  SELECT seq, ord, station, CASE WHEN station % 7 = 0 THEN '#009b48' WHEN station % 5 = 0 THEN '#0072bc' WHEN ord = 3 THEN 'blue' WHEN station % 4 = 0 THEN '#e4002b' WHEN station % 4 = 1 THEN '#8e258d' END AS s FROM stops
)"""


@query("S08", f"WITH {STYLED} SELECT seq, ord, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY seq ORDER BY ord), '-') AS stroke FROM own")
def style_cascade(spark: SparkSession, d: str) -> DataFrame:
    """The stroke that holds in each group of the drawings, by classes, ids, attributes and inline styles down the tree."""
    nodes = documents.styled(drawings(spark, d), "seq", "svg", ["stroke"])
    groups = nodes.filter("depth > 0").withColumn("ord", F.regexp_extract("id", "^n([0-9]+)$", 1).try_cast("long")).filter("ord is not null")
    return groups.select(F.col("doc").alias("seq"), "ord", F.coalesce("stroke", F.lit("-")).alias("stroke"))


PLACED = f"""{STYLED}, p AS (
  SELECT *, station % 13 - 6 AS dx, station % 7 - 3 AS dy, sum(station % 3 - 1) OVER w AS e, last_value(s IGNORE NULLS) OVER w AS stroke FROM own WINDOW w AS (PARTITION BY seq ORDER BY ord)
), q AS (
  SELECT *, pow(2.0::DOUBLE, e) AS k, sum(dx * pow(2.0::DOUBLE, e - (station % 3 - 1))) OVER w - 10 AS x0, sum(dy * pow(2.0::DOUBLE, e - (station % 3 - 1))) OVER w - 20 AS y0 FROM p WINDOW w AS (PARTITION BY seq ORDER BY ord)
)"""


@query(
    "S09 F33",
    f"""WITH {PLACED}, l AS (
      SELECT seq, ord, 'line' AS tag, stroke, k AS width, 1 AS poly, [[ord + 1, 3], [ord + 9, 3]] AS pts, x0, y0, k FROM q
      UNION ALL SELECT seq, ord, 'path', stroke, k, 1, [[station % 10, 2], [station % 10 + station % 5, 6], [station % 10 + station % 5 + 3, 6], [station % 10 + station % 5 + 3, station % 6], [station % 10, 2]], x0, y0, k FROM q
      UNION ALL SELECT seq, ord, 'path', stroke, k, 3, [[station % 10 + 1, 3], [4, 4]], x0, y0, k FROM q
    ), e AS (SELECT *, unnest(pts) AS pt, generate_subscripts(pts, 1) - 1 AS i FROM l)
    SELECT seq, coalesce(CASE WHEN tag = 'path' THEN stroke END, '-') AS colour, tag, width, CAST(poly AS BIGINT) AS poly, CAST(i AS INT) AS i, x0 + k * pt[1] AS x, y0 + k * pt[2] AS y FROM e""",
)
def drawing_shapes(spark: SparkSession, d: str) -> DataFrame:
    """All points that the drawings show, templates at each of their uses included."""
    return documents.extracted(drawings(spark, d), "seq", "svg").select(F.col("doc").alias("seq"), F.coalesce("colour", F.lit("-")).alias("colour"), "tag", "width", "poly", F.col("i").cast("int").alias("i"), "x", "y")
