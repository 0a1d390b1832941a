"""Markup as rows: tokens, the tree with nested-set numbers, values inherited down the tree, matrices along root paths.

A document is a sequence of tokens, and its tree is read off running sums: the
open elements before a token are its depth, and its parent is the last element
opened one level above. So nothing recurses, and a chain of ten thousand
elements costs what ten thousand siblings cost. All windows are partitioned by
the document (or a level of it); one document is the unit that is not split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .shared import dealt, saved

# What the reader takes for one token (comment, instruction, raw text, document type, end tag, start tag, text), and for an attribute.
TOKEN = r"""<!--[\s\S]*?-->|<\?[\s\S]*?\?>|<!\[CDATA\[[\s\S]*?\]\]>|<!DOCTYPE[^>]*>|</[\w:.-]+\s*>|<[\w:.-]+(?:\s+[\w:.-]+\s*=\s*(?:"[^"]*"|'[^']*'))*\s*/?>|[^<]+"""
ATTRIBUTE = r"""[\w:.-]+\s*=\s*(?:"[^"]*"|'[^']*')"""
# Attributes that count as style, and elements that are no part of a drawing.
STYLE_ATTRIBUTES = ["stroke", "stroke-width", "stroke-dasharray", "fill", "font-size", "text-anchor", "display", "visibility"]
TEMPLATE_TAGS = ["defs", "symbol", "clipPath", "mask", "marker", "pattern"]
SKIPPED_TAGS = ["metadata", "title", "desc", "style"]
# Elements of web pages that have no end tag.
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
MOST_USES = 6
#: Characters of a token, about; tells how many tasks a text needs.
TOKEN_CHARS = 16
MATRIX = "abcdef"


def tokens(docs: DataFrame, doc: str, text: str, chars: int = 0) -> DataFrame:
    """(doc, ord, token); what is no token (a lone <) is passed over. A null text has none. chars: about how long all texts are, where they are many."""
    d = dealt(docs.select(F.col(doc).alias("doc"), F.col(text).alias("_text")), ["doc"], chars // TOKEN_CHARS)
    return d.select("doc", F.posexplode(F.regexp_extract_all("_text", F.lit(TOKEN), F.lit(0))).alias("ord", "token"))


def _attributes(token: Column) -> Column:
    pair = lambda x: F.struct(F.regexp_extract(x, r"^[\w:.-]+", 0).alias("k"), T.decode_entities(F.regexp_extract(x, r"""(?s)=\s*["'](.*)["']$""", 1)).alias("v"))
    return F.transform(F.regexp_extract_all(token, F.lit(ATTRIBUTE), F.lit(0)), pair)


def attr(name: str) -> Column:
    """An element's attribute, the last of that name; null if it has none."""
    return F.try_element_at(F.filter("attrs", lambda a: a["k"] == name), F.lit(-1))["v"]


def tree(tok: DataFrame, void: list[str] | None = None, chars: int = 0) -> DataFrame:
    """tokens -> (doc, node, parent, depth, tag, attrs, last, text), a row for each element.

    node is the number of the start tag's token, last that of the end tag: an element's descendants are the nodes
    between. An end tag closes the innermost open element, whatever its name, and none if none is open; elements
    that nothing closes end with the document (its last token). Elements with /> or of a ``void`` name hold
    nothing. text is the element's own text with its entities decoded, in order; blank pieces are left out, and so
    is text outside all elements. parent is null at the top. chars as for tokens. The rows are written once, so what reads
    them again does not read the markup again.
    """
    by = Window.partitionBy("doc").orderBy("ord")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    raw = F.startswith("token", F.lit("<![CDATA["))
    kind = F.when(raw, "text").when(F.startswith("token", F.lit("</")), "end").when(F.col("token").rlike("^<[!?]"), "none").when(F.startswith("token", F.lit("<")), "start").when(F.trim(F.regexp_replace("token", r"\s+", " ")) == "", "none").otherwise("text")
    tag = F.regexp_extract("token", r"^<([\w:.-]+)", 1)
    t = tok.withColumn("kind", kind).filter("kind <> 'none'").withColumn("tag", F.when(F.col("kind") == "start", tag))
    alone = F.endswith("token", F.lit("/>")) | F.lower("tag").isin(void or [])
    t = t.withColumn("opens", F.coalesce((F.col("kind") == "start") & ~alone, F.lit(False)))
    step = F.when(F.col("opens"), 1).when(F.col("kind") == "end", -1).otherwise(0)
    t = t.withColumns({"_sum": F.sum(step).over(upto), "final": F.max("ord").over(Window.partitionBy("doc"))})
    t = t.withColumn("_open", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(upto)))  # an end tag with nothing open closes nothing
    t = t.withColumn("depth", F.coalesce(F.lag("_open").over(by), F.lit(0)) - F.when(F.col("kind") == "end", 1).otherwise(0)).filter("depth >= 0")
    # every token stands at its level; starts and texts also ask the level above
    own = t.withColumns({"lev": F.col("depth"), "asks": F.lit(False)})
    asks = t.filter("kind <> 'end' and depth > 0").withColumns({"lev": F.col("depth") - 1, "asks": F.lit(True)})
    level = Window.partitionBy("doc", "lev")
    before, behind = level.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1), level.orderBy(F.col("ord").desc()).rowsBetween(Window.unboundedPreceding, -1)
    here = F.col("asks") == F.lit(False)
    found = dealt(own.unionByName(asks), ["doc"], 2 * chars // TOKEN_CHARS).withColumns(
        {
            "_parent": F.when(F.col("asks"), F.last(F.when(here & F.col("opens"), F.col("ord")), ignorenulls=True).over(before)),
            "_end": F.when(here & F.col("opens"), F.last(F.when(here & (F.col("kind") == "end"), F.col("ord")), ignorenulls=True).over(behind)),
        }
    )
    one = found.filter("kind <> 'end'").groupBy("doc", "ord").agg(*[F.any_value(c).alias(c) for c in ("kind", "tag", "token", "opens", "depth", "final")], F.max("_parent").alias("parent"), F.max("_end").alias("_end"))
    start = F.col("kind") == "start"
    piece = F.when(F.startswith("token", F.lit("<![CDATA[")), F.expr("substring(token, 10, length(token) - 12)")).otherwise(T.decode_entities(F.col("token")))
    # an element and the texts right below it
    of = one.filter(start | ((F.col("kind") == "text") & F.col("parent").isNotNull())).withColumn("node", F.when(start, F.col("ord")).otherwise(F.col("parent")))
    element = F.max(F.when(start, F.struct("parent", F.col("depth").cast("int").alias("depth"), "tag", "token", F.when(F.col("opens"), F.coalesce("_end", "final")).otherwise(F.col("ord")).alias("last"))))
    texts = F.collect_list(F.when(~start, F.struct("ord", piece.alias("s"))))
    nodes = of.groupBy("doc", "node").agg(element.alias("e"), F.array_join(F.transform(F.array_sort(texts), lambda x: x["s"]), "").alias("text"))
    return saved(nodes.select("doc", "node", "e.parent", "e.depth", "e.tag", _attributes(F.col("e.token")).alias("attrs"), "e.last", "text"), "markup")


def innermost(points: DataFrame, spans: DataFrame, keys: list[str], at: str = "node", rows: int = 0) -> DataFrame:
    """points(keys, at, ...), spans(keys, node, last, value) that are nested or apart, one for each (keys, node)
    -> points with the value of the innermost span around each; null outside all.

    A sweep with a stack, as windows: a start adds one open span and an end takes one away, and the span on top is
    the last one that was started at the present number of open ones. rows: about how many points there are, where they are many.
    """
    cols = points.columns
    asked = points.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_phase"), F.lit(0).alias("_step"), F.struct(*cols).alias("_point"))
    starts = spans.select(*keys, F.col("node").alias("_at"), F.lit(0).alias("_phase"), F.lit(1).alias("_step"), F.struct("value").alias("_value"))
    ends = spans.select(*keys, F.col("last").alias("_at"), F.lit(2).alias("_phase"), F.lit(-1).alias("_step"))
    events = asked.unionByName(starts, allowMissingColumns=True).unionByName(ends, allowMissingColumns=True)
    events = dealt(events, keys, 2 * rows)
    sweep = Window.partitionBy(*keys).orderBy("_at", "_phase").rowsBetween(Window.unboundedPreceding, 0)
    events = events.withColumn("_open", F.sum("_step").over(sweep))
    level = Window.partitionBy(*keys, "_open").orderBy("_at", "_phase").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("_top", F.last("_value", ignorenulls=True).over(level)).filter("_phase = 1").select(*[F.col(f"_point.{c}").alias(c) for c in cols], F.col("_top.value").alias("value"))


def collected_text(nodes: DataFrame, follow: list[str]) -> DataFrame:
    """(doc, node, text) for each element not in ``follow``: its own text, then that of the ``follow`` elements below it
    in document order (through such elements only), parted by spaces; white space made single."""
    heads = nodes.filter(~F.col("tag").isin(follow))
    owner = innermost(nodes.select("doc", "node", "text"), heads.select("doc", "node", "last", F.col("node").alias("value")), ["doc"], rows=nodes.count()).filter("value is not null")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "text"))), lambda x: x["text"]), " ")
    return owner.groupBy("doc", F.col("value").alias("node")).agg(F.trim(F.regexp_replace(whole, r"\s+", " ")).alias("text"))


def first_within(nodes: DataFrame, tag: str) -> DataFrame:
    """(doc, node, first): the first element of that name at or below each element, in document order; null if there is none."""
    behind = Window.partitionBy("doc").orderBy(F.col("node").desc()).rowsBetween(Window.unboundedPreceding, 0)
    nxt = F.last(F.when(F.col("tag") == tag, F.col("node")), ignorenulls=True).over(behind)
    return dealt(nodes, ["doc"], nodes.count()).withColumn("_n", nxt).select("doc", "node", F.when(F.col("_n") <= F.col("last"), F.col("_n")).alias("first"))


def style_rules(nodes: DataFrame) -> DataFrame:
    """(doc, selector, property, value) of all style elements of a document; the last one of a selector and property holds."""
    rules = nodes.filter("tag = 'style'").select("doc", "node", F.inline(T.css_rules(F.col("text"))))
    return rules.groupBy("doc", "selector", "property").agg(F.max_by("value", F.struct("node", "ord")).alias("value"))


def declared_styles(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc, node, property, value): what each element says itself. Rules of its classes (in the order in which it names
    them), of its id, its style attributes and its inline style, the later the stronger."""
    entry = lambda source, place, prop, value: F.struct(F.lit(source).alias("source"), place.alias("place"), prop.alias("property"), value.alias("value"))
    named = F.transform(F.filter(F.split(F.coalesce(attr("class"), F.lit("")), r"\s+"), lambda c: c != ""), lambda c, i: F.struct(F.lit(1).alias("source"), i.alias("place"), F.concat(F.lit("."), c).alias("selector")))
    by_id = F.when(attr("id") != "", F.array(F.struct(F.lit(2).alias("source"), F.lit(0).alias("place"), F.concat(F.lit("#"), attr("id")).alias("selector"))))
    asked = nodes.select("doc", "node", F.inline(F.concat(named, F.coalesce(by_id, F.array().cast("array<struct<source:int,place:int,selector:string>>")))))
    ruled = asked.join(rules, ["doc", "selector"]).select("doc", "node", "source", "place", "property", "value")
    said = F.transform(F.filter("attrs", lambda a: a["k"].isin(STYLE_ATTRIBUTES)), lambda a, i: entry(3, i, a["k"], a["v"]))
    decl = F.transform(F.split(F.coalesce(attr("style"), F.lit("")), ";"), lambda x, i: entry(4, i, F.trim(F.split_part(x, F.lit(":"), F.lit(1))), F.trim(F.split_part(x, F.lit(":"), F.lit(2)))))
    own = nodes.select("doc", "node", F.inline(F.concat(said, F.filter(decl, lambda e: (e["property"] != "") & (e["value"] != "")))))
    return ruled.unionByName(own).groupBy("doc", "node", "property").agg(F.max_by("value", F.struct("source", "place")).alias("value"))


def computed_styles(nodes: DataFrame, declared: DataFrame, properties: list[str]) -> DataFrame:
    """(doc, node, property, value): the value that holds at each element, its own or that of the nearest ancestor that says one; null if none does."""
    points = nodes.select("doc", "node", F.explode(F.array(*[F.lit(p) for p in properties])).alias("property"))
    spans = declared.filter(F.col("property").isin(properties)).join(nodes.select("doc", "node", "last"), ["doc", "node"]).select("doc", "property", "node", "last", "value")
    return innermost(points, spans, ["doc", "property"], rows=len(properties) * nodes.count())


# Matrices are structs (a, b, c, d, e, f): x' = a x + c y + e, y' = b x + d y + f.


def matrix(*values: Column | float) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast("double").alias(k) for k, v in zip(MATRIX, values, strict=True)])


def times(m: Column, n: Column) -> Column:
    return matrix(
        m["a"] * n["a"] + m["c"] * n["b"], m["b"] * n["a"] + m["d"] * n["b"], m["a"] * n["c"] + m["c"] * n["d"], m["b"] * n["c"] + m["d"] * n["d"],
        m["a"] * n["e"] + m["c"] * n["f"] + m["e"], m["b"] * n["e"] + m["d"] * n["f"] + m["f"],
    )


def parse_transform(text: Column) -> Column:
    """A transform list as one matrix, the identity if there is none. A number that is missing or is none counts as its default."""

    unit = matrix(1.0, 0.0, 0.0, 1.0, 0.0, 0.0)

    def read(item: Column) -> Column:
        args = F.transform(F.filter(F.split(F.regexp_extract(item, r"\(([^)]*)\)", 1), r"[\s,]+"), lambda x: x != ""), lambda x: x.try_cast("double"))
        return F.struct(F.regexp_extract(item, r"^(\w+)", 1).alias("name"), args.alias("args"))

    def one(item: Column) -> Column:
        name, args = item["name"], item["args"]
        a = lambda i, default=0.0: F.coalesce(F.try_element_at(args, F.lit(i)), F.lit(default))
        c, s, t = F.cos(F.radians(a(1))), F.sin(F.radians(a(1))), F.tan(F.radians(a(1)))
        p, q = (F.when(F.size(args) == 3, a(i)).otherwise(0.0) for i in (2, 3))
        return (
            F.when(name == "matrix", F.when(F.size(args) == 6, matrix(*[a(i) for i in range(1, 7)])).otherwise(unit))
            .when(name == "translate", matrix(1.0, 0.0, 0.0, 1.0, a(1), a(2)))
            .when(name == "scale", matrix(a(1, 1.0), 0.0, 0.0, F.coalesce(F.try_element_at(args, F.lit(2)), a(1, 1.0)), 0.0, 0.0))
            .when(name == "rotate", matrix(c, s, -s, c, p - c * p + s * q, q - s * p - c * q))
            .when(name == "skewX", matrix(1.0, 0.0, t, 1.0, 0.0, 0.0))
            .otherwise(matrix(1.0, t, 0.0, 1.0, 0.0, 0.0))
        )

    # each step is an array of its own, so that no expression is repeated inside the next
    items = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?:matrix|translate|scale|rotate|skewX|skewY)\s*\([^)]*\)"), F.lit(0)), read)
    return F.aggregate(F.transform(items, one), unit, times)


def root_products(nodes: DataFrame) -> DataFrame:
    """nodes(doc, node, parent, m) -> (doc, node, m): the product of the matrices from the root down to each node.

    By pointer doubling: each round multiplies a node's product with that of the node where it ends and jumps there, so
    the rounds are logarithmic in the depth. Each round is written.
    """
    at = saved(nodes.select("doc", "node", F.col("parent").alias("up"), "m"), "products")
    while not at.filter("up is not null").isEmpty():
        above = at.select("doc", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("m").alias("_m"))
        done, rest = at.filter("up is null"), at.filter("up is not null").join(above, ["doc", "up"])
        at = saved(done.unionByName(rest.select("doc", "node", F.col("_up").alias("up"), times(F.col("_m"), F.col("m")).alias("m"))), "products")
    return at.select("doc", "node", "m")


def with_uses(nodes: DataFrame, most: int = MOST_USES) -> DataFrame:
    """nodes -> (doc, copy, node, parent, ...): the drawing's elements and the copies that its use elements make.

    copy 0 is the drawing itself, without templates (definitions, symbols, masks, ...) and what is in them. A use
    element draws the element whose id it names, with all below it, under itself: its parent matrix is followed by the
    use's x and y. Copies may hold use elements again, up to ``most`` deep. Copies are numbered by a hash of the uses
    that lead to them; a use of an id that is not there draws nothing. Of equal ids the last one counts.
    """
    href = F.regexp_replace(F.coalesce(attr("href"), attr("xlink:href"), F.lit("")), "^#", "")
    n = nodes.withColumn("href", F.when(F.col("tag") == "use", href))
    inside = innermost(n.select("doc", "node"), n.filter(F.col("tag").isin(TEMPLATE_TAGS)).select("doc", "node", "last", F.lit(True).alias("value")), ["doc"])
    drawn = n.join(inside.filter("value is null").select("doc", "node"), ["doc", "node"])
    now = saved(drawn.select("doc", F.lit(0).cast("long").alias("copy"), *[c for c in n.columns if c != "doc"], F.lit(None).cast("struct<copy:long,node:int>").alias("under")), "drawn")
    named = n.withColumn("id", attr("id")).filter("id <> ''").groupBy("doc", "id").agg(F.max_by(F.struct("node", "last"), "node").alias("t"))
    wanted = n.filter("href <> ''").select("doc", F.col("href").alias("id")).distinct().join(named, ["doc", "id"]).select("doc", "id", F.col("t.node").alias("top"), F.col("t.last").alias("end"))
    # the nodes of each element that is used, once for all uses; templates are not drawn, not even where they are used
    part = n.join(wanted, "doc").filter((F.col("node") >= F.col("top")) & (F.col("node") <= F.col("end")))
    hidden = innermost(part.select("doc", "id", "node"), part.filter(F.col("tag").isin(TEMPLATE_TAGS)).select("doc", "id", "node", "last", F.lit(True).alias("value")), ["doc", "id"]).filter("value is not null")
    part = saved(part.join(hidden.select("doc", "id", "node"), ["doc", "id", "node"], "left_anti"), "used")
    every = now
    for _ in range(most):
        uses = now.filter("href <> ''").select("doc", F.col("href").alias("id"), F.struct("copy", "node").alias("under"))
        nxt = part.join(uses, ["doc", "id"]).withColumn("copy", F.xxhash64("under"))
        now = saved(nxt.select("doc", "copy", *[F.when(F.col("node") != F.col("top"), F.col("parent")).alias("parent") if c == "parent" else c for c in n.columns if c != "doc"], F.when(F.col("node") == F.col("top"), F.col("under")).alias("under")), "copies")
        if now.isEmpty():
            break
        every = every.unionByName(now)
    return every


def placed(drawn: DataFrame) -> DataFrame:
    """What with_uses gives -> (doc, copy, node, m): each element's matrix on the drawing, copies under their uses."""
    offset = matrix(1.0, 0.0, 0.0, 1.0, *[F.coalesce(attr(c).try_cast("double"), F.lit(0.0)) for c in "xy"])
    name = lambda c, n: F.struct(F.col(c).alias("copy"), F.col(n).alias("node"))
    own = drawn.select("doc", name("copy", "node").alias("node"), F.when(F.col("under").isNotNull(), F.col("under")).when(F.col("parent").isNotNull(), name("copy", "parent")).alias("up"), "under", F.when(attr("transform").isNotNull(), parse_transform(attr("transform"))).otherwise(matrix(1.0, 0.0, 0.0, 1.0, 0.0, 0.0)).alias("own"))
    shift = drawn.filter("tag = 'use'").select("doc", name("copy", "node").alias("under"), offset.alias("off"))
    own = saved(own.join(shift, ["doc", "under"], "left"), "placing")
    m = F.when(F.col("off").isNotNull(), times(F.col("off"), F.col("own"))).otherwise(F.col("own"))
    return root_products(own.select("doc", "node", F.col("up").alias("parent"), m.alias("m"))).select("doc", "node.copy", "node.node", "m")
