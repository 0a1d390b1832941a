"""Shapes of drawings as point sequences, with windows over commands: (path, poly, i, x, y).

A path's commands move a point by relative and absolute steps. Where it stands
after each is a running sum that begins anew at every absolute step, so no
command waits for the one before it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import markup
from .shared import dealt, saved

# Numbers that each path command takes, points of a ring, bounds of the pieces of a curve and of an arc, and the length of a piece.
ARITY = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6, "S": 4, "Q": 4, "A": 7}
RING, CURVE_PIECES, ARC_PIECES, PIECE = 96, (2, 24), (2, 48), 1.5
#: Characters of a path for each of its letters and numbers, about; tells how many tasks it needs.
NUMBER_CHARS = 2
#: Which numbers are the step along x and along y (from 1; none where a command has none).
STEPS = {"M": (1, 2), "L": (1, 2), "H": (1, None), "V": (None, 1), "C": (5, 6), "S": (3, 4), "Q": (3, 4), "A": (6, 7)}


def scale_of(m: Column) -> Column:
    return F.sqrt(F.abs(m["a"] * m["d"] - m["b"] * m["c"]))


def _by(column: Column, table: dict, default) -> Column:
    return reduce(lambda acc, kv: acc.when(column == kv[0], F.lit(kv[1])), list(table.items())[1:], F.when(column == list(table)[0], F.lit(list(table.values())[0]))).otherwise(F.lit(default))


def commands(paths: DataFrame, keys: list[str]) -> DataFrame:
    """paths(keys, d) -> (keys, at, cmd, args): the commands in order; numbers that follow a whole set begin the same command
    again, after M and m the line commands. Unknown letters, and sets that are not complete, are passed over."""
    toks = paths.select(*keys, F.posexplode(F.regexp_extract_all("d", F.lit(r"[a-zA-Z]|-?\d*\.?\d+(?:[eE][-+]?\d+)?"), F.lit(0))).alias("at", "t"))
    upto = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    letter = F.col("t").rlike("^[a-zA-Z]$")
    closes = letter & (F.upper("t") == "Z")
    toks = toks.withColumns({"cmd": F.last(F.when(letter, F.col("t")), ignorenulls=True).over(upto), "from": F.last(F.when(letter, F.col("at")), ignorenulls=True).over(upto)})
    # a close is a set of its own, without numbers
    nums = toks.withColumn("n", _by(F.upper("cmd"), ARITY, 0)).filter((~letter & (F.col("n") > 0)) | closes).withColumn("set", F.when(closes, -1).otherwise(F.floor((F.col("at") - F.col("from") - 1) / F.col("n"))))
    numbers = F.collect_list(F.when(~letter, F.struct("at", "t")))
    sets = nums.groupBy(*keys, "from", "set", "cmd", "n").agg(F.min("at").alias("at"), F.transform(F.array_sort(numbers), lambda x: x["t"].cast("double")).alias("args"))
    again = F.when((F.col("set") > 0) & (F.upper("cmd") == "M"), F.when(F.col("cmd") == "M", "L").otherwise("l")).otherwise(F.col("cmd"))
    return sets.filter(F.size("args") == F.col("n")).select(*keys, "at", again.alias("cmd"), "args")


def positions(cmds: DataFrame, keys: list[str]) -> DataFrame:
    """Adds x, y (the point after each command) and x0, y0 (before it). All windows stay within a path, so commands are shuffled once at most."""
    name, relative = F.upper("cmd"), F.col("cmd") == F.lower("cmd")
    path = Window.partitionBy(*keys).orderBy("at")
    upto = path.rowsBetween(Window.unboundedPreceding, 0)
    since = lambda c: Window.partitionBy(*keys, c).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    each = lambda make: {k: v for a in "xy" for k, v in make(a).items()}
    step = {a: F.coalesce(F.try_element_at("args", _by(name, {k: v[i] for k, v in STEPS.items()}, None).cast("int")), F.lit(0.0)) for i, a in enumerate("xy")}
    moves = {a: _by(name, {k: v[i] is not None for k, v in STEPS.items()}, False) for i, a in enumerate("xy")}
    begins = name.isin("M", "Z")
    out = cmds.withColumns({"_begins": begins} | {f"_step{a}": step[a] for a in "xy"})
    # within a subpath, a place is a sum since the last absolute step, or since the start of the subpath (M and Z stand there)
    out = out.withColumns(each(lambda a: {f"_run{a}": F.sum(F.when(begins | (moves[a] & ~relative), 1).otherwise(0)).over(upto)}))
    out = out.withColumns(each(lambda a: {f"_sum{a}": F.sum(F.when(F.col("_begins"), 0.0).otherwise(F.col(f"_step{a}"))).over(since(f"_run{a}")), f"_free{a}": F.first("_begins").over(since(f"_run{a}"))}))
    # starts of subpaths: absolute, or a step from where the subpath before ended; those that hang on each other are a chain
    out = out.withColumns(each(lambda a: {f"_before{a}": F.coalesce(F.lag(f"_sum{a}").over(path), F.lit(0.0)), f"_linked{a}": relative & F.coalesce(F.lag(f"_free{a}").over(path), F.lit(False))}))
    out = out.withColumns(each(lambda a: {f"_chain{a}": F.sum(F.when((name == "M") & ~F.col(f"_linked{a}"), 1).otherwise(0)).over(upto)}))
    out = out.withColumns(each(lambda a: {f"_start{a}": F.sum(F.when(name == "M", F.col(f"_step{a}") + F.when(relative, F.col(f"_before{a}")).otherwise(0.0)).otherwise(0.0)).over(since(f"_chain{a}"))}))
    out = out.select(*cmds.columns, *[(F.when(F.col(f"_free{a}"), F.col(f"_start{a}")).otherwise(0.0) + F.col(f"_sum{a}")).alias(a) for a in "xy"])
    return out.withColumns({f"{a}0": F.coalesce(F.lag(a).over(path), F.lit(0.0)) for a in "xy"})


def _arcs(at: DataFrame) -> DataFrame:
    """Adds ``arc``: the points of an arc: rx, ry, turn (not used), large, sweep, x, y, on the way from (x0, y0); null for other
    commands, and for arcs without a radius. Each step is a column, so that none is written out again inside the next."""
    a, c = lambda i: F.try_element_at("args", F.lit(i)), F.col
    at = at.withColumn("_arc", (F.upper("cmd") == "A") & (a(1) != 0) & (a(2) != 0))
    steps = lambda df, **cols: df.withColumns({k: F.when(c("_arc"), v) for k, v in cols.items()})
    at = steps(at, _dx=(c("x0") - c("x")) / 2, _dy=(c("y0") - c("y")) / 2)
    at = steps(at, _grown=F.sqrt(F.greatest(F.lit(1.0), c("_dx") * c("_dx") / (a(1) * a(1)) + c("_dy") * c("_dy") / (a(2) * a(2)))))
    at = steps(at, _rx=a(1) * c("_grown"), _ry=a(2) * c("_grown"))
    at = steps(at, _under=c("_rx") * c("_rx") * c("_dy") * c("_dy") + c("_ry") * c("_ry") * c("_dx") * c("_dx"))
    side = F.when(a(4) == a(5), -1.0).otherwise(1.0) * F.sqrt(F.greatest(F.lit(0.0), F.coalesce(F.try_divide(c("_rx") * c("_rx") * c("_ry") * c("_ry") - c("_under"), c("_under")), F.lit(0.0))))
    at = steps(at, _side=side)
    at = steps(at, _cx=c("_side") * c("_rx") * c("_dy") / c("_ry"), _cy=-c("_side") * c("_ry") * c("_dx") / c("_rx"))
    at = steps(at, _ux=(c("_dx") - c("_cx")) / c("_rx"), _uy=(c("_dy") - c("_cy")) / c("_ry"), _vx=(-c("_dx") - c("_cx")) / c("_rx"), _vy=(-c("_dy") - c("_cy")) / c("_ry"))
    angle = lambda ux, uy, vx, vy: F.atan2(ux * vy - uy * vx, ux * vx + uy * vy)
    at = steps(at, _begin=angle(F.lit(1.0), F.lit(0.0), c("_ux"), c("_uy")), _turn=angle(c("_ux"), c("_uy"), c("_vx"), c("_vy")))
    at = steps(at, _turn=F.when((a(5) == 0) & (c("_turn") > 0), c("_turn") - 2 * F.pi()).when((a(5) != 0) & (c("_turn") < 0), c("_turn") + 2 * F.pi()).otherwise(c("_turn")))
    at = steps(at, _pieces=F.greatest(F.lit(ARC_PIECES[0]), F.least(F.lit(ARC_PIECES[1]), F.ceil(F.abs("_turn") * F.greatest("_rx", "_ry") * c("density")).cast("int"))))
    turned = lambda k: c("_begin") + c("_turn") * k / c("_pieces")
    points = F.transform(F.sequence(F.lit(1), c("_pieces")), lambda k: F.struct((c("_cx") + (c("x0") + c("x")) / 2 + c("_rx") * F.cos(turned(k))).alias("x"), (c("_cy") + (c("y0") + c("y")) / 2 + c("_ry") * F.sin(turned(k))).alias("y")))
    return steps(at, arc=points)


def path_points(paths: DataFrame, keys: list[str], piece: float = PIECE) -> DataFrame:
    """paths(keys, d, m) -> (keys, poly, i, x, y): the polylines of paths, curves and arcs cut into pieces of about ``piece``.

    A move or a close begins a new polyline; one with a single point is none. A closed one ends where it began. Smooth
    quadratic curves (T) are passed over, as are unknown letters.
    """
    name, relative = F.upper("cmd"), F.col("cmd") == F.lower("cmd")
    path = Window.partitionBy(*keys).orderBy("at")
    chars = paths.agg(F.coalesce(F.sum(F.length("d")), F.lit(0))).first()[0]
    paths = dealt(paths, keys, chars // NUMBER_CHARS, always=True)
    at = positions(commands(paths, keys), keys).join(paths.select(*keys, "m"), keys).withColumn("density", scale_of(F.col("m")) / piece)
    arg = lambda i, origin: F.try_element_at("args", F.lit(i)) + F.when(relative, F.col(origin)).otherwise(0.0)
    # the second control point of each curve, which a smooth one mirrors
    second = {a: F.when(name == "C", arg(3 + k, f"{a}0")).when(name == "S", arg(1 + k, f"{a}0")) for k, a in enumerate("xy")}
    at = at.withColumns({f"{a}2": second[a] for a in "xy"}).withColumns({f"_{a}2": F.lag(f"{a}2").over(path) for a in "xy"})
    ctl = {}
    for k, a in enumerate("xy"):
        p0, p3, q = F.col(f"{a}0"), F.col(a), arg(1 + k, f"{a}0")
        ctl[f"{a}1"] = F.when(name == "C", q).when(name == "S", F.coalesce(2 * p0 - F.col(f"_{a}2"), p0)).when(name == "Q", p0 + (q - p0) * F.lit(2 / 3))
        ctl[f"{a}2"] = F.when(name == "Q", p3 + (q - p3) * F.lit(2 / 3)).otherwise(F.col(f"{a}2"))
    at = dealt(saved(at.withColumns(ctl), "curves"), keys, chars // NUMBER_CHARS, always=True)  # the expressions above are not repeated in those below
    far = lambda a, b: F.sqrt(F.pow(F.col(f"x{a}") - F.col(f"x{b}"), 2) + F.pow(F.col(f"y{a}") - F.col(f"y{b}"), 2))
    n = F.greatest(F.lit(CURVE_PIECES[0]), F.least(F.lit(CURVE_PIECES[1]), F.ceil((far("1", "0") + far("2", "1") + far("", "2")) * F.col("density")).cast("int")))
    at = _arcs(at.withColumn("n", F.when(name.isin("C", "S", "Q"), n)))

    def curve(k: Column) -> Column:
        t = k / F.col("n")
        u = 1 - t
        return F.struct(*[(u * u * u * F.col(f"{a}0") + 3 * u * u * t * F.col(f"{a}1") + 3 * u * t * t * F.col(f"{a}2") + t * t * t * F.col(a)).alias(a) for a in "xy"])

    pts = F.when(name == "Z", F.array().cast("array<struct<x:double,y:double>>")).when(F.col("arc").isNotNull(), F.col("arc")).when(F.col("n").isNotNull(), F.transform(F.sequence(F.lit(1), F.col("n")), curve)).otherwise(F.array(F.struct("x", "y")))
    upto = path.rowsBetween(Window.unboundedPreceding, 0)
    at = at.withColumn("poly", F.sum(F.when(name.isin("M", "Z"), 1).otherwise(0)).over(upto) - F.when(name == "Z", 1).otherwise(0))
    each = at.select(*keys, "m", "poly", "at", (name == "Z").alias("closes"), F.posexplode_outer(pts).alias("k", "pt"))
    # a close repeats the first point, if there are others
    line = Window.partitionBy(*keys, "poly")
    first = F.first("pt", ignorenulls=True).over(line.orderBy("at", "k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    each = each.withColumns({"_n": F.count("pt").over(line), "_p": F.coalesce("pt", F.when(F.col("closes"), first))}).filter("_p is not null and _n > 1")
    i = F.row_number().over(line.orderBy("at", "k")) - 1
    place = lambda a, c, e: F.col(f"m.{a}") * F.col("_p.x") + F.col(f"m.{c}") * F.col("_p.y") + F.col(f"m.{e}")
    return each.select(*keys, "poly", i.alias("i"), place("a", "c", "e").alias("x"), place("b", "d", "f").alias("y"))


def shape_points(shapes: DataFrame, keys: list[str], piece: float = PIECE) -> DataFrame:
    """shapes(keys, tag, attrs, m) -> (keys, poly, i, x, y) of lines, polylines, polygons, circles, ellipses and paths, on the
    drawing. Numbers that are missing count as 0; rings without a radius, and shapes of other names, have no points."""
    num = lambda *names: F.coalesce(*[markup.attr(c).try_cast("double") for c in names], F.lit(0.0))
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    flat = F.transform(F.filter(F.split(F.coalesce(markup.attr("points"), F.lit("")), r"[\s,]+"), lambda v: v != ""), lambda v: F.coalesce(v.try_cast("double"), F.lit(0.0)))
    pairs = F.when(F.size(flat) > 1, F.transform(F.sequence(F.lit(1), F.floor(F.size(flat) / 2).cast("int")), lambda k: pt(F.element_at(flat, (2 * k - 1).cast("int")), F.element_at(flat, (2 * k).cast("int")))))
    rx, ry = num("rx", "r"), num("ry", "r")
    ring = F.transform(F.sequence(F.lit(0), F.lit(RING)), lambda k: pt(num("cx") + rx * F.cos(2 * F.pi() * k / RING), num("cy") + ry * F.sin(2 * F.pi() * k / RING)))
    points = (
        F.when(F.col("tag") == "line", F.array(pt(num("x1"), num("y1")), pt(num("x2"), num("y2"))))
        .when(F.col("tag") == "polyline", pairs)
        .when(F.col("tag") == "polygon", F.concat(pairs, F.slice(pairs, 1, 1)))
        .when(F.col("tag").isin("circle", "ellipse") & (rx > 0) & (ry > 0), ring)
    )
    simple = shapes.select(*keys, F.lit(1).cast("long").alias("poly"), "m", F.posexplode(points).alias("i", "p"))
    place = lambda a, c, e: F.col(f"m.{a}") * F.col("p.x") + F.col(f"m.{c}") * F.col("p.y") + F.col(f"m.{e}")
    simple = simple.select(*keys, "poly", "i", place("a", "c", "e").alias("x"), place("b", "d", "f").alias("y"))
    return simple.unionByName(path_points(shapes.filter("tag = 'path'").select(*keys, F.coalesce(markup.attr("d"), F.lit("")).alias("d"), "m"), keys, piece))


def extracted(nodes: DataFrame) -> DataFrame:
    """A drawing's elements -> (doc, copy, node, tag, colour, width, poly, i, x, y): what it shows, copies of used elements included.

    Elements that are hidden (display none, visibility hidden), of no drawing (metadata, titles, styles), or in
    templates show nothing, nor does what is below them. Colour is the stroke as written, null if there is none or the
    stroke is dashed; width is the stroke's width times the scale of the element's matrix (1 if none is given). The
    origin of the view box is the origin of the drawing. Copies take the styles of the place where the element stands.
    """
    # styles, and what is shown, are read many times below
    styles = saved(computed_styles_wide(nodes, ["stroke", "stroke-width", "stroke-dasharray", "display", "visibility"]), "styles")
    gone = F.col("tag").isin(markup.SKIPPED_TAGS) | F.col("tag").rlike("^(sodipodi|inkscape)") | (F.col("display") == "none") | (F.col("visibility") == "hidden")
    out = nodes.join(styles, ["doc", "node"]).filter(F.coalesce(gone, F.lit(False)))
    shown = markup.innermost(nodes.select("doc", "node"), out.select("doc", "node", "last", F.lit(True).alias("value")), ["doc"], rows=nodes.count()).filter("value is null")
    drawn = markup.with_uses(saved(nodes.join(shown.select("doc", "node"), ["doc", "node"]), "shown"))
    box = F.transform(F.split(F.trim(F.coalesce(markup.attr("viewBox"), F.lit(""))), r"[\s,]+"), lambda v: v.try_cast("double"))
    base = nodes.filter("tag = 'svg'").groupBy("doc").agg(F.min_by(F.when(F.size(box) == 4, F.struct(F.coalesce(box[0], F.lit(0.0)).alias("x"), F.coalesce(box[1], F.lit(0.0)).alias("y"))), "node").alias("box"))
    at = markup.placed(drawn).join(base, "doc").withColumn("m", markup.times(markup.matrix(1.0, 0.0, 0.0, 1.0, -F.coalesce("box.x", F.lit(0.0)), -F.coalesce("box.y", F.lit(0.0))), F.col("m")))
    keys = ["doc", "copy", "node"]
    shapes = drawn.select(*keys, "tag", "attrs").join(at.select(*keys, "m"), keys).join(styles, ["doc", "node"])
    dashed = F.coalesce(F.col("stroke-dasharray") != "none", F.lit(False))
    colour = F.when(~dashed & ~F.lower("stroke").isin("none", "transparent"), F.lower("stroke"))
    width = F.coalesce(F.regexp_replace("stroke-width", "[a-z%]+$", "").try_cast("double"), F.lit(1.0)) * scale_of(F.col("m"))
    shapes = saved(shapes.select(*keys, "tag", "attrs", "m", colour.alias("colour"), width.alias("width")), "shapes")
    return shape_points(shapes.select(*keys, "tag", "attrs", "m"), keys).join(shapes.select(*keys, "tag", "colour", "width"), keys)


def computed_styles_wide(nodes: DataFrame, properties: list[str]) -> DataFrame:
    """(doc, node, a column for each property)."""
    long = markup.computed_styles(nodes, markup.declared_styles(nodes, markup.style_rules(nodes)), properties)
    return long.groupBy("doc", "node").agg(*[F.max(F.when(F.col("property") == p, F.col("value"))).alias(p) for p in properties])
