"""Drawings read whole, each in one walk with a stack: what ``markup`` and ``drawing`` do by windows over many tables.

A document is the unit that is not split there either. Where a table holds very
many small ones, its elements need not be written, shuffled and joined: a task
holds one document at a time and hands on what it shows. The rules, and the order
of each calculation, are those of the operators of the same names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .drawing import ARC_PIECES, ARITY, CURVE_PIECES, PIECE, RING, STEPS
from .markup import ATTRIBUTE, MOST_USES, SKIPPED_TAGS, STYLE_ATTRIBUTES, TEMPLATE_TAGS, TOKEN

#: Rows handed on at once; distinct start tags, paths and numbers that a task remembers, up to LONG characters each.
ROWS, KEPT, LONG = 20_000, 20_000, 500

_TOKEN, _ATTRIBUTE = re.compile(TOKEN, re.ASCII), re.compile(ATTRIBUTE, re.ASCII)
_NAME, _VALUE, _TAG = re.compile(r"[\w:.-]+", re.ASCII), re.compile(r"""=\s*["'](.*)["']$""", re.ASCII | re.DOTALL), re.compile(r"<([\w:.-]+)", re.ASCII)
_SPACE, _PARTS, _BLOCK = re.compile(r"\s+", re.ASCII), re.compile(r"[\s,]+", re.ASCII), re.compile(r"[^{}]+\{[^}]*\}")
_NUMBER = re.compile(r"[\x00-\x20]*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?[dDfF]?[\x00-\x20]*", re.ASCII)
_SPECIAL = {"inf": math.inf, "+inf": math.inf, "infinity": math.inf, "+infinity": math.inf, "-inf": -math.inf, "-infinity": -math.inf, "nan": math.nan, "+nan": math.nan, "-nan": math.nan}
_TRANSFORM = re.compile(r"(?:matrix|translate|scale|rotate|skewX|skewY)\s*\([^)]*\)", re.ASCII)
_PATH = re.compile(r"[a-zA-Z]|-?\d*\.?\d+(?:[eE][-+]?\d+)?", re.ASCII)
UNIT = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def _kept(fn: Callable) -> Callable:
    """Remembers results of short texts. Functions travel to tasks by value, so a task begins with nothing."""
    known = {}

    def short(text: str, *more):
        if len(text) > LONG:
            return fn(text, *more)
        key = (text, *more)
        found = known.get(key, known)
        if found is known:
            if len(known) >= KEPT:
                known.clear()
            found = known[key] = fn(text, *more)
        return found

    return short


@_kept
def number(text: str) -> float | None:
    """A text as a number, as Spark casts it; null if it is none."""
    if _NUMBER.fullmatch(text):
        return float(text.strip("".join(map(chr, range(33)))).rstrip("dDfF"))
    return _SPECIAL.get(text.strip("".join(map(chr, range(33)))).lower())


def decoded(s: str) -> str:
    for name, to in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        s = s.replace(name, to)
    if "&#" in s:
        for pattern, base in ((r"&#[0-9]+;", 10), (r"&#[xX][0-9a-fA-F]+;", 16)):
            for item in dict.fromkeys(re.findall(pattern, s)):
                n = int(re.search(r"([0-9a-fA-F]+);$", item)[1], base)
                s = s.replace(item, chr(n) if 0 < n <= 0x10FFFF and not 0xD800 <= n <= 0xDFFF else item)
    return s


@_kept
def _start(token: str) -> tuple[str, tuple[tuple[str, str], ...], dict[str, str]]:
    """The name and the attributes of a start tag, in order and by name (the last one of a name)."""
    pairs = tuple((_NAME.match(p)[0], decoded(_VALUE.search(p)[1])) for p in _ATTRIBUTE.findall(token))
    return _TAG.match(token)[1], pairs, dict(pairs)


class Element:
    __slots__ = ("node", "parent", "depth", "tag", "pairs", "attrs", "last", "texts", "styles")

    def __init__(self, node, parent, depth, tag, pairs, attrs):
        self.node, self.parent, self.depth, self.tag, self.pairs, self.attrs, self.last, self.texts = node, parent, depth, tag, pairs, attrs, node, []


def tree(text: str, void: frozenset[str] = frozenset()) -> list[Element]:
    """The elements in document order (``markup.tree``); parent is an element."""
    found, stack, final = [], [], -1
    for at, token in enumerate(_TOKEN.findall(text)):
        if token[0] != "<" or token.startswith("<![CDATA["):
            raw = token[0] == "<"
            if not raw and _SPACE.sub(" ", token).strip(" ") == "":
                continue
            final = at
            if stack:
                stack[-1].texts.append(token[9:-3] if raw else decoded(token))
        elif token[1] == "/":
            final = at
            if stack:
                stack.pop().last = at
        elif token[1] not in "!?":
            final = at
            tag, pairs, attrs = _start(token)
            e = Element(at, stack[-1] if stack else None, len(stack), tag, pairs, attrs)
            found.append(e)
            if not token.endswith("/>") and tag.lower() not in void:
                stack.append(e)
    for e in stack:
        e.last = final
    return found


def css_rules(text: str) -> Iterator[tuple[str, str, str, int]]:
    for i, block in enumerate(_BLOCK.findall(text)):
        head, body = block[: block.index("{")], block[block.rindex("{") + 1 :].rstrip("}")
        entries = [(*(v.strip(" ") for v in d.split(":", 1)), i * 1000 + j) for j, d in enumerate(d for d in body.split(";") if ":" in d)]
        for s in head.split(","):
            yield from ((s.strip(" "), *e) for e in entries)


@_kept
def _inline(style: str) -> tuple[tuple[str, str], ...]:
    parts = ([p.strip(" ") for p in d.split(":")] for d in style.split(";"))
    return tuple((p[0], p[1]) for p in parts if len(p) > 1 and p[0] and p[1])


@_kept
def _sheet(text: str) -> tuple[tuple[str, str, str, int], ...]:
    return tuple(css_rules(text))


def style(elements: list[Element], properties: list[str]) -> None:
    """Sets ``styles`` of each element: the value of each property that holds there (``markup.computed_styles``)."""
    rules: dict[str, dict[str, tuple]] = {}
    for e in elements:
        if e.tag == "style":
            for selector, prop, value, order in _sheet("".join(e.texts)):
                if prop in properties:
                    was = rules.setdefault(selector, {}).get(prop)
                    rules[selector][prop] = value if was is None or order >= was[1][1] or e.node > was[1][0] else was[0], (e.node, order)
    for e in elements:
        own, a = {}, e.attrs
        if "class" in a:
            for c in _SPACE.split(a["class"]):
                if c and f".{c}" in rules:
                    own.update((p, v[0]) for p, v in rules[f".{c}"].items())
        if a.get("id") and f"#{a['id']}" in rules:
            own.update((p, v[0]) for p, v in rules[f"#{a['id']}"].items())
        own.update(p for p in e.pairs if p[0] in properties and p[0] in STYLE_ATTRIBUTES)
        if "style" in a:
            own.update(p for p in _inline(a["style"]) if p[0] in properties)
        above = e.parent.styles if e.parent else {}
        e.styles = above | own if own else above


def times(m: tuple, n: tuple) -> tuple:
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return a * p + c * q, b * p + d * q, a * r + c * s, b * r + d * s, a * t + c * u + e, b * t + d * u + f


@_kept
def transform(text: str) -> tuple:
    """A transform list as one matrix (``markup.parse_transform``)."""
    m = UNIT
    for item in _TRANSFORM.findall(text):
        name, args = re.match(r"\w+", item, re.ASCII)[0], [number(x) for x in _PARTS.split(item[item.index("(") + 1 : item.index(")")]) if x != ""]
        a = lambda i, default=0.0: args[i - 1] if len(args) >= i and args[i - 1] is not None else default  # noqa: B023, E731
        angle = math.radians(a(1))
        if name == "matrix":
            n = tuple(a(i) for i in range(1, 7)) if len(args) == 6 else UNIT
        elif name == "translate":
            n = (1.0, 0.0, 0.0, 1.0, a(1), a(2))
        elif name == "scale":
            second = args[1] if len(args) > 1 and args[1] is not None else a(1, 1.0)
            n = (a(1, 1.0), 0.0, 0.0, second, 0.0, 0.0)
        elif name == "rotate":
            c, s = math.cos(angle), math.sin(angle)
            p, q = (a(2), a(3)) if len(args) == 3 else (0.0, 0.0)
            n = (c, s, -s, c, p - c * p + s * q, q - s * p - c * q)
        else:
            n = (1.0, 0.0, math.tan(angle), 1.0, 0.0, 0.0) if name == "skewX" else (1.0, math.tan(angle), 0.0, 1.0, 0.0, 0.0)
        m = times(m, n)
    return m


def scale_of(m: tuple) -> float:
    return math.sqrt(abs(m[0] * m[3] - m[1] * m[2]))


@_kept
def _commands(d: str) -> list[tuple[str, bool, list[float]]]:
    """(name, relative, numbers) of a path's commands (``drawing.commands``)."""
    found, cmd, n, args, again = [], None, 0, [], False
    for t in _PATH.findall(d):
        if t.isalpha():
            cmd, args, again = t, [], False
            n = ARITY.get(t.upper(), 0)
            if t in "Zz":
                found.append(("Z", t == "z", []))
        elif n:
            args.append(float(t))
            if len(args) == n:
                found.append(("L" if again and cmd in "Mm" else cmd.upper(), cmd.islower(), args))
                args, again = [], True
    return found


def _pieces(length: float, bounds: tuple[int, int]) -> int:
    return bounds[0] if math.isnan(length) else max(bounds[0], math.ceil(min(float(bounds[1]), length)))


def _arc(args: list[float], x0: float, y0: float, x: float, y: float, density: float) -> list[tuple[float, float]]:
    dx, dy = (x0 - x) / 2, (y0 - y) / 2
    grown = math.sqrt(max(1.0, dx * dx / (args[0] * args[0]) + dy * dy / (args[1] * args[1])))
    rx, ry = args[0] * grown, args[1] * grown
    under = rx * rx * dy * dy + ry * ry * dx * dx
    side = (-1.0 if args[3] == args[4] else 1.0) * math.sqrt(max(0.0, (rx * rx * ry * ry - under) / under if under else 0.0))
    cx, cy = side * rx * dy / ry, -side * ry * dx / rx
    ux, uy, vx, vy = (dx - cx) / rx, (dy - cy) / ry, (-dx - cx) / rx, (-dy - cy) / ry
    begin, turn = math.atan2(uy, ux), math.atan2(ux * vy - uy * vx, ux * vx + uy * vy)
    if args[4] == 0 and turn > 0:
        turn -= 2 * math.pi
    elif args[4] != 0 and turn < 0:
        turn += 2 * math.pi
    n = _pieces(abs(turn) * max(rx, ry) * density, ARC_PIECES)
    return [(cx + (x0 + x) / 2 + rx * math.cos(begin + turn * k / n), cy + (y0 + y) / 2 + ry * math.sin(begin + turn * k / n)) for k in range(1, n + 1)]


@_kept
def _lines(d: str, density: float) -> list[tuple[int, list[tuple[float, float]]]]:
    """(poly, points) of a path's polylines, before its matrix (``drawing.positions`` and ``drawing.path_points``)."""
    found, points, poly = [], [], 0
    # along each axis: whether places count from the subpath's start, the sum since, and that start
    free, total, start = [False, False], [0.0, 0.0], [0.0, 0.0]
    p0, second, new = (0.0, 0.0), None, True

    def done() -> None:
        if len(points) > 1:
            found.append((poly, points))

    for name, relative, args in _commands(d):
        at = STEPS.get(name, (None, None))
        for k in (0, 1):
            step = args[at[k] - 1] if at[k] else 0.0
            if name == "M":
                linked, before = relative and free[k], total[k]
                here = step + (before if relative else 0.0)
                start[k] = start[k] + here if linked else here
                free[k], total[k] = True, 0.0
            elif name == "Z":
                free[k], total[k] = True, 0.0
            elif at[k] and not relative:
                free[k], total[k] = False, step
            else:
                total[k] += step
        p = ((start[0] if free[0] else 0.0) + total[0], (start[1] if free[1] else 0.0) + total[1])
        base = p0 if relative else (0.0, 0.0)
        if name == "M":
            done()
            poly, points = poly + 1, [p]
        elif name == "Z":
            if len(points) > 1:
                points.append(points[0])
            done()
            poly, points = poly + 1, []
        elif name in "CSQ":
            q = args[0] + base[0], args[1] + base[1]
            if name == "C":
                c1, c2 = q, (args[2] + base[0], args[3] + base[1])
            elif name == "S":
                c1, c2 = ((2 * p0[0] - second[0], 2 * p0[1] - second[1]) if second else p0), q
            else:
                c1, c2 = (tuple(e[k] + (q[k] - e[k]) * (2 / 3) for k in (0, 1)) for e in (p0, p))
            far = lambda a, b: math.sqrt((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2)
            n = _pieces((far(c1, p0) + far(c2, c1) + far(p, c2)) * density, CURVE_PIECES)
            for i in range(1, n + 1):
                t = i / n
                u = 1 - t
                points.append(tuple(u * u * u * p0[k] + 3 * u * u * t * c1[k] + 3 * u * t * t * c2[k] + t * t * t * p[k] for k in (0, 1)))
        elif name == "A" and args[0] != 0 and args[1] != 0:
            points.extend(_arc(args, *p0, *p, density))
        else:
            points.append(p)
        second = c2 if name in "CS" else None
        p0 = p
    done()
    return found


def _shape(e: Element, m: tuple) -> list[tuple[int, list[tuple[float, float]]]]:
    """(poly, points) that an element shows (``drawing.shape_points``), before its matrix."""
    a, tag = e.attrs, e.tag

    def num(*names: str) -> float:
        return next((v for v in (number(a[n]) for n in names if n in a) if v is not None), 0.0)

    if tag == "path":
        return _lines(a.get("d", ""), scale_of(m) / PIECE)
    if tag == "line":
        return [(1, [(num("x1"), num("y1")), (num("x2"), num("y2"))])]
    if tag in ("polyline", "polygon"):
        flat = [number(v) or 0.0 for v in _PARTS.split(a.get("points", "")) if v != ""]
        pairs = list(zip(flat[::2], flat[1::2], strict=False))
        return [(1, pairs + pairs[:1] if tag == "polygon" else pairs)] if pairs else []
    if tag in ("circle", "ellipse"):
        rx, ry = num("rx", "r"), num("ry", "r")
        if not rx <= 0 and not ry <= 0:
            x, y, n = num("cx"), num("cy"), RING
            return [(1, [(x + rx * math.cos(2 * math.pi * k / n), y + ry * math.sin(2 * math.pi * k / n)) for k in range(n + 1)])]
    return []


def _copy(copy: int, node: int) -> int:
    """The number of the copies that a use makes: Spark's xxhash64 of (copy, node)."""
    p1, p2, p3, p4, p5, low = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, 2**64 - 1
    turn = lambda v, n: (v << n | v >> 64 - n) & low

    def mixed(h: int) -> int:
        h = (h ^ h >> 33) * p2 & low
        h = (h ^ h >> 29) * p3 & low
        return h ^ h >> 32

    h = 42 + p5 + 8 & low
    h = mixed(turn(h ^ turn(copy * p2 & low, 31) * p1 & low, 27) * p1 + p4 & low)
    h = h + p5 + 4 & low
    h = mixed(turn(h ^ (node & 0xFFFFFFFF) * p1 & low, 23) * p2 + p3 & low)
    return h - 2**64 if h >= 2**63 else h


def extract(text: str) -> Iterator[tuple]:
    """(copy, node, tag, colour, width, poly, i, x, y) of all that a drawing shows (``drawing.extracted``)."""
    elements = tree(text)
    first = next((e for e in elements if e.tag == "svg"), None)
    if first is None:
        return
    box = [number(v) or 0.0 for v in _PARTS.split(first.attrs.get("viewBox", "").strip(" "))]
    origin = (1.0, 0.0, 0.0, 1.0, *((-box[0], -box[1]) if len(box) == 4 else (-0.0, -0.0)))
    style(elements, ["stroke", "stroke-width", "stroke-dasharray", "display", "visibility"])
    shown, end = [], -1
    for e in elements:
        if e.node > end and (e.tag in SKIPPED_TAGS or e.tag.startswith(("sodipodi", "inkscape")) or e.styles.get("display") == "none" or e.styles.get("visibility") == "hidden"):
            end = e.last
        if e.node > end:
            shown.append(e)

    def drawn(part: list[Element]) -> list[Element]:
        """Without templates, and what is in them."""
        out, end = [], -1
        for e in part:
            if e.node > end and e.tag in TEMPLATE_TAGS:
                end = e.last
            if e.node > end:
                out.append(e)
        return out

    href = lambda e: re.sub("^#", "", e.attrs.get("href", e.attrs.get("xlink:href", "")))
    named = {e.attrs["id"]: e for e in shown if e.attrs.get("id")}
    parts: dict[str, list[Element]] = {}
    now = [(0, None, UNIT, drawn(shown))]  # copy, its top, the matrix above it, elements
    for depth in range(MOST_USES + 1):
        nxt = []
        for copy, top, above, part in now:
            at = {}
            for e in part:
                own = transform(e.attrs["transform"]) if "transform" in e.attrs else UNIT
                m = times(above, own) if e is top else times(at[e.parent], own) if e.parent else own
                at[e] = m
                if e.tag == "use":
                    to = href(e)
                    if to and to in named and depth < MOST_USES:
                        if to not in parts:
                            t = named[to]
                            parts[to] = drawn([s for s in shown if t.node <= s.node <= t.last])
                        if parts[to]:
                            x, y = (number(e.attrs[c]) if c in e.attrs else None for c in "xy")
                            nxt.append((_copy(copy, e.node), named[to], times(m, (1.0, 0.0, 0.0, 1.0, x or 0.0, y or 0.0)), parts[to]))
                m = times(origin, m)
                lines = _shape(e, m)
                if not lines:
                    continue
                s, colour = e.styles, e.styles.get("stroke")
                if colour is not None:
                    colour = None if s.get("stroke-dasharray", "none") != "none" or colour.lower() in ("none", "transparent") else colour.lower()
                width = number(re.sub("[a-z%]+$", "", s["stroke-width"])) if "stroke-width" in s else None
                width = (1.0 if width is None else width) * scale_of(m)
                a, b, c, d, tx, ty = m
                for poly, points in lines:
                    for i, (x, y) in enumerate(points):
                        yield copy, e.node, e.tag, colour, width, poly, i, a * x + c * y + tx, b * x + d * y + ty
        now = nxt
        if not now:
            break


def _read(docs: DataFrame, doc: str, text: str, each: Callable[[str], Iterator[tuple]], fields: str) -> DataFrame:
    d = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    schema = StructType([d.schema["doc"], *StructType.fromDDL(fields)])
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows = [], []

        def batch() -> pa.RecordBatch:
            columns = [keys, *(zip(*rows, strict=True) if rows else [()] * (len(out) - 1))]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

        for b in batches:
            for key, value in zip(b.column("doc").to_pylist(), b.column("text"), strict=True):
                for row in each(value.as_py() or ""):
                    keys.append(key)
                    rows.append(row)
                    if len(rows) >= ROWS:
                        yield batch()
                        keys, rows = [], []
        yield batch()

    return d.mapInArrow(run, schema)


def extracted(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """docs(doc, text) -> (doc, copy, node, tag, colour, width, poly, i, x, y), as ``drawing.extracted`` of their trees."""
    return _read(docs, doc, text, extract, "copy long, node int, tag string, colour string, width double, poly long, i int, x double, y double")


def styled(docs: DataFrame, doc: str, text: str, properties: list[str]) -> DataFrame:
    """docs(doc, text) -> (doc, node, depth, tag, id, a column for each property): each element with the styles that hold there, as ``markup.computed_styles`` of their trees."""

    def each(value: str) -> Iterator[tuple]:
        elements = tree(value)
        style(elements, properties)
        for e in elements:
            yield e.node, e.depth, e.tag, e.attrs.get("id"), *[e.styles.get(p) for p in properties]

    return _read(docs, doc, text, each, "node int, depth int, tag string, id string, " + ", ".join(f"`{p}` string" for p in properties))
