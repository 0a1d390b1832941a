"""Markup and drawings against plain walks over the same texts."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from netloom.functions import text as T
from netloom.operators import drawing, markup


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, t string")


def nodes_of(spark, *texts, void=None):
    return markup.tree(markup.tokens(frame(spark, *texts), "id", "t"), void)


def walked(text, void=()):
    """The tree with a stack: (node, parent, depth, tag, text, last)."""
    stack, out, final = [], {}, None
    for i, tok in enumerate(re.findall(markup.TOKEN, text)):
        if tok.startswith("<![CDATA["):
            if stack:
                out[stack[-1]][4] += tok[9:-3]
        elif tok.startswith("</"):
            if stack:
                out[stack.pop()][5] = i
        elif tok.startswith(("<!", "<?")):
            continue
        elif tok.startswith("<"):
            tag = re.match(r"<([\w:.-]+)", tok)[1]
            alone = tok.endswith("/>") or tag.lower() in void
            out[i] = [i, stack[-1] if stack else None, len(stack), tag, "", i if alone else None]
            if not alone:
                stack.append(i)
        elif not tok.strip():
            continue
        elif stack:
            out[stack[-1]][4] += tok
        final = i
    return sorted(tuple(final if k == 5 and v is None else v for k, v in enumerate(r)) for r in out.values())


def rows(nodes, doc=0):
    return sorted(tuple(r[c] for c in ("node", "parent", "depth", "tag", "text", "last")) for r in nodes.filter(F.col("doc") == doc).collect())


def test_trees_of_any_tokens(spark):
    rng = random.Random(1)
    parts = ["<g>", "<g a='1'>", "</g>", "</other>", "<br>", "<b/>", "text ", " ", "<!-- <g> -->", "<![CDATA[<raw>]]>", "<?x?>", "<!DOCTYPE y>", "a < b", "<broken"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(40)]
    nodes = nodes_of(spark, *texts, void=["br"]).cache()
    for i, t in enumerate(texts):
        assert rows(nodes, i) == walked(t, ["br"]), t
    nodes.unpersist()


def test_odd_documents(spark):
    nodes = nodes_of(spark, None, "", "no markup", "</a></b>", "<a>open", "<!-- never closed <a>")
    assert {r["doc"] for r in nodes.collect()} == {4, 5} and rows(nodes, 4) == [(0, None, 0, "a", "open", 1)]


def test_entities(spark):
    df = spark.createDataFrame([("&lt;a&gt; &amp;lt; &#65;&#x1F600;&#xe9; &#0;&#55296;&#99999999999;&unknown; &quot;&apos;",), ("plain",), (None,)], "t string")
    got = [r[0] for r in df.select(T.decode_entities(F.col("t"))).collect()]
    assert got == ["<a> < A\U0001f600é &#0;&#55296;&#99999999999;&unknown; \"'", "plain", None]
    back = df.select(T.decode_entities(T.encode_entities(F.lit("<&lt; \"é\" & 'x'>")))).first()[0]
    assert back == "<&lt; \"é\" & 'x'>".replace("&lt;", "<")  # names are decoded in turn, as read


def test_a_chain_ten_thousand_deep(spark):
    n = 10_000
    text = "<svg stroke='a'>" + "".join(f"<g id='n{i}'{' stroke=' + chr(34) + 's' + str(i) + chr(34) if i % 1000 == 0 else ''}>" for i in range(n)) + "</g>" * n + "</svg>"
    nodes = nodes_of(spark, text).cache()
    styles = markup.computed_styles(nodes, markup.declared_styles(nodes, markup.style_rules(nodes)), ["stroke", "fill"])
    got = {(r["node"], r["property"]): r["value"] for r in styles.collect()}
    assert len(got) == 2 * (n + 1) and got[0, "stroke"] == "a" and all(got[i + 1, "stroke"] == f"s{i // 1000 * 1000}" and got[i + 1, "fill"] is None for i in range(n))
    at = markup.root_products(nodes.select("doc", "node", "parent", markup.matrix(1.0, 0.0, 0.0, 1.0, F.lit(1.0), F.col("depth").cast("double")).alias("m"))).filter(F.col("node") == n).first()["m"]
    assert (at["e"], at["f"]) == (n + 1, n * (n + 1) / 2)
    nodes.unpersist()


def test_cascade_order(spark):
    css = ".a{fill:1;stroke:1} .b{fill:2} #i{fill:3} .a{stroke:4} .a,.c{dash:5} .x{fill:none-of-these}"
    text = f"<svg><style>{css}</style><g class='b a'><p class='a b' /><q id='i' class='c'/><r id='i' fill='7'/><s id='i' fill='7' style='fill: 8 ; nothing; stroke:'/></g></svg>"
    nodes = nodes_of(spark, text)
    got = markup.computed_styles(nodes, markup.declared_styles(nodes, markup.style_rules(nodes)), ["fill", "stroke", "dash"]).join(nodes.select("node", "tag"), "node")
    want = {"g": ("1", "4", "5"), "p": ("2", "4", "5"), "q": ("3", "4", "5"), "r": ("7", "4", "5"), "s": ("8", "4", "5"), "svg": (None,) * 3, "style": (None,) * 3}
    assert {(r["tag"], r["property"]): r["value"] for r in got.collect()} == {(t, p): v for t, vs in want.items() for p, v in zip(("fill", "stroke", "dash"), vs, strict=True)}


@pytest.mark.parametrize(("text", "want"), [
    (None, (1, 0, 0, 1, 0, 0)), ("nonsense(3)", (1, 0, 0, 1, 0, 0)), ("matrix(1 2,3 4 5 6)", (1, 2, 3, 4, 5, 6)), ("matrix(1 2)", (1, 0, 0, 1, 0, 0)), ("translate(3)", (1, 0, 0, 1, 3, 0)), ("scale(2)", (2, 0, 0, 2, 0, 0)),
    ("translate(1,2) scale(2 3)", (2, 0, 0, 3, 1, 2)), ("rotate(90)", (0, 1, -1, 0, 0, 0)), ("rotate(90 1 1)", (0, 1, -1, 0, 2, 0)), ("skewX(45)skewY(0)", (1, 0, 1, 1, 0, 0)), ("scale(x)", (1, 0, 0, 1, 0, 0)),
])
def test_transform_lists(spark, text, want):
    got = spark.range(1).select(markup.parse_transform(F.lit(text).cast("string")).alias("m")).first()["m"]
    assert tuple(got) == pytest.approx(want, abs=1e-12)


def test_uses_of_uses_and_hidden_parts(spark):
    text = """<svg viewBox="5 5 10 10"><defs><g id="a" transform="translate(1 0)"><line x2="1"/><use href="#b" x="10"/></g><symbol id="s"><line/></symbol><line id="b" x2="2" transform="scale(2)"/></defs>
    <use xlink:href="#a" x="100" y="7"/><g display="none"><line x2="9"/></g><g visibility="hidden"><use href="#a"/></g><use href="#s"/><use href="#gone"/><title><line/></title>
    <g id="loop" transform="translate(1000)"><line x2="3"/><use href="#loop"/></g></svg>"""
    got = drawing.extracted(nodes_of(spark, text)).filter("i = 1").collect()
    ends = sorted((round(r["x"], 6), round(r["y"], 6)) for r in got)
    chain = [(-5 + 3 + 1000.0 * k, -5.0) for k in range(1, 8)]  # the element itself, and six uses within uses
    assert ends == sorted([(100 + 1 + 1 - 5.0, 2.0), (100 + 1 + 10 + 4 - 5.0, 2.0), *chain])


def traced(d):
    """The polylines of a path, by walking its commands."""
    out, cur, x, y, sx, sy, px, py, prev = [], [], 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, ""
    toks = re.findall(r"[a-zA-Z]|-?\d*\.?\d+(?:[eE][-+]?\d+)?", d)
    i, cmd = 0, ""

    def curve(*c):
        n = max(2, min(24, math.ceil(sum(math.dist(c[2 * k : 2 * k + 2], c[2 * k + 2 : 2 * k + 4]) for k in range(3)) / 1.5)))
        for k in range(1, n + 1):
            t = k / n
            u = 1 - t
            cur.append(tuple(u**3 * c[a] + 3 * u * u * t * c[2 + a] + 3 * u * t * t * c[4 + a] + t**3 * c[6 + a] for a in (0, 1)))

    while i < len(toks):
        if toks[i].isalpha():
            cmd = toks[i]
            i += 1
            if cmd in "Zz":
                if len(cur) > 1:
                    out.append([*cur, cur[0]])
                cur, x, y, prev = [], sx, sy, "Z"
                continue
        n = drawing.ARITY[cmd.upper()]
        v = [float(t) for t in toks[i : i + n]]
        i += n
        ox, oy = (x, y) if cmd.islower() else (0.0, 0.0)
        up = cmd.upper()
        if up == "M":
            x, y = ox + v[0], oy + v[1]
            if len(cur) > 1:
                out.append(cur)
            cur, sx, sy = [(x, y)], x, y
            cmd = "l" if cmd == "m" else "L"
        elif up == "L":
            x, y = ox + v[0], oy + v[1]
            cur.append((x, y))
        elif up == "H":
            x = ox + v[0]
            cur.append((x, y))
        elif up == "V":
            y = oy + v[0]
            cur.append((x, y))
        else:
            w = [a + (ox if k % 2 == 0 else oy) for k, a in enumerate(v)]
            if up == "C":
                curve(x, y, *w)
                px, py = w[2:4]
            elif up == "S":
                curve(x, y, *((2 * x - px, 2 * y - py) if prev in ("C", "S") else (x, y)), *w)
                px, py = w[0:2]
            elif up == "Q":
                curve(x, y, x + 2 / 3 * (w[0] - x), y + 2 / 3 * (w[1] - y), w[2] + 2 / 3 * (w[0] - w[2]), w[3] + 2 / 3 * (w[1] - w[3]), w[2], w[3])
            x, y = w[-2:]
        prev = up
    if len(cur) > 1:
        out.append(cur)
    return out


def test_paths_against_a_walk(spark):
    rng = random.Random(3)
    num = lambda: rng.choice(["1", "-2", "3.5", ".5", "10", "-7e-1"])
    paths = ["M0 0L10 0H20v5z l1 1 2 2m3 3 4 4", "m1 1z m2 2z m3 3l1 1", ""]
    for _ in range(40):
        d = "M" + num() + " " + num()
        for _ in range(rng.randrange(1, 12)):
            c = rng.choice("MmLlHhVvCcSsQqZz")
            d += c + ("" if c in "Zz" else " ".join(num() for _ in range(drawing.ARITY[c.upper()] * rng.choice([1, 1, 2]))))
        paths.append(d)
    df = spark.createDataFrame(list(enumerate(paths)), "p long, d string").withColumn("m", markup.matrix(1.0, 0.0, 0.0, 1.0, 0.0, 0.0))
    got = {}
    for r in drawing.path_points(df, ["p"]).orderBy("p", "poly", "i").collect():
        got.setdefault(r["p"], {}).setdefault(r["poly"], []).append((r["x"], r["y"]))
    for i, d in enumerate(paths):
        want = traced(d)
        mine = list(got.get(i, {}).values())
        assert len(mine) == len(want), d
        for a, b in zip(mine, want, strict=True):
            assert [c for p in a for c in p] == pytest.approx([c for p in b for c in p], abs=1e-9), d


def test_arcs_and_rings(spark):
    text = '<svg><path d="M10 0A10 10 0 0 1 0 10"/><path d="M0 0a0 5 0 0 0 3 4"/><path d="M-1 0 A 1 1 0 1 0 1 0"/><circle cx="1" r="2"/><ellipse rx="0" ry="3"/><polygon points="0,0 1,0 1 1 5"/><polyline points="x 1"/></svg>'
    got = drawing.extracted(nodes_of(spark, text)).orderBy("node", "i").collect()
    by = {}
    for r in got:
        by.setdefault(r["node"], []).append((r["x"], r["y"]))
    arc, flat, half, ring, polygon, single = by.values()
    assert all(math.hypot(*p) == pytest.approx(10) and p[0] > -1e-9 and p[1] > -1e-9 for p in arc) and arc[-1] == pytest.approx((0, 10))
    assert flat == [(0, 0), (3, 4)] and len(ring) == 97 and all(math.dist(p, (1, 0)) == pytest.approx(2) for p in ring)
    assert all(math.hypot(*p) == pytest.approx(1) for p in half) and max(p[1] for p in half) > 0.8 and polygon == [(0, 0), (1, 0), (1, 1), (0, 0)] and single == [(0, 1)]


def test_collected_text_and_first(spark):
    nodes = nodes_of(spark, "<ul><li>a <b>b</b> c</li><li>d<i>x</i><b>e<b>f</b></b></li></ul>")
    tags = {r["node"]: r["tag"] for r in nodes.collect()}
    got = sorted((tags[r["node"]], r["text"]) for r in markup.collected_text(nodes, ["b"]).collect())
    assert got == [("i", "x"), ("li", "a c b"), ("li", "d e f"), ("ul", "")]
    assert sum(r["first"] is None for r in markup.first_within(nodes, "i").collect()) == len(tags) - 3
