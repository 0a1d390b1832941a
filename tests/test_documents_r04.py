"""Drawings read whole: the same rows as by windows over their elements, and nothing written or shuffled on the way (F3, F5)."""

import random

import pytest
from pyspark.sql import functions as F

from netloom.operators import documents, drawing, markup
from netloom.plans import drawings

ODD = [
    "", "no markup < at all", "<svg/>", "<g><line x2='1'/></g>", "<svg viewBox='1 2 3'><line x2='3'/></svg>", "</g><svg viewBox=' 1,2 x 4 '><g><line x1='1e1' x2='nan' y1='  7 ' y2='5d'/></svg></g>tail",
    "<svg><style>.a{stroke:red;stroke-width:2px}.a,.b{stroke:BLUE} #q{stroke-dasharray:1 2}{} .c{visibility:hidden</style><g class='a  b' stroke-width='3%'><path d='M0 0L1 1' class='c'/><path id='q' d='m1 1z m2 2 3 3zl1 1 2 2'/></g></svg>",
    "<svg><style><![CDATA[.a{stroke:#1&amp;}]]> .a{stroke : x:y ; }</style><line class='a' x2='&#49;&#x32;' style='stroke-width:2;stroke: ;display'/><path d='5 M1 1T3 3 4 4q1 2 3 4t1 1s1 1 2 2M1A0 1 0 0 0 1 1a2 3 0 1 1 4 4 5e0'/></svg>",
    '<svg viewBox="5 5 10 10"><defs><g id="a" transform="translate(1 0)rotate(30 1 2)"><line x2="1"/><use href="#b" x="10"/></g><symbol id="s"><line/></symbol><line id="b" x2="2" transform="scale(2)skewX(9)"/></defs><use xlink:href="#a" x="100" y="7"/><g display="none"><line x2="9"/><use href="#a"/></g><use href="#s"/><use href="#gone"/><title><line/></title><g id="loop" transform="translate(10)"><line x2="3"/><use href="#loop"/></g><sodipodi:x><line/></sodipodi:x></svg>',
    '<svg><path d="M10 0A10 10 0 0 1 0 10a0 5 0 0 0 3 4"/><path d="M-1 0 A 1 1 0 1 0 1 0"/><circle cx="1" r="2"/><ellipse rx="0" ry="3"/><polygon points="0,0 1,0 1 1 5"/><polyline points="x 1 2"/><circle/></svg>',
]


def made(rng):
    num = lambda: rng.choice(["1", "-2", "3.5", ".5", "10", "-7e-1"])
    path = lambda: "".join(c + ("" if c in "Zz" else " ".join(num() for _ in range(drawing.ARITY[c.upper()] * rng.choice([1, 1, 2])))) for c in rng.choices("MmLlHhVvCcSsQqAaZz", k=rng.randrange(1, 9)))
    out, deep = ["<svg viewBox='1 2 30 40'><style>.k{stroke:#AbC;stroke-width:2px} .d{stroke-dasharray:3}#i2{stroke:none}</style><defs><g id='t'><path d='", path(), "'/></g></defs>"], 1
    for i in range(rng.randrange(2, 14)):
        extra = rng.choice(["", " class='k'", " class='d k'", " stroke='Red'", " display='none'", " style='stroke:blue;stroke-width:.5'", f" transform='{rng.choice(['scale(2)', 'translate(1,2)', 'rotate(40)', 'matrix(1 2 3 4 5 6)'])}'", f" id='i{i % 4}'"])
        what = rng.choice(["g", "g", "path", "line", "use", "end", "symbol"])
        if what == "end":
            out.append("</g>")
        elif what in ("g", "symbol"):
            out.append(f"<{what}{extra}>")
        else:
            out.append({"path": f"<path d='{path()}'{extra}/>", "line": f"<line x1='{num()}' y2='{num()}'{extra}/>", "use": f"<use href='#{rng.choice(['t', 'i1', 'i2'])}' x='{num()}'{extra}/>"}[what])
    return "".join(out)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(11)
    texts = [*ODD, *(made(rng) for _ in range(40)), None]
    return spark.createDataFrame(list(enumerate(texts)), "p long, svg string").repartition(3)


def rows(df, keys):
    return {tuple(r[k] for k in keys): tuple(r[c] for c in sorted(set(df.columns) - set(keys))) for r in df.collect()}


def test_whole_drawings_as_by_windows(spark, docs):
    keys = ["doc", "copy", "node", "poly", "i"]
    nodes = markup.tree(markup.tokens(docs, "p", "svg")).cache()
    got, want = rows(documents.extracted(docs, "p", "svg"), keys), rows(drawing.extracted(nodes), keys)
    assert got.keys() == want.keys() and len(got) > 500
    for k, w in want.items():
        assert all(g == pytest.approx(v, abs=1e-9, rel=1e-9, nan_ok=True) if isinstance(v, float) else g == v for g, v in zip(got[k], w, strict=True)), (k, got[k], w)
    properties = ["stroke", "stroke-width", "display"]
    styles = markup.computed_styles(nodes, markup.declared_styles(nodes, markup.style_rules(nodes)), properties).groupBy("doc", "node").agg(*[F.max(F.when(F.col("property") == p, F.col("value"))).alias(p) for p in properties])
    wide = styles.join(nodes.select("doc", "node", "depth", "tag", markup.attr("id").alias("id")), ["doc", "node"])
    assert rows(documents.styled(docs, "p", "svg", properties), ["doc", "node"]) == rows(wide, ["doc", "node"])
    nodes.unpersist()


@pytest.mark.parametrize("text", ["1", " 1.5e3 ", "1d", "2F", ".5", "5.", ".", "1e", "+3", "- 3", "inf", "-Infinity", "NaN", "1_0", "", "x", "१"])
def test_numbers_as_spark_reads_them(spark, text):
    want = spark.range(1).select(F.lit(text).try_cast("double")).first()[0]
    assert documents.number(text) == pytest.approx(want, nan_ok=True) if want is not None else documents.number(text) is None


@pytest.mark.parametrize("query", [drawings.drawing_shapes, drawings.style_cascade])
def test_elements_are_neither_written_nor_shuffled(spark, data_dir, monkeypatch, query):
    for m in (markup, drawing):
        monkeypatch.setattr(m, "saved", None)
    p = query(spark, data_dir)._jdf.queryExecution().executedPlan().toString()
    assert p.count("Exchange") == 1 and "Join" not in p
