import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from netloom.llm import chat, decontam, html_text, language_id, line_dedup, mixing, near_dedup, quality, queries, substring_dedup, token_counts
from netloom.llm.common import n_words

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(spark):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(k for k in queries.ORACLES if int(k[2:].split("_")[0]) <= 10))  # the others' tests are in files of their own
def test_query_against_sql(name, same):
    same(queries.QUERIES[name], queries.ORACLES[name])


# 1: quality rules


def counts(text):
    w, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    rep = {p + k for v in at.values() if len(v) > 1 for p in v for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(rep)


def test_quality_counts_and_verdict(spark):
    got = {r["doc_id"]: r for r in queries.op1_quality_rules(spark, DATA).collect()}
    for i, t in texts(spark):
        want = counts(t)
        assert tuple(got[i][c] for c in quality.BASE) == want
        assert got[i]["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert got[i]["kept"] == (not got[i]["base_failed"] and got[i]["quality"] >= 0.5)


def test_quality_agrees_with_labels(spark):
    d = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op1_quality_rules(spark, d).collect()}
    labels = spark.read.parquet(f"{d}/labels.parquet").collect()
    good = [got[r["doc_id"]] for r in labels if r["quality"] == 1]
    bad = [got[r["doc_id"]] for r in labels if r["quality"] == 0]
    assert sum(r["kept"] for r in bad) <= 0.05 * len(bad)
    assert all(r["kept"] for r in good if not r["base_failed"])


def test_quality_estimates_match_plain_em(spark):
    """The same estimation in plain Python over single documents."""
    import math

    names = ["vote_a", "vote_b", "vote_c"]
    votes = [(1, 1, 1)] * 60 + [(-1, -1, 0)] * 12 + [(1, -1, -1)] * 5 + [(0, 1, -1)] * 3
    model = quality.fit(spark.createDataFrame(votes, "vote_a int, vote_b int, vote_c int"), names, rounds=6)
    good, acc = quality.START_GOOD, {k: quality.START_ACCURACY for k in range(3)}
    for _ in range(6):
        ps = []
        for v in votes:
            o = math.log(good / (1 - good))
            for k, x in enumerate(v):
                g, b = acc[k]
                o += math.log(g / (1 - b)) if x > 0 else math.log((1 - g) / b) if x < 0 else 0
            ps.append(1 / (1 + math.exp(-o)))
        own, n = quality.PRIOR * len(votes), len(votes)
        new = {}
        for k in range(3):
            up, down = (sum(p for p, v in zip(ps, votes) if v[k] == s) for s in (1, -1))
            up_b, down_b = (sum(1 - p for p, v in zip(ps, votes) if v[k] == s) for s in (1, -1))
            new[k] = quality._accuracy((up + 0.98 * own) / (up + down + own), (down_b + 0.5 * own) / (up_b + down_b + own))
        good, acc = min(quality.MOST, max(0.5, sum(ps) / n)), new
    for k, name in enumerate(names):
        assert model["accuracy"][name] == pytest.approx(acc[k], abs=2e-3)
    assert model["good"] == pytest.approx(good, abs=2e-3)


def test_quality_long_texts_and_clashing_columns(spark, odd):
    rows = [(1, "the cat and the dog sat on a mat with many other words\n" * 40_000), (1, " ".join(f"word{i} of that" for i in range(100_000)) + "."), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"kept": F.lit("x"), "quality": F.lit(1)})
    got = sorted(quality.judge(df, ["doc_id"]).collect(), key=lambda r: r["n_words"])
    assert [r["n_words"] for r in got] == [0, 300_000, 520_000] and got[2]["base_failed"] and got[2]["n_dup_lines"] == 39_999 and not got[1]["base_failed"]
    with pytest.raises(ValueError):
        quality.judge(df, ["doc_id", "kept"])


def test_quality_odd_rows(odd, nothing):
    got = quality.judge(odd.select("doc_id", "text"), ["doc_id"]).collect()
    assert len(got) == 9 and all(not r["kept"] for r in got if r["n_words"] < 10)
    assert quality.judge(nothing, ["doc_id"]).count() == 0


# 2: near-dedup


def groups(rows, k=5):
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_against_all_pairs(spark):
    base = [f"w{j * 7 % 83} x{j}" for j in range(40)]
    rows = texts(spark)[:60]
    for i in range(50):  # a family with more and more edits
        w = " ".join(base).split()
        for e in range(i // 6):
            w[(i * 13 + e * 29) % len(w)] = f"edit{i}{e}"
        rows.append((1000 + i, " ".join(w)))
    for i in range(30):  # one passage, different ends
        rows.append((2000 + i, " ".join(base[:12]) + " " + " ".join(f"own{i}{j}" for j in range(24))))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), small=4).collect()
    want = groups(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def family(n, words, edits, seed):
    """Copies of one text with random edits: many pairs are just above or just below the threshold."""
    pick = random.Random(seed)
    rows = []
    for i in range(n):
        w = [f"w{j}" for j in range(words)]
        for at in pick.sample(range(words), pick.randint(0, edits)):
            w[at] = f"edit{pick.randrange(4)}at{at}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("small", [near_dedup.SMALL, 16])
def test_near_duplicates_of_a_large_family_against_all_pairs(spark, small):
    rows = family(500, 120, 11, 3)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), small=small).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == groups(rows)


def groups_by_matrix(rows, k=5):
    """As groups, for families: common shingles of all pairs by a matrix product."""
    import numpy as np

    sets = [{tuple(w[j : j + k]) for j in range(len(w) - k + 1)} for w in (t.split() for _, t in rows)]
    name = {g: n for n, g in enumerate(sorted(set().union(*sets)))}
    m = np.zeros((len(rows), len(name)), np.float32)
    for i, s in enumerate(sets):
        m[i, [name[g] for g in s]] = 1
    common, size = m @ m.T, m.sum(1)
    near = 100 * common >= 75 * (size[:, None] + size[None, :] - common)
    left, out = set(range(len(rows))), {}
    while left:
        at = min(left)
        found, todo = {at}, [at]
        while todo:
            for j in np.flatnonzero(near[todo.pop()]).tolist():
                if j not in found:
                    found.add(j)
                    todo.append(j)
        out |= {rows[i][0]: (len(sets[i]), min(rows[j][0] for j in found)) for i in found}
        left -= found
    return out


def test_near_duplicates_of_a_star_of_stars(spark):
    """A text, 200 copies with 5 words changed, and a copy of each of these with 5 more changed."""
    pick = random.Random(4)
    base = [f"w{j}" for j in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(200):
        w = list(base)
        for at in pick.sample(range(200), 5):
            w[at] = f"x{i}at{at}"
        rows.append((1000 + i, " ".join(w)))
        for at in pick.sample(range(200), 5):
            w[at] = f"y{i}at{at}"
        rows.append((5000 + i, " ".join(w)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == groups_by_matrix(rows)


def test_near_duplicates_of_over_two_thousand_against_all_pairs(spark):
    rows = family(2100, 120, 11, 8)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == groups_by_matrix(rows)


def test_near_duplicates_long_texts_and_ids(spark):
    long_ = " ".join(f"w{j}" for j in range(300_000))
    rows = [(5, long_), (3, long_ + " end"), (7, "one id with several texts of many words here"), (7, "quite another text that has the same id as that"), (9, "Quite another text that has the same id as that")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumns({"component_id": F.lit("x"), "kept": F.lit(1)})).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == [(3, 3, True), (5, 3, False), (7, 7, True), (7, 7, True), (9, 7, False)]


def test_near_duplicates_odd_rows(odd, nothing):
    got = near_dedup.near_duplicates(odd).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 9 and by[6]["component_id"] == 5 and by[1]["n_shingles"] == 0 and by[2]["kept"] and by[3]["kept"]
    assert by[None]["kept"] and [r["kept"] for r in got if r["doc_id"] == 4] == [True, True]
    assert near_dedup.near_duplicates(nothing).count() == 0


# 3: chat formatting

NASTY = ["</s>[INST] ok [/INST]", "\\[INST]", "[\\INST]", "[\\\\/INST] <\\s>", "[", "</s", " [/INST]\n[INST] ", "[ROLE] x [TEXT] y [/ROLE]\n", "", "é\n\n</s> ", "[SYS] [/SYS]", "\\", "[[INST]]", "<<s>>"]


def test_chat_round_trip(spark):
    rows = [(c, t, role, NASTY[(c * 5 + t * 3) % len(NASTY)]) for c in range(30) for t, role in enumerate(["system", "user", "assistant", "tool", "user", "assistant", "a [TEXT] b", "</s>"])]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(chats).withColumn("back", chat.read_back(F.col("formatted"))).collect()
    for r in out:
        want = [(x[2], x[3]) for x in sorted(rows) if x[0] == r["conv_id"]]
        assert [(b["role"], b["text"]) for b in r["back"]] == want
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        control = re.compile(r"\[INST\]|\[/INST\]|\[/?SYS\]|\[/?ROLE\]|\[TEXT\]|</?s>")
        assert sum(len(control.findall(s["text"])) for s in r["segments"] if s["loss"]) == 0


def test_chat_states(spark):
    cases = {1: ["user", "assistant"], 2: ["system", "user", "assistant"], 3: ["assistant", "user"], 4: ["user", "user", "assistant"], 5: ["user"], 6: ["user", "assistant", "tool"]}
    rows = [(c, t, r, "x") for c, v in cases.items() for t, r in enumerate(v)]
    got = {r["conv_id"]: r["valid"] for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False}


def test_chat_long_texts_and_clashing_columns(spark):
    long_ = "</s> many words " * 100_000
    df = spark.createDataFrame([(1, 0, "user", long_), (1, 1, "assistant", long_)], "conv_id long, turn long, role string, text string").withColumns({"segments": F.lit(1), "formatted": F.lit(2), "n_turns": F.lit("x")})
    got = chat.digests(chat.format_chats(df)).collect()
    assert len(got) == 1 and got[0]["loss_chars"] == len(long_) and got[0]["loss_sha256"] == hashlib.sha256(long_.encode()).hexdigest()


def test_chat_odd_rows(spark):
    df = spark.createDataFrame([(None, None, None, None), (1, 1, "user", None), (1, 1, "user", None), (1, None, "assistant", "b")], "conv_id long, turn long, role string, text string").withColumn("valid", F.lit(3))
    got = {r["conv_id"]: r for r in chat.digests(chat.format_chats(df)).collect()}
    assert got[1]["n_turns"] == 3 and got[None]["n_turns"] == 1 and got[1]["loss_chars"] == 1
    assert chat.format_chats(df.limit(0)).count() == 0


# 4: HTML


def test_html_layout():
    page = "<title>no</title><h1>A &amp; B</h1><p>one <b>two</b><p>three<br>four<ul><li>x<ul><li>y</ul><li>z</ul><ol start=3><li>p<li>q</ol>"
    page += "<table><tr><th>Name<th>Qty<tr><td>fig<td>3</table><div hidden>no</div><p style='display: none'>no</p><script>'</p>no'</script><pre>a\n  b</pre>end"
    assert html_text.render(page)[0] == "A & B\n\none two\n\nthree\nfour\n\n- x\n  - y\n- z\n\n3. p\n4. q\n\nName | Qty\nfig  | 3\n\na\n  b\n\nend"


def test_html_keeps_all_visible_words(spark):
    rows = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    got = {r["page_id"]: r for r in queries.op4_html_extraction(spark, DATA).collect()}
    import html

    for r in rows:
        bare = re.sub(r"(?s)<head>.*?</head>|<!--.*?-->|<!DOCTYPE[^>]*>|</?a[ >][^>]*>|</a>|<script.*?</script>", " ", r["html"])
        want = Counter(html.unescape(re.sub(r"</?(?:p|li|ul|h1|div|br|article|footer|nav|body|html)[^>]*>", " ", bare)).replace("<b>", "").replace("</b>", "").split())
        shown = Counter(re.sub(r"(?m)^\s*- ", "", got[r["page_id"]]["text"]).split())
        missing = want - shown
        assert not {w for w in missing if "<" not in w and ">" not in w}, (r["page_id"], missing)


def test_html_visibility_is_told_by_attributes():
    for shown in ('class="hidden md:block"', 'class="a hidden b"', 'title="The hidden lake"', 'data-type="hidden"', "title='style=display:none'", 'data-style="display:none"', "aria-hidden=true", 'style="display:none;display:block"', """style="font-family:'display:none'" """, 'title="a hidden'):
        assert html_text.render(f"<p>a</p><div {shown}>text</div>")[0] == "a\n\ntext", shown
    for unseen in ("hidden", "HIDDEN=''", "class=x hidden", """style="font-family:'x';display:none" """, "style=display:none", 'style="Visibility : HIDDEN !important; visibility: visible"', "style='color:red;/* ; */display:none'"):
        assert html_text.render(f"<p>a</p><div {unseen}>text</div>")[0] == "a", unseen


def test_html_tables():
    t = html_text.render
    assert t("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>")[0] == "a | b\n  | c"
    assert t("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td colspan=2>wide cell<td>d</table>")[0] == "a | b\n  | c\nwide cell | d"
    assert t("<table><tr><td>a<td colspan=2>b<tr><td>c<td>d<td>e</table>")[0] == "a | b\nc | d | e"
    assert t("<table><tr><td>one<br>two<td>x<tr><td>three<td>y</table>")[0] == "one   | x\ntwo   |\nthree | y"
    long_ = " ".join(f"w{k}" for k in range(60))
    got = t(f"<table><tr><td>{long_}<td>x<tr><td>short<td>y</table>")[0].split("\n")
    assert len({s.index("|") for s in got}) == 1 and " ".join(s.split("|")[0].strip() for s in got) == long_ + " short" and [s.split("|")[1].strip() for s in got if s.split("|")[1].strip()] == ["x", "y"]
    assert t(f"<table><tr><td>{long_}</table>")[0] == long_


def test_html_style_sheets():
    t = lambda css, body: html_text.render(f"<head><style>{css}</style></head>{body}")[0]
    assert t(".h{display:none}", "<p class='a h'>no<p class=hh>yes") == "yes"
    assert t("#x , .y.z{ color:red; DISPLAY : none }", "<p id=x>no<p class=y>yes<p class='z y'>no") == "yes"
    assert t("p{display:none} p.s{display:block}", "<p>no<p class=s>yes") == "yes"
    assert t("p.s{display:none!important} p.s{display:block}", "<p class=s style='display:block'>no<p>yes") == "yes"
    assert t("@media print{p{display:none}} div p{display:none} /* p{display:none} */", "<div><p>yes</div>") == "yes"
    assert t(".v{visibility:hidden}", "<div class=v>no <b style='visibility:visible'>yes</b> no</div>") == "yes"
    assert t(".v{display:none}", "<div class=v>no <b style='display:block'>no</b></div>yes") == "yes"
    assert html_text.render("<div hidden style='display:block'>yes</div>")[0] == "yes"
    assert html_text.render("<ul><li style='visibility:hidden'>no<li>yes</ul>")[0] == "- yes"


def visible_words(page):
    """A second renderer, by the standard library's parser, without layout: the words that are shown, in order. For pages whose elements are all closed."""
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.open, self.out = [], []

        def handle_starttag(self, tag, attrs):
            a = dict(attrs)
            style = (a.get("style") or "").replace(" ", "").lower()
            if tag not in html_text.VOID:
                hides = tag in html_text.UNSEEN or "hidden" in a or "display:none" in style or "hide" in (a.get("class") or "").split()
                self.open.append((tag, hides or bool(self.open and self.open[-1][1])))
            if tag not in ("b", "i", "a", "span", "em", "u", "code"):
                self.out.append(" ")

        def handle_endtag(self, tag):
            if tag in [t for t, _ in self.open]:
                while self.open.pop()[0] != tag:
                    pass
            if tag not in ("b", "i", "a", "span", "em", "u", "code"):
                self.out.append(" ")

        def handle_data(self, data):
            if not (self.open and self.open[-1][1]):
                self.out.append(data)

    p = Words()
    p.feed(page)
    p.close()
    return "".join(p.out).split()


def test_html_against_a_second_renderer():
    pick = random.Random(9)

    def block(depth):
        kind = pick.choice(["p", "div", "ul", "ol", "table", "h2", "pre", "section"] if depth < 4 else ["p"])
        attrs = pick.choice(["", "", "", "", " hidden", " style='display: none'", " class='x hide'", " title='hidden > display:none'", " class='hidden'"])
        if kind in ("p", "h2", "pre"):
            words = [pick.choice(["<b>{}</b>", "{}", "<a href='?x=hidden'>{}</a>", "{}&amp;{}", "<span hidden>{}</span>", "{} &lt;"]).replace("{}", f"w{pick.randrange(10**6)}") for _ in range(pick.randint(0, 6))]
            return f"<{kind}{attrs}>{' '.join(words)}</{kind}>"
        if kind in ("ul", "ol"):
            return f"<{kind}{attrs}>" + "".join(f"<li>w{pick.randrange(10**6)} {block(depth + 1) if pick.random() < 0.4 else ''}</li>" for _ in range(pick.randint(0, 4))) + f"</{kind}>"
        if kind == "table":
            return f"<table{attrs}>" + "".join("<tr>" + "".join(f"<td{pick.choice(['', ' rowspan=2', ' colspan=3'])}>w{pick.randrange(10**6)} {block(depth + 1) if pick.random() < 0.2 else ''}</td>" for _ in range(pick.randint(1, 4))) + "</tr>" for _ in range(pick.randint(1, 4))) + "</table>"
        return f"<{kind}{attrs}>" + "".join(block(depth + 1) for _ in range(pick.randint(0, 4))) + f"</{kind}>"

    for _ in range(150):
        page = "<html><head><title>t</title><style>.hide{display:none}</style></head><body>" + "".join(block(0) for _ in range(6)) + "</body></html>"
        marks = lambda x: x in ("|", "-") or re.fullmatch(r"\d+\.", x)
        got, want = [w for w in html_text.render(page)[0].split() if not marks(w)], visible_words(page)
        assert Counter(got) == Counter(want)
        if "<table" not in page:
            assert got == want


def test_html_pages_against_a_second_renderer(spark):
    from html.parser import HTMLParser

    assert HTMLParser
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        page = re.sub(r"(?is)<style.*?</style>", "", r["html"] or "")
        marks = lambda x: x in ("|", "-") or re.fullmatch(r"\d+\.", x)
        missing = Counter(w for w in visible_words(page) if not marks(w)) - Counter(html_text.render(page)[0].split())
        assert not {w for w in missing if "<" not in w and ">" not in w}, r["page_id"]


def test_html_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "<p>x"), (3, "<" * 2000), (3, "</td></p></b>"), (4, "<div>" * 3000 + "deep"), (5, "<table><td>a<table><tr><td>b</table>"), (6, "a < b <i x='")], "page_id long, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(df.withColumn("text", F.lit("z"))).collect()}
    assert got[1] == "" and got[2] == "" and got[None] == "x" and got[4] == "deep" and "b" in got[5] and got[6].startswith("a < b")
    assert html_text.extract_text(df.limit(0)).count() == 0


# 5: decontamination


def test_decontamination_finds_new_numbers_and_names(spark):
    item = "On Monday the farmer Alice bought 12 kg of apples and gave 5 kg to Bob who ate them with Carol in the old garden"
    docs = [
        (1, "Intro words here. " + item + ". The end."),
        (2, item.replace("Alice", "Zoe").replace("12", "40").replace("Bob", "Max").replace("5 kg", "9 kg")),
        (3, "Quite another text about apples and a garden that shares few words with it."),
        (4, None), (None, item), (5, item.upper() + "?"),
    ]
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item), (8, None), (9, "too short")], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 7), (2, 7), (None, 7)}


def test_decontamination_checks_slots(spark):
    item = "Say that Alice met Bob and then Alice saw Bob near where Alice lives with Bob now"
    mixed = "Say that Xu met Yan and then Zoe saw Max near where Kim lives with Lou now"
    renamed = "Say that Xu met Yan and then Xu saw Yan near where Xu lives with Yan now"
    got = decontam.contaminated(spark.createDataFrame([(1, mixed), (2, renamed)], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == {2}


def test_decontamination_of_dense_and_short_items(spark):
    items = [(1, "Compute 12 + 34 * 56 - 78 / 9 + 10."), (2, "What is 17 times 24?"), (3, "Solve 3x + 5 = 20."), (4, "A train goes 60 km in 2 h and 90 km in 3 h; how far is it from here"), (5, "Why?"), (6, None)]
    docs = [(10 * i, f"Some words before it here. {t} And some after.") for i, t in items if t] + [(91, "Compute 1 + 2 * 3 - 4 / 5 + 6."), (92, "what is 17 times 25"), (93, "A train goes 70 km in 4 h and 95 km in 5 h; how far is it from here"), (94, "1 2 3 4 5 6 7 8 9 10 11 12")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {(10, 1), (20, 2), (30, 3), (40, 4)} or got == {(10, 1), (20, 2), (30, 3), (40, 4), (93, 4)}
    assert {r["item_id"] for r in decontam.unfindable(bench).collect()} == {5, 6}


def test_decontamination_checks_slots_both_ways(spark):
    item = "Say that Alice met Bob and then Alice saw Bob near where Alice lives with Bob now"
    merged = "Say that Xu met Xu and then Xu saw Xu near where Xu lives with Xu now"
    numbers = "Take some 12 red balls and some 5 blue balls from the old box under the bed"
    equal = "Take some 7 red balls and some 7 blue balls from the old box under the bed"
    got = decontam.contaminated(spark.createDataFrame([(1, merged), (2, equal)], "doc_id long, text string"), spark.createDataFrame([(1, item), (2, numbers)], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(2, 2)}


def test_decontamination_of_long_texts_and_clashing_columns(spark, odd):
    item = "On Monday the farmer Alice bought 12 kg of apples and gave 5 kg to Bob who ate them with Carol in the old garden"
    docs = spark.createDataFrame([(1, "filler words go on " * 100_000 + item), (1, "a second text of that id")], "doc_id long, text string").withColumns({"item_id": F.lit(1), "h": F.lit(2), "shift": F.lit(3), "n_windows": F.lit("x")})
    bench = spark.createDataFrame([(7, item, 1)], "item_id long, text string, doc_id long")
    assert [(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench).collect()] == [(1, 7)]
    left = decontam.drop_contaminated(docs, bench).collect()
    assert [r["text"] for r in left] == ["a second text of that id"] and left[0]["n_windows"] == "x"


def test_decontamination_by_shuffle_gives_the_same(spark):
    d, b = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    rows = [sorted(map(tuple, decontam.contaminated(d, b, broadcast_rows=n).collect())) for n in (10**6, 0)]
    assert rows[0] == rows[1] and rows[0]


def test_decontamination_odd_rows(odd, nothing, spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(odd, bench).count() == 0 and decontam.contaminated(nothing, bench).count() == 0
    assert decontam.drop_contaminated(odd, bench).count() == 9


# 6: mixing


def test_mixing_near_targets(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))).alias("source"), (F.col("id") * 7919 % 400 + 1).alias("size"))
    got = mixing.mix(docs).toPandas()
    by = got.groupby("source").agg(t=("target", "first"), k=("taken", "sum"), s=("source_size", "first"))
    assert ((by.k / by.t - 1).abs() < 0.02).all()
    assert abs(by.t.sum() - by.s.sum()) < 1e-6 * by.s.sum() and (by.t <= 3 * by.s + 1e-6).all()
    assert (got.taken <= 3 * got["size"]).all()
    again = mixing.mix(docs.repartition(7)).toPandas()
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()


def test_mixing_caps_are_reshared(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), (None, 90)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert got == {"a": 30.0, None: 270.0, "b": pytest.approx(800.0)}


def test_mixing_long_texts_repeated_ids_and_clashing_columns(spark):
    rows = [(1, "w " * 500_000, "a"), (1, "w x", "a"), (1, "w x", "a"), (None, None, None), (None, "w", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", n_words(F.col("text"))).withColumns({"n": F.lit(1), "target_": F.lit(2), "copies_": F.lit(3)})
    got = mixing.mix(df).collect()
    assert len(got) == 5 and all(r["taken"] <= 3 * r["size"] for r in got) and {r["source_size"] for r in got} == {500_004, 1}


def test_mixing_odd_rows(odd, nothing):
    got = mixing.mix(odd.withColumn("size", n_words(F.col("text")))).collect()
    assert len(got) == 9 and all(r["taken"] <= 3 * r["size"] for r in got)
    assert mixing.mix(nothing.withColumn("size", n_words(F.col("text")))).count() == 0


# 7: substring dedup


def cut(rows, n=35, sort=True):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = {j + k for j in range(len(w) - n + 1) if seen[tuple(w[j : j + n])] > 1 for k in range(n)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out) if sort else out


@pytest.mark.parametrize("most_blocks", [substring_dedup.MOST_BLOCKS, 1])
def test_substrings_against_brute_force(spark, monkeypatch, most_blocks):
    monkeypatch.setattr(substring_dedup, "MOST_BLOCKS", most_blocks)
    monkeypatch.setattr(substring_dedup, "HELD", 1 << 22 if most_blocks > 1 else 100)
    passage = " ".join(f"p{j}" for j in range(60))
    rows = texts(spark)[:40] + [(9000 + i, f"a{i} b{i} {passage} c{i}") for i in range(6)] + [(9100, "Und " * 100), (9101, passage + " " + passage), (9102, " ".join(passage.split()[:34]))]
    rows += [(9103, " ".join(f"long{j}" for j in range(400_000)) + " " + passage), (9100, passage + " other text of that id"), (None, passage)]
    got = substring_dedup.remove_repeated_windows(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((r["doc_id"] or -1), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == sorted((i or -1, *x) for i, *x in cut(rows, sort=False))


def test_a_saturated_sketch_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "cells_for", lambda *a: substring_dedup.BLOCK)
    rows = texts(spark)
    got = substring_dedup.remove_repeated_windows(spark.createDataFrame(rows, "doc_id long, text string"), with_text=False).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == cut(rows)


def test_the_sketch_filters_at_any_size(spark):
    """Minimizers that pass are few where nothing repeats, with ten times the text in ten times the cells."""
    assert all(n / 16 <= substring_dedup.cells_for(n) < n / 8 for n in (10**8, 10**11, 10**14))
    for n in (40, 400):
        rows = [(i, " ".join(f"{i}w{j * 31 % 5000}x{j}" for j in range(1000))) for i in range(n)]
        keyed = substring_dedup.with_key(spark.createDataFrame(rows, "doc_id long, text string"))
        n_bytes = sum(len(t) for _, t in rows)
        passed = substring_dedup.repeated_minimizers(keyed, 35, 8, substring_dedup.cells_for(n_bytes)).count()
        assert passed < 0.03 * n * 1000 * 2 / 29


def test_substrings_odd_rows(odd, nothing, spark):
    got = substring_dedup.remove_repeated_windows(odd).collect()
    assert len(got) == 9 and all(r["n_removed"] == 0 for r in got)
    twice = spark.createDataFrame([(1, " ".join(map(str, range(50))))] * 2, "doc_id long, text string")
    assert [r["n_removed"] for r in substring_dedup.remove_repeated_windows(twice).collect()] == [50, 50]
    assert substring_dedup.remove_repeated_windows(nothing).count() == 0


# 8: token counts


def test_token_counts_equal_the_library(spark):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    rows = texts(spark) + [(-i, t) for i, t in enumerate(["", None, " ", "  a  b ", "▁x▁ </s> <s>y", "a\n\n  b\t c\r", "日本 語　", "🙂 é ﬁ", "x" * 3000, "\x00\x01 z", "   ", "▁▁ ▁"], 1)]
    got = {r["doc_id"]: r for r in token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        n = len(sp.encode(t or ""))
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 4096), repr(t)[:50]


def test_token_counts_long_texts_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a word " * 400_000), (1, "b")], "doc_id long, text string").withColumns({"n_tokens": F.lit("x"), "n_bytes": F.lit("y")})
    a, b = token_counts.token_counts(df).collect()
    assert a["n_bytes"] == 2_800_000 and a["n_tokens"] >= 800_000 and a["over_limit"] and b["n_bytes"] == 1


def test_token_counts_odd_rows(odd, nothing):
    assert token_counts.token_counts(odd).count() == 9 and token_counts.token_counts(nothing).count() == 0


# 9: language ids


def test_language_accuracy_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = [r for r in queries.op9_language_id(spark, d).collect() if r["held_out"]]
    assert len(got) > 200
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in got) >= 0.95 * len(got)
    sure = [r for r in got if not r["rejected"]]
    assert len(sure) >= 0.8 * len(got) and sum(r["lang_pred"] == lang[r["doc_id"]] for r in sure) >= 0.97 * len(sure)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_never_learns_from_held_out_rows(spark):
    import zlib

    rows = [(i, f"text{i} the and of", "en") for i in range(60)]
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    learned = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").filter(f"{language_id.LEARNED_IF} <> 1"))["en"].decode()
    assert held and learned.count("text") == 60 - len(held)


def test_language_learns_whole_texts_until_full(spark):
    name = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    short = [(i, f"s{name(i)}z " * 500, "en") for i in range(400)]
    long_ = [(1000 + i, f"l{name(i)}z " * 9000, "xx") for i in range(9)]
    got = language_id.fit(spark.createDataFrame(short + long_ + [(2000, "one text", "yy")], "doc_id long, text string, lang string"))
    for k, rows in (("en", short), ("xx", long_)):
        n = {i: got[k].count(language_id.normal(t.split()[0]) + b" ") for i, t, _ in rows}
        assert all(n[i] in (0, len(t.split())) for i, t, _ in rows) and sum(len(t) for i, t, _ in rows if n[i]) >= language_id.DICTIONARY
    assert got["yy"] == b"one text"
    assert len(got["en"]) < 2 * language_id.DICTIONARY


def test_language_long_texts_and_clashing_columns(spark, odd):
    df = spark.createDataFrame([(1, "the cat and the dog " * 200_000), (1, "der Hund und die Katze")], "doc_id long, text string").withColumns({"held_out": F.lit("x"), "score": F.lit("y")})
    got = language_id.predict_language(df, {"en": b"the cat and the dog sat", "de": b"der Hund und die Katze sind"}).collect()
    assert [r["lang_pred"] for r in got] == ["en", "de"]


def test_language_odd_rows(odd, nothing):
    got = {r["doc_id"]: r for r in language_id.identify_languages(odd).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[3]["lang_pred"] == "und" and got[7]["lang_pred"] != "und"
    assert language_id.identify_languages(nothing).count() == 0
    assert {r["lang_pred"] for r in language_id.predict_language(odd, {}).collect()} == {"und"}


# 10: line dedup


def test_lines_later_copies_go(spark):
    run = "a\nb\nc\nd"
    rows = [(1, f"x\n{run}\ny"), (2, f"{run}\n\nz"), (3, "a\nb"), (4, "one two three four five\nq\none two three four five"), (5, "one two three four five")]
    got = {r["doc_id"]: (r["text"], r["__nl_removed"]) for r in line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (rows[0][1], 0) and got[2] == ("\nz", 4) and got[3] == ("a\nb", 0) and got[4] == ("one two three four five\nq", 1) and got[5] == ("", 1)


def runs_by_sorting(rows, least=4):
    """Maximal runs from a suffix array of sorted Python lists. Lines are ordered by first appearance: which neighbours a run gets depends on that order, its length and ends do not."""
    where = [(i, [(n, x) for n, x in enumerate(t.split("\n")) if WORD.search(x)]) for i, t in rows]
    seen = Counter(x for _, ls in where for _, x in ls)
    suffixes = []
    for i, ls in where:
        for at in range(len(ls)):
            end = at
            while end < len(ls) and seen[ls[end][1]] > 1:
                end += 1
            if end > at:
                before = ls[at - 1][1] if at and seen[ls[at - 1][1]] > 1 else None
                suffixes.append(([x for _, x in ls[at:end]], before, i, ls[at][0]))
    suffixes.sort(key=lambda s: (s[0], s[2], s[3]))
    longest = Counter()
    for a, b in zip(suffixes, suffixes[1:]):
        n = next((k for k, (x, y) in enumerate(zip(a[0], b[0])) if x != y), min(len(a[0]), len(b[0])))
        if n >= least:
            for s in (a, b):
                longest[(s[2], s[3])] = max(n, longest[(s[2], s[3])])
    return longest, {(s[2], s[3]): s for s in suffixes}


def test_a_run_is_one_row(spark):
    rows, want = [], set()
    for n in (4, 5, 7, 8, 31, 64, 100):
        run = [f"line {k} of {n}" for k in range(n)]
        rows += [(10 * n, "\n".join(["x", *run, "y"])), (10 * n + 1, "\n".join([*run, "", f"z {n}"])), (10 * n + 2, "\n".join([f"q {n}", "", *run[:3]]))]
        want.add((n, frozenset({(10 * n, 1), (10 * n + 1, 0)})))
    got = line_dedup.repeated_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["n_lines"], frozenset({(r["doc_id"], r["line"]), (r["other_id"], r["other_line"])})) for r in got} == want and len(got) == len(want)


def test_runs_against_a_sorted_suffix_array(spark):
    pick = random.Random(5)
    pool = [[f"l{k}" for k in pick.sample(range(40), pick.randint(1, 30))] for _ in range(12)]
    rows = []
    for i in range(60):
        ls = []
        for _ in range(pick.randint(1, 4)):
            p = pool[pick.randrange(12)]
            a = pick.randrange(len(p))
            ls += p[a : a + pick.randint(1, 30)] + (["", f"own {i}"] if pick.random() < 0.5 else ["same"] * pick.randint(0, 6))
        rows.append((i, "\n".join(ls)))
    rows += [(100, "same\n" * 70), (101, "same\n" * 33)]
    got = line_dedup.repeated_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    longest, suffix = runs_by_sorting(rows)
    for r in got:
        a, b = suffix[(r["doc_id"], r["line"])], suffix[(r["other_id"], r["other_line"])]
        n = next((k for k, (x, y) in enumerate(zip(a[0], b[0])) if x != y), min(len(a[0]), len(b[0])))
        assert n == r["n_lines"] and (a[1] is None or a[1] != b[1])
    # the longest run of each document, and of each first place of a run, is among the rows
    for i in {i for i, _ in longest}:
        assert max(n for (d, _), n in longest.items() if d == i) == max(r["n_lines"] for r in got if i in (r["doc_id"], r["other_id"]))


def test_lines_clashing_columns_long_texts_and_ids(spark, odd):
    got = line_dedup.drop_repeated_lines(odd.withColumns({"line": F.lit(1), "n": F.lit(2), "r": F.lit(3), "id": F.lit(4), "a.b": F.lit(5), "long": F.lit(6)}))
    assert got.columns[:8] == [*odd.columns] and got.count() == 9 and "a.b" in got.columns
    long_ = "\n".join(f"words of line number {k} here" for k in range(30_000))
    rows = [(1, long_), (1, "other words of one id\nx"), (2, "y\n" + long_ + "\nend of it all now ok")]
    by = {(r["doc_id"], r["__nl_lines"]): r for r in line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert by[(1, 30_000)]["__nl_removed"] == 0 and by[(2, 30_002)]["__nl_removed"] == 30_000 and by[(2, 30_002)]["__nl_longest"] == 30_000
    assert by[(2, 30_002)]["text"] == "y\nend of it all now ok" and by[(1, 2)]["__nl_longest"] == 0


def test_lines_odd_rows(odd, nothing):
    got = line_dedup.drop_repeated_lines(odd).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 9 and by[1]["text"] is None and by[2]["text"] == "" and by[6]["__nl_removed"] == 1 and [r["__nl_removed"] for r in got if r["doc_id"] == 4] == [0, 0]
    assert line_dedup.drop_repeated_lines(nothing).count() == 0


def test_words_built_to_collide_are_told_apart(spark):
    """Words on which every polynomial modulo 2^64 fails: no window repeats, and 26 of 36 shingles are no link."""
    turn = lambda n, a, b: "".join((a, b)[bin(i).count("1") % 2] for i in range(n))
    for n in (128, 1024):
        same = " ".join(f"w{i}" for i in range(34))
        docs = spark.createDataFrame([(i, f"{same[:60]} {turn(n, *ab)} {same[60:]}") for i, ab in enumerate(("ab", "ba"))], "doc_id long, text string")
        assert [r["n_removed"] for r in substring_dedup.remove_repeated_windows(docs, with_text=False).collect()] == [0, 0]
        assert all(r["kept"] for r in near_dedup.near_duplicates(docs).collect())


def test_html_broken_and_large_pages_in_linear_time():
    import time

    began = time.time()
    assert html_text.render("<style>" + "p .x b, " * 130_000)[0] == ""
    assert html_text.render("<style>" + "{" * 300_000 + "</style>shown")[0] == "shown"
    assert html_text.render("<style " * 100_000)[0].startswith("<style")
    assert html_text.render("<div>" * 100_000 + "deep")[0] == "deep"
    page = "<style>" + "".join(f".c{i}{{display:none}}" for i in range(10_000)) + "</style>" + "".join(f"<p class='c{i}'>gone</p><p class='d{i}'>p{i}</p>" for i in range(10_000))
    assert html_text.render(page)[0].split() == [f"p{i}" for i in range(10_000)]
    assert time.time() - began < 15


def test_html_drawings_formulas_dialogs_and_details():
    got = html_text.render("<p>a <svg><title>no</title><desc>no</desc><defs><text>no</text></defs><text>b</text></svg> <math><mi>x</mi><mo>=</mo><mn>1</mn></math></p><dialog>no</dialog><dialog open>c</dialog><details>no<p>no</p><summary>d</summary><b>no</b></details><details open><summary>e</summary>f</details>")[0]
    assert got.split() == ["a", "b", "x=1", "c", "d", "e", "f"]


def test_lines_without_runs_are_cut_alike(spark, odd):
    """Rounds that deletion does not read change no text."""
    for docs in (spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text"), odd.select("doc_id", "text")):
        full, short = (sorted(map(repr, line_dedup.drop_repeated_lines(docs, with_longest=x).select("doc_id", "text", "__nl_lines", "__nl_removed").collect())) for x in (True, False))
        assert full == short
