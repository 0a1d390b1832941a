import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from netloom.llm import importance, queries

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, longest):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) for k in range(1, longest + 1) for i in range(len(w) - k + 1))


def plain(docs, target, longest=1, buckets=10_000, percent=10, least=20):
    """The same in plain Python: (id, features, weight, score, rank) by row."""
    own = [(i, *features(t, longest)) for i, t in docs]
    s, t = Counter(), Counter()
    for into, rows in ((s, [f for *_, f in own]), (t, [features(x, longest)[1] for x in target])):
        for f in rows:
            for c, n in f.items():
                into[c % buckets] += n
    big_s, big_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = {b: math.floor(1000 * math.log(float(t[b] + 1) * big_s / (float(s[b] + 1) * big_t))) for b in s}
    rows = []
    for i, n_words, f in own:
        weight = sum(n * gain[c % buckets] for c, n in f.items())
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n_words])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in rows]


def compare(got, want):
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)


TEXTS = ["Alpha beta-GAMMA 42 delta", "été ÉTÉ x_y 日本 語 \x00nul", "q" * 500 + " tail", "a a a b b c"]


@pytest.mark.parametrize(("longest", "buckets", "percent", "least"), [(1, 10_000, 10, 20), (1, 7, 100, 1), (3, 50, 40, 2), (2, 10_000, 0, 0)])
def test_against_plain_python(spark, longest, buckets, percent, least):
    docs = [(i, " ".join(TEXTS[(i * k) % 4] for k in range(i % 9))) for i in range(60)] + [(61, None), (62, ""), (63, "-- ..")]
    target = ["alpha beta 42", None, "日本 b b"]
    got = importance.resample(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame([(x, 1) for x in target], "text string, doc_id int"), longest, buckets, percent, least
    )
    compare(got, plain(docs, target, longest, buckets, percent, least))


def test_importance_odd_rows(odd, nothing, spark):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    clash = odd.withColumns({"rank": F.lit("r"), "weight": F.lit(0), "score": F.lit(1), "n_features": F.lit(2), "bucket": F.lit(3)})
    target = spark.createDataFrame([("a b c",)], "text string")
    compare(importance.resample(clash, target, percent=50, least_words=1), plain(docs, ["a b c"], percent=50, least=1))
    compare(importance.resample(clash, target.limit(0)), plain(docs, []))
    assert importance.resample(nothing, target).count() == 0
    assert importance.resample(nothing, target.limit(0)).columns == ["doc_id", "n_features", "weight", "score", "rank"]


def test_importance_long_text_and_ties(spark):
    long = " ".join(f"w{i % 977}" for i in range(400_000)) + " " + "z" * 300_000
    docs = [(1, long), (2, "x " * 30), (2, "x " * 30), (None, "x " * 30), (None, "y " * 30), (3, "y " * 30)]
    got = importance.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("x",)], "text string"), percent=70)
    compare(got, plain(docs, ["x"], percent=70))


def test_the_draw_leans_to_the_target(spark):
    """Documents of the target's words are drawn, others hardly."""
    docs = [(i, ("apple pear plum " if i % 4 == 0 else "iron zinc lead ") * 10) for i in range(400)]
    got = importance.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("apple plum " * 50,)], "text string"), percent=20).filter("rank is not null").collect()
    assert len(got) == 80 and all(r["doc_id"] % 4 == 0 for r in got)


def test_importance_query_against_sql(spark, duck, data_dir):
    got = queries.op13_importance_resampling(spark, data_dir)
    compare(got, duck.sql(f"SELECT {', '.join(got.columns)} FROM ({importance.ORACLE})").fetchall())
