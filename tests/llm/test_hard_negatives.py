import math
import random

import pytest
from pyspark.sql import functions as F

from netloom.llm import hard_negatives, queries

ROWS = "vec_id long, label int, embedding array<double>"
OUT = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def plain(rows, is_anchor, positives=5, negatives=3, low=50, high=95):
    """Every anchor against every row."""
    took = {(i, y, tuple(math.floor(256 * max(-(2**27), min(2**27, x))) for x in v)) for i, y, v in rows if None not in (i, y, v) and all(x is not None and math.isfinite(x) for x in v)}
    took = {(i, y, tuple(max(-(2**27), min(2**27, x)) for x in v)) for i, y, v in took}
    out = []
    for i, y, v in took:
        if not is_anchor(i):
            continue
        near = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, z) for j, z, w in took)
        for ps, j, _ in [x for x in near if x[2] == y and x[1] != i][:positives]:
            fit = [x for x in near if x[2] != y and low * -ps <= 100 * -x[0] <= high * -ps][:negatives]
            out += [(i, j, r + 1, n, -ps, -s) for r, (s, n, _) in enumerate(fit)]
    return sorted(out)


def got(df):
    assert df.columns == OUT
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("bucket", "chunk", "block"), [(1024, 8, 2048), (8, 2, 16), (5, 1, 3)])
def test_against_all_pairs(spark, bucket, chunk, block):
    """Norms of all sizes, many equal vectors and ties; blocks and buckets of any size give the same."""
    rng = random.Random(5)
    rows = []
    for i in range(400):
        size = rng.choice([0.05, 0.3, 1, 1, 4])
        v = [1.0, 0.5, 0.25, 0.0] if i % 3 == 0 else [rng.gauss(0.3, 1) * size for _ in range(4)]
        rows.append((i, rng.randrange(4), v))
    df = spark.createDataFrame(rows, ROWS).repartition(7)
    want = plain(rows, lambda i: i % 10 == 0)
    assert want and got(hard_negatives.mine(df, F.col("vec_id") % 10 == 0, bucket=bucket, chunk=chunk, block=block)) == want


def test_buckets_below_the_reach_are_not_visited(spark, monkeypatch):
    """With a few long vectors and many short ones, the second round asks for few chunks."""
    seen = []
    real = hard_negatives.scratch

    def watched(df, name):
        out = real(df, name)
        if name in ("visits", "buckets"):
            seen.append((name, out.count()))
        return out

    monkeypatch.setattr(hard_negatives, "scratch", watched)
    rng = random.Random(2)
    rows = [(i, i % 2, [rng.gauss(0, 1) + 1 for _ in range(8)] if i < 100 else [rng.gauss(0, 0.01) for _ in range(8)]) for i in range(2000)]
    out = got(hard_negatives.mine(spark.createDataFrame(rows, ROWS), F.col("vec_id") < 20, bucket=20, chunk=1, block=10))
    assert out == plain(rows, lambda i: i < 20)
    n_buckets = dict(seen)["buckets"]
    assert n_buckets == 100 and all(n <= 2 * 10 for name, n in seen if name == "visits")


def test_hard_negatives_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 1.0]), (0, 1, [1.0, 1.0]), (0, 2, [1.0, 1.0]), (1, 1, [1.0, 0.9]), (2, None, [1.0, 1.0]), (3, 1, None), (4, 1, [None, 1.0]), (5, 1, [nan, 1.0]), (6, 2, [inf, 1.0]),
        (None, 1, [1.0, 1.0]), (7, 2, [0.7]), (8, 2, []), (9, 2, [0.8, 0.3]), (10, 2, [0.8, 0.3]), (11, 1, [1e30, -1e30]), (12, 2, [1e30, 1e-30]), (13, 1, [0.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, ROWS).withColumns({"rank": F.lit("x"), "score": F.lit(1), "q": F.lit(2), "norm2": F.lit(None)})
    assert got(hard_negatives.mine(df, F.col("vec_id") >= 0)) == plain(rows, lambda i: i >= 0)
    assert got(hard_negatives.mine(df.limit(0), F.col("vec_id") >= 0)) == []
    assert got(hard_negatives.mine(df, F.col("vec_id") < 0)) == []
    assert got(hard_negatives.mine(df.filter("label = 1"), F.col("vec_id") >= 0)) == []


def test_hard_negatives_query_against_sql(spark, duck, data_dir):
    want = duck.sql(f"SELECT {', '.join(OUT)} FROM ({hard_negatives.ORACLE})").fetchall()
    assert want and got(queries.op11_hard_negative_mining(spark, data_dir)) == sorted(want)
