"""Chains and rings: ends that alone share a point are linked at once, groups are ranked in tasks, and large ones by joins (F9, F12)."""

import random

import numpy as np
import pytest

from netloom.operators import linking


def ring(grp, first, n, far=0.0):
    """Segments around a circle of radius 1, numbered from ``first`` in a shuffled order; each begins ``far`` beside the end of the one before."""
    at = [(float(np.cos(2 * np.pi * i / n)), float(np.sin(2 * np.pi * i / n))) for i in range(n)]
    seg = [first + i for i in range(n)]
    random.Random(first).shuffle(seg)
    return [(grp, seg[i], at[i][0] + far, at[i][1], *at[(i + 1) % n]) for i in range(n)]


SEGMENTS = "grp long, seg long, x1 double, y1 double, x2 double, y2 double"


@pytest.mark.parametrize("most", [250_000, 5])
def test_rings_and_chains_of_any_size(spark, monkeypatch, most):
    monkeypatch.setattr(linking, "GROUP", most)
    monkeypatch.setattr(linking, "AT_ONCE", 7)
    rows = ring(1, 0, 12) + ring(2, 100, 40, far=0.001) + ring(3, 200, 3)[:2] + ring(1, 300, 4) + ring(4, 400, 30)[:-1]
    got = {}
    for r in linking.loops(spark.createDataFrame(rows, SEGMENTS)).collect():
        got.setdefault((r["grp"], r["loop"]), []).append(r)
    # rings begin at their least segment, the open chain of 29 at its first; groups 1 and 1 meet nowhere else than on the circle
    assert {k: len(v) for k, v in got.items() if k[0] in (2, 4)} == {(2, 100): 40, (4, rows[-29][1]): 29}
    for (_, head), v in got.items():
        v.sort(key=lambda r: r["pos"])
        assert [r["pos"] for r in v] == list(range(len(v))) and v[0]["seg"] == head
        assert all(abs(a["x2"] - b["x1"]) <= 0.0025 and abs(a["y2"] - b["y1"]) <= 0.0025 for a, b in zip(v, v[1:], strict=False))
    assert sum(map(len, got.values())) == len(rows)


def test_only_two_lone_ends_of_different_pieces_are_linked_at_once(spark):
    ends = [(1, 1, 0.0, 0.0), (1, 2, -0.0, 0.0), (1, 3, 1.0, 0.0), (1, 4, 1.0, 0.0), (1, 6, 1.0, 0.0), (1, 8, 2.0, 0.0), (1, 9, 2.0, 0.0), (1, 10, 3.0, 0.0), (1, 12, 3.0, 0.0), (2, 13, 4.0, 0.0), (3, 14, 4.0, 0.0), (1, 15, float("nan"), 0.0), (1, 16, float("nan"), 0.0), (1, 17, None, 0.0), (1, 18, None, 0.0), (1, 19, 1e-200, 5.0), (1, 20, 2e-200, 5.0)]
    df = spark.createDataFrame(ends, "grp long, end long, x double, y double")
    for directed, want in ((True, [(1, 2)]), (False, [(1, 2), (10, 12)])):
        links, left = linking.coinciding(df, directed, len(ends))
        assert sorted((r["a"], r["b"]) for r in links.collect()) == want
        assert sorted(r["end"] for r in left.collect()) == sorted({e[1] for e in ends} - {e for p in want for e in p})


def test_places_of_random_lists_and_rings():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 50, 300):
        nxt = rng.permutation(n)
        nxt[rng.random(n) < 0.03] = -1
        head, pos, ring_ = linking.places(nxt)
        assert (nxt[:0] == -1).all() and len(head) == n
        before = {int(b): a for a, b in enumerate(nxt) if b >= 0}
        for i in range(n):
            walk = [i]
            while walk[-1] in before and before[walk[-1]] != i:
                walk.append(before[walk[-1]])
            closed = walk[-1] in before
            assert ring_[i] == closed and head[i] == (min(walk) if closed else walk[-1]) and walk[pos[i]] == head[i]


def test_no_list_is_ranked_by_joins_where_groups_are_small(spark, monkeypatch):
    monkeypatch.setattr(linking, "doubled", None, raising=False)
    rows = ring(1, 0, 64) + ring(2, 100, 9)
    assert {r["loop"] for r in linking.loops(spark.createDataFrame(rows, SEGMENTS)).collect()} == {0, 100}
