"""Plans that once wrote or shuffled rows many times as large as their input."""

import random

import pytest

from netloom.operators import linking, shared
from netloom.plans import loops


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def written(monkeypatch):
    """Names of the tables that operators write."""
    from netloom.operators import graph, rewrites, sequence

    names, write = [], shared.saved

    def saved(df, name):
        names.append(name)
        return write(df, name)

    for m in (linking, graph, rewrites, sequence):
        monkeypatch.setattr(m, "saved", saved)
    return names


@pytest.mark.parametrize(("query", "shuffles"), [(loops.layer_loops, 2), (loops.loop_nesting, 1)])
def test_segments_are_neither_written_nor_shuffled(spark, data_dir, written, query, shuffles):
    """stops are dealt once; segments stay in their tasks, of which loops' areas or depths come."""
    p = plan(query(spark, data_dir))
    assert p.count("Exchange hashpartitioning") == shuffles and "Exchange hashpartitioning(seq" in p and "Join" not in p
    assert not written


def test_nested_and_areas_in_tasks_and_by_joins(spark, monkeypatch):
    """groups of all sizes, with ends a little off, ends that several are near and keys that are missing, in tasks and by joins."""
    rng, segs, no = random.Random(7), [], 0
    for g in (0, 1, 2, None):
        for k in range(12):
            n, r, c = rng.choice([3, 4, 8]), rng.choice([1.5**k, 0.7]), 100.0 * (k % 3)
            pts = linking.np.array([[c + r * linking.np.cos(a), c + r * linking.np.sin(a)] for a in linking.np.arange(n) * 2 * linking.np.pi / n]).tolist()
            for a, b in zip(pts, pts[1:] + pts[:1], strict=True):
                off = rng.choice([0.0, rng.uniform(-0.001, 0.001)])
                segs += [(g, no, a[0] + off, a[1], b[0], b[1])]
                no += 1
            if k % 4 == 0:
                segs += [(g, no + i, pts[0][0] + i * 0.0005, pts[0][1], 50.0, 60.0 + i) for i in range(4)]
                no += 4
    rng.shuffle(segs)
    df = spark.createDataFrame(segs, "grp long, seg long, x1 double, y1 double, x2 double, y2 double")
    got = {}
    for most in (250_000, 30):
        monkeypatch.setattr(linking, "GROUP", most)
        rows = lambda x, *c: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in x.filter("grp is not null").select("grp", "loop", *c).collect())
        got[most] = rows(linking.loops(df), "pos", "seg", "closed", "nx", "ny"), rows(linking.areas(df), "n", "area"), rows(linking.nested(df, 2.0), "depth")
        assert got[most][1] == rows(linking.loop_areas(linking.loops(df)), "n", "area") and got[most][2] == rows(linking.nesting(linking.loops(df), 2.0), "depth")
        assert all(r[2] == 0 for r in linking.loops(df).filter("grp is null").select("loop", "seg", "pos").collect())
    assert got[250_000] == got[30] and max(d for *_, d in got[30][2]) > 2


def test_lines_are_expanded_where_they_are(spark, data_dir, written):
    """a line's hops are searched in the task that has the line; no hop, way or round is written."""
    from netloom.plans import rewrites as plans

    p = plan(plans.express_expansion(spark, data_dir))
    assert p.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(seq" in p and "Join" not in p and not written


def test_large_lines_are_expanded_by_joins(spark, monkeypatch):
    """the same ways in tasks and by joins, with places and stations that are missing, and without places of their own."""
    from netloom.operators import rewrites

    rng = random.Random(3)
    at = {s: (40 + rng.choice([0.0, 0.001]), -75 + 0.01 * (s % 12)) for s in range(36)}
    rows = [(ln, k, i, s) for ln in range(4) for k, seq in enumerate([list(range(12)), sorted(rng.sample(range(12), 5)), [0, 14, 2, 5, 5, 30, 11][: 3 + ln]]) for i, s in enumerate(seq, 1)]
    stops = spark.createDataFrame([*rows, (9, 0, 1, 3), (9, 0, 2, None), (None, 0, 1, 3), (None, 0, 2, 4)], "line long, seq long, ord long, station long")
    places = spark.createDataFrame([(s, *p) for s, p in at.items() if s != 4] + [(4, None, 1.0)], "station long, lat double, lon double")
    key = lambda df: sorted(map(str, df.select("line", "seq", "ord", "station").collect()))
    got = key(rewrites.expand_express(stops, places))
    assert key(rewrites.expand_express(stops.join(places, "station", "left"))) == got and len(got) > len(rows) + 10
    monkeypatch.setattr(rewrites, "GROUP", 1)
    usual = lambda rows: [r for r in rows if "line=9" not in r and "line=None" not in r]
    assert usual(key(rewrites.expand_express(stops, places))) == usual(got)


def test_streets_are_laid_out_in_one_shuffle(spark, data_dir, monkeypatch):
    """the line beside each is found where both were dealt; stops were dealt once by line and joined with themselves."""
    from netloom.plans import rewrites as plans

    monkeypatch.setattr(shared, "ROWS_A_TASK", 500)

    class Seen(Exception):
        pass

    def saved(df, name):
        raise Seen(plan(df))

    monkeypatch.setattr(plans, "saved", saved)
    with pytest.raises(Seen) as seen:
        plans.interchange_merging(spark, data_dir)
    assert str(seen.value).count("Exchange hashpartitioning") == 1 and "Join" not in str(seen.value)
