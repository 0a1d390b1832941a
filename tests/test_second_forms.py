"""Folds without an SQL form against plain second implementations, on the queries' own inputs, and inputs beyond former bounds."""

import math
from collections import defaultdict

from pyspark.sql import functions as F

from netloom.operators import fold, graph, proximity, shapes
from netloom.plans import shapes as plan_shapes
from netloom.plans import solids, state
from netloom.plans.tables import table, towns


def by_key(df, key, *order):
    out = defaultdict(list)
    for r in df.collect():
        out[r[key]].append(r)
    return {k: sorted(v, key=lambda r: tuple(r[o] for o in order)) for k, v in out.items()}


def metres(a, b):
    return math.hypot((a[1] - b[1]) * 111320 * math.cos(math.radians((a[0] + b[0]) / 2)), (a[0] - b[0]) * 110574)


def test_schedule(spark, data_dir):
    jobs = by_key(table(spark, data_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus"), "o_custkey", "o_orderkey")
    want = set()
    for farm, rows in jobs.items():
        free = {"a1 #1": 0.0, "a1 #2": 0.0, "s3": 0.0}
        for r in sorted(rows, key=lambda r: -r["o_totalprice"]):
            speed = {m: 2.0 if m == "s3" else 1.0 for m in (["s3"] if r["o_orderstatus"] == "P" else free)}
            ends = {m: free[m] + r["o_totalprice"] * f for m, f in speed.items()}
            m = min(sorted(ends), key=lambda k: ends[k])
            want.add((farm, r["o_orderkey"], m, free[m], ends[m]))
            free[m] = ends[m] + 300.0
    assert {tuple(r) for r in state.lpt_schedule(spark, data_dir).collect()} == want


def test_four_pools(spark, data_dir):
    want = {}
    for farm, rows in by_key(table(spark, data_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey").items():
        for pool in (1, 2, 3, 4):
            free, end = [0.0] * pool, 0.0
            for r in sorted(rows, key=lambda r: -r["o_totalprice"]):
                at = min(range(pool), key=lambda m: free[m])
                end, free[at] = max(end, free[at] + r["o_totalprice"]), free[at] + r["o_totalprice"] + 300.0
            want[(farm, pool)] = (end, len(rows))
    assert {(r["c_custkey"], r["pool"]): (r["makespan"], r["jobs"]) for r in solids.what_if_farms(spark, data_dir).collect()} == want


def test_greedy_clusters_by_component_equal_those_of_the_whole_name(spark, data_dir):
    k = F.col("p_partkey")
    nodes = by_key(table(spark, data_dir, "part").select(k.alias("id"), "p_brand", *towns(k)), "p_brand", "id")
    want = {}
    for rows in nodes.values():
        open_ = []
        for r in rows:
            p = (r["lat"], r["lon"])
            for c in open_:
                if metres(c[1], p) < 650.0:
                    n = c[2]
                    c[1], c[2] = tuple((a * n + b) / (n + 1) for a, b in zip(c[1], p)), n + 1
                    want[r["id"]] = c[0]
                    break
            else:
                open_.append([r["id"], p, 1])
                want[r["id"]] = r["id"]
    got = {r["id"]: r["cluster"] for r in state.greedy_clusters(spark, data_dir).collect()}
    assert got == want and len(set(want.values())) < len(want)


def test_greedy_clusters_of_a_dense_place(spark):
    rows = [("n", i, i, 40 + (i * 37 % 101) / 3000, -75 + (i * 53 % 103) / 3000) for i in range(300)]
    got = {r["id"]: r["cluster"] for r in fold.greedy_clusters(spark.createDataFrame(rows, "name string, ord long, id long, lat double, lon double"), "name", "ord").collect()}
    open_, want = [], {}
    for _, _, i, la, lo in rows:
        c = next((c for c in open_ if metres(c[1], (la, lo)) < 650.0), None)
        if c is None:
            open_.append([i, (la, lo), 1])
            want[i] = i
        else:
            c[1], c[2] = ((c[1][0] * c[2] + la) / (c[2] + 1), (c[1][1] * c[2] + lo) / (c[2] + 1)), c[2] + 1
            want[i] = c[0]
    assert got == want


def test_similar_fold(spark, data_dir):
    o = table(spark, data_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    li = table(spark, data_dir, "lineitem").select("l_orderkey", "l_partkey")
    st = defaultdict(set)
    for r in li.collect():
        st[r["l_orderkey"]].add(r["l_partkey"] % 25)
    want = {}
    for rows in by_key(o, "o_custkey", "o_orderkey").values():
        kept = {}
        for r in rows:
            own = st.get(r["o_orderkey"])
            if not own:
                continue
            for k, (family, has) in kept.items():
                if len(own & has) >= (3 if family == r["o_orderpriority"] else max(3, 0.9 * min(len(own), len(has)))):
                    has |= own
                    want[r["o_orderkey"]] = k
                    break
            else:
                kept[r["o_orderkey"]] = (r["o_orderpriority"], set(own))
                want[r["o_orderkey"]] = r["o_orderkey"]
    assert {r["line"]: r["target"] for r in state.similar_fold(spark, data_dir).collect()} == want


def test_greedy_match_leaves_no_shorter_pair(spark, data_dir):
    """A matching by ascending distance is the one in which each pair left out is blocked by one that is no longer."""
    got = by_key(state.greedy_match(spark, data_dir), "k", "d")
    li = by_key(table(spark, data_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")), "k", "a")
    for k, rows in li.items():
        a, b = {r["a"] for r in rows}, {r["b"] for r in rows}
        mine = got[k]
        assert len(mine) == min(len(a), len(b)) == len({r["a"] for r in mine}) == len({r["b"] for r in mine})
        at = lambda x: (40.0 + x * 7919 % 10007 / 10007.0, -75.0 + x * 104729 % 10009 / 10009.0)
        by_a, by_b = {r["a"]: r["d"] for r in mine}, {r["b"]: r["d"] for r in mine}
        for x in a:
            for y in b:
                assert min(by_a.get(x, math.inf), by_b.get(y, math.inf)) <= metres(at(x), at(y)) + 1e-6


def test_shelves_hold_all_without_overlap(spark, data_dir):
    size = lambda p: (10.0 + p % 60, 10.0 + p * 7 % 50)
    for rows in by_key(state.shelf_pack(spark, data_dir), "k", "plate", "y", "x").values():
        boxes = [(r["plate"], r["x"], r["y"], r["x"] + size(r["item"])[0], r["y"] + size(r["item"])[1]) for r in rows]
        assert all(x1 <= 180 and y1 <= 180 for _, _, _, x1, y1 in boxes)
        for i, a in enumerate(boxes):
            assert not any(a[0] == b[0] and a[1] < b[3] and b[1] < a[3] and a[2] < b[4] and b[2] < a[4] for b in boxes[i + 1 :])


def paths(spark, data_dir):
    return {k: [(r["ord"], r["x"], r["y"]) for r in v] for k, v in by_key(plan_shapes._points(spark, data_dir), "k", "ord").items()}


def test_hulls_by_wrapping(spark, data_dir):
    got = by_key(plan_shapes.convex_hulls(spark, data_dir), "k", "ord")
    for k, pts in paths(spark, data_dir).items():
        p = sorted({(x, y) for _, x, y in pts})
        out, at = [], p[0]
        while len(p) > 2:
            out.append(at)
            nxt = next(q for q in p if q != at)
            for q in p:
                side = (nxt[0] - at[0]) * (q[1] - at[1]) - (nxt[1] - at[1]) * (q[0] - at[0])
                if q != at and (side < 0 or (side == 0 and math.dist(at, q) > math.dist(at, nxt))):
                    nxt = q
            at = nxt
            if at == out[0]:
                break
        assert [(r["x"], r["y"]) for r in got[k]] == (out or p)


def off_line(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    n = dx * dx + dy * dy
    t = 0 if n == 0 else max(0, min(1, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / n))
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def test_simplified_paths_by_recursion(spark, data_dir):
    def keep(p):
        if len(p) < 3:
            return p
        d = [off_line(q[1:], p[0][1:], p[-1][1:]) for q in p[1:-1]]
        if max(d) <= 200.0:
            return [p[0], p[-1]]
        i = d.index(max(d)) + 1
        return keep(p[: i + 1])[:-1] + keep(p[i:])

    got = by_key(plan_shapes.simplified_paths(spark, data_dir), "k", "ord")
    assert {k: [r["ord"] for r in v] for k, v in got.items()} == {k: [q[0] for q in keep(p)] for k, p in paths(spark, data_dir).items()}


def test_collinear_paths(spark, data_dir):
    got = by_key(plan_shapes.collinear_paths(spark, data_dir), "k", "ord")
    for k, p in paths(spark, data_dir).items():
        out = p[:1]
        for q, r in zip(p[1:], p[2:]):
            u, v = (q[1] - out[-1][1], q[2] - out[-1][2]), (r[1] - out[-1][1], r[2] - out[-1][2])
            if abs(u[0] * v[1] - u[1] * v[0]) > 1e-6:
                out.append(q)
        assert [r["ord"] for r in got[k]] == [q[0] for q in out + p[-1:] * (len(p) > 1)]


def test_marker_clusters(spark, data_dir):
    got = {(r["k"], r["ord"]): r["cluster"] for r in plan_shapes.marker_clusters(spark, data_dir).collect()}
    for k, p in paths(spark, data_dir).items():
        mine = {}
        for o, x, y in p:
            near = [c for (x2, y2), c in mine.items() if math.dist((x, y), (x2, y2)) <= 150.0]
            mine[(x, y)] = got_c = min(near, default=len(set(mine.values())))
            assert got[(k, o)] == got_c


def test_snapped_points(spark, data_dir):
    got = {(r["k"], r["id"]): (r["gx"], r["gy"]) for r in plan_shapes.snapped_points(spark, data_dir).collect()}
    for k, p in paths(spark, data_dir).items():
        free = {}
        for o, x, y in sorted(p, key=lambda q: (q[1] % 7, q[0])):
            cx, cy = math.floor(x / 200 + 0.5), math.floor(y / 200 + 0.5)
            cells = [(max(abs(i), abs(j)), math.dist(((cx + i) * 200, (cy + j) * 200), (x, y)), (cx + i, cy + j)) for i in range(-6, 7) for j in range(-6, 7) if (cx + i, cy + j) not in free]
            want = min(cells)[2] if cells else (None, None)
            free[want] = o
            assert got[(k, o)] == want


def test_merged_interchanges(spark, data_dir):
    rows = plan_shapes.merged_interchanges(spark, data_dir).collect()
    k = F.col("p_partkey")
    p = {r["s"]: r for r in table(spark, data_dir, "part").select(k.alias("s"), "p_brand", *towns(k)).collect()}
    near = sorted((metres((p[a]["lat"], p[a]["lon"]), (p[b]["lat"], p[b]["lon"])), a, b) for a in p for b in p if a < b and p[a]["p_brand"] == p[b]["p_brand"])
    to = {s: s for s in p}
    for d, a, b in near:
        if d <= 300.0 and to[a] != to[b]:
            old, new = to[b], to[a]
            to = {s: new if t == old else t for s, t in to.items()}
    assert {r["station"]: r["target"] for r in rows} == {s: t for s, t in to.items() if any(s in (a, b) for d, a, b in near if d <= 300.0)} and rows


def test_long_chains_and_rings(spark):
    e = [(i, i + 1) for i in range(700)] + [(10_000 + i, 10_000 + (i + 1) % 50) for i in range(50)] + [(20_000, 20_001), (20_001, 20_002), (20_002, 20_000), (20_000, 20_003)]
    edges = spark.createDataFrame(e, "a long, b long")
    major = graph.degrees(edges).filter("degree <> 2").select("station")
    got = {(r["a"], r["b"], len(r["path"])): r["path"] for r in graph.corridors(edges, major).collect()}
    assert set(got) == {(0, 700, 701), (20_000, 20_003, 2), (20_000, 20_000, 4)} and got[(0, 700, 701)] == list(range(701))


def test_nearest_segment_far_away_and_nowhere(spark):
    seg = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 0.0)], "seg long, ax double, ay double, bx double, by double")
    pts = spark.createDataFrame([(1, 1e12, 0.0), (2, 0.5, 2.0), (3, None, 1.0), (4, float("nan"), 1.0)], "id long, x double, y double")
    got = {r["id"]: (r["seg"], r["d"]) for r in proximity.nearest_segment(pts, seg, 1.0).collect()}
    assert got == {1: (1, 1e12 - 1), 2: (1, 2.0), 3: (None, None), 4: (None, None)}
    assert [r["seg"] for r in proximity.nearest_segment(pts, seg.limit(0), 1.0).collect()] == [None] * 4


def test_shapes_module_is_the_one_tested():
    assert plan_shapes.shapes is shapes
