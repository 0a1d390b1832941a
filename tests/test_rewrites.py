"""Express expansion and interchange merging against plain loops over the same networks."""

import math
import random
from collections import defaultdict, deque

from netloom.operators import rewrites

STOPS, PLACES = "line long, seq long, ord long, station long", "station long, lat double, lon double, name string"


def metres(p, q):
    return math.hypot((p[1] - q[1]) * 111320 * math.cos(math.radians((p[0] + q[0]) / 2)), (p[0] - q[0]) * 110574)


def way(a, b, adj, at):
    """Breadth first, neighbours in the order in which they came."""
    size = metres(at[a], at[b])
    if size < 50:
        return None

    def near(s):
        kx, ky = 111320 * math.cos(math.radians(at[a][0])), 110574
        bx, by, px, py = (at[b][1] - at[a][1]) * kx, (at[b][0] - at[a][0]) * ky, (at[s][1] - at[a][1]) * kx, (at[s][0] - at[a][0]) * ky
        t = max(0, min(1, (px * bx + py * by) / (bx * bx + by * by)))
        return math.hypot(px - t * bx, py - t * by) < max(0.3 * size, 350) and 0.02 < t < 0.98

    come, todo = {a: [a]}, deque([a])
    while todo:
        cur = todo.popleft()
        if len(come[cur]) > 8:
            continue
        for n in adj[cur]:
            if n in come or (cur == a and n == b) or (n != b and not near(n)):
                continue
            come[n] = [*come[cur], n]
            if n == b:
                return come[n]
            todo.append(n)
    return None


def expanded(seqs, at):
    for _ in range(4):
        adj, changed = defaultdict(dict), False
        for s in seqs:
            for a, b in zip(s, s[1:], strict=False):
                adj[a][b] = adj[b][a] = 1
        out = []
        for s in seqs:
            new = [s[0]]
            for a, b in zip(s, s[1:], strict=False):
                w = way(a, b, adj, at)
                changed |= w is not None
                new += w[1:] if w else [b]
            out.append(new)
        seqs = out
        if not changed:
            break
    return seqs


def frames(spark, lines, at):
    rows = [(ln, k, i, s) for ln, seqs in lines.items() for k, seq in enumerate(seqs) for i, s in enumerate(seq)]
    return spark.createDataFrame(rows, STOPS), spark.createDataFrame([(s, *p, f"N{s % 50}") for s, p in at.items()], PLACES)


def test_express_hops_on_any_lines(spark):
    """Lines with expresses, branches and loops over stations along a street and beside it; a hub that many patterns pass."""
    rng = random.Random(5)
    at = {s: (40 + rng.choice([0.0, 0.0, 0.001, 0.006]), -75 + 0.01 * (s % 25) + rng.random() * 0.001) for s in range(75)}
    lines = {}
    for ln in range(8):
        local = [s + 25 * rng.randrange(3) for s in range(25)]
        seqs = [local[: rng.randrange(10, 25)], [s for s in local if rng.random() < 0.4] or local[:2], [s for s in reversed(local) if rng.random() < 0.3] or local[3:5], [local[0], local[2], local[1], local[0]]]
        lines[ln] = [[s for i, s in enumerate(q) if not i or q[i - 1] != s] for q in seqs]
    stops, places = frames(spark, lines, at)
    got = defaultdict(list)
    for r in rewrites.expand_express(stops, places).orderBy("line", "seq", "ord").collect():
        got[r["line"], r["seq"]].append(r["station"])
    want = {(ln, k): s for ln, seqs in lines.items() for k, s in enumerate(expanded(seqs, at))}
    assert dict(got) == want and want != {(ln, k): s for ln, seqs in lines.items() for k, s in enumerate(seqs)}


def merged(lines, at, radius):
    serve, near = defaultdict(set), defaultdict(set)
    for ln, seqs in lines.items():
        for q in seqs:
            for i, s in enumerate(q):
                serve[s].add(ln)
                near[s] |= {q[k] for k in (i - 1, i + 1) if 0 <= k < len(q)} - {s}
    place, name, to = dict(at), {s: f"N{s % 50}" for s in at}, {}

    def root(s):
        while s in to:
            s = to[s]
        return s

    pairs = sorted((metres(at[a], at[b]), a, b) for a in serve for b in serve if a < b and metres(at[a], at[b]) <= radius)
    for _, a, b in pairs:
        a, b = root(a), root(b)
        if a == b or serve[a] & serve[b] or any(serve[root(n)] & serve[a] and serve[root(n)] & serve[b] for n in near[a] | near[b]):
            continue
        place[a] = tuple((x + y) / 2 for x, y in zip(place[a], place[b], strict=True))
        name[a] = name[a] if name[b] in name[a] or name[a] in name[b] else f"{name[a]} / {name[b]}"
        serve[a] |= serve[b]
        near[a] |= near[b]
        to[b] = a
    want = {s: (root(s), place[root(s)], name[root(s)]) for _, a, b in pairs for s in (a, b)}
    seqs = {}
    for ln, qs in lines.items():
        for k, q in enumerate(qs):
            r = [root(s) for s in q]
            seqs[ln, k] = [s for i, s in enumerate(r) if not i or r[i - 1] != s]
    return want, seqs


def test_interchanges_of_any_networks(spark):
    """Many lines through a few places, with parallel stretches and chains of merges."""
    rng = random.Random(9)
    at = {s: (40 + rng.random() * 0.02 + s // 60, -75 + rng.random() * 0.02) for s in range(180)}
    lines = {}
    for ln in range(30):
        town = ln % 3 * 60
        lines[ln] = [[town + x for x in rng.sample(range(60), rng.randrange(3, 9))] for _ in range(2)]
    stops, places = frames(spark, lines, at)
    table, seqs = rewrites.merged_interchanges(stops, places, 300.0)
    want, want_seqs = merged(lines, at, 300.0)
    got = {r["station"]: (r["target"], (r["lat"], r["lon"]), r["name"]) for r in table.collect()}
    assert {k: (v[0], v[2]) for k, v in got.items()} == {k: (v[0], v[2]) for k, v in want.items()}
    assert all(math.dist(got[k][1], want[k][1]) < 1e-12 for k in want) and any(k != v[0] for k, v in want.items()) and any(k == v[0] for k, v in want.items())
    mine = defaultdict(list)
    for r in seqs.orderBy("line", "seq", "ord").collect():
        mine[r["line"], r["seq"]].append(r["station"])
    assert dict(mine) == want_seqs
