"""Chains and rings from pieces: ends are matched, then ranked along their links.

Nothing walks a chain. Ends that lie near each other are matched in rounds of
pairs that are each other's nearest; two ends that alone stand in the very same
point are a pair before that. Places along a chain come from doubling pointers,
so rounds are logarithmic in the longest chain: inside a task for groups of up
to GROUP pieces, by joins for larger ones, where each round is written, so a
lost executor costs one round's part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from .shared import dealt, saved

# How far apart two ends of a loop's segments may be, the gap at which an open chain still counts as a loop, and the least length around a loop.
TOLERANCE, GAP, LEAST_PERIMETER = 0.0025, 0.05, 0.5
#: Width of a cell in which ends meet, in distances at which they may.
SIDE = 16
#: Planes that meet a vertex (as near as TOUCHING) are moved by NUDGE, up to NUDGES times.
TOUCHING, NUDGE, NUDGES = 1e-9, 1e-6, 16
#: Nodes of a group that is ranked in one task, at most, and rows that a task ranks at once (whole groups).
GROUP, AT_ONCE = 250_000, 100_000
#: Pairs that a task tries at once.
PAIRS = 500_000
#: Squares of smaller differences are zero: ends nearer to an axis than this stand on it, when points are told apart.
ZERO = 1e-140


def both_ends(pieces: DataFrame, number: str) -> DataFrame:
    """(grp, end, x, y): the ends of each piece, 2 number where it begins, 2 number + 1 where it ends."""
    end = lambda i: F.struct((F.col(number) * 2 + i - 1).alias("end"), F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y"))
    return pieces.select("grp", F.inline(F.array(end(1), end(2))))


def near_ends(a: DataFrame, b: DataFrame, eps: float) -> DataFrame:
    """a(grp, end, x, y), b(grp, end, x, y) -> (a, b, d): ends of one group at most ``eps`` apart. The ends of b are dealt to
    the cells that they come near: one for most, as a cell is SIDE times ``eps`` wide."""
    cell = lambda c, by=0.0: F.floor((F.col(c) + by) / (SIDE * eps))
    reach = 1.001 * eps  # a little more, for rounding
    around = lambda c: F.explode(F.sequence(cell(c, -reach), cell(c, reach)))
    left = a.select("grp", F.col("end").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), cell("x").alias("cx"), cell("y").alias("cy"))
    right = b.select("grp", F.col("end").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), around("x").alias("cx"), "y").withColumn("cy", around("y")).drop("y")
    d = F.sqrt(F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2))
    return left.join(right, ["grp", "cx", "cy"]).withColumn("d", d).filter(F.col("d") <= eps).select("a", "b", "d")


def matched(pairs: DataFrame) -> DataFrame:
    """pairs(a, b, d) of ends, a <> b -> (a, b): the pairs that are taken when all are gone through by distance, then a, then
    b, and each end is used once. Done in rounds: a pair that is the first one left at both of its ends is taken."""
    left, found = saved(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d").groupBy("a", "b").agg(F.min("d").alias("d")), "pairs"), None
    while True:
        at = left.select(F.explode(F.array("a", "b")).alias("end"), F.struct("d", "a", "b").alias("pair"))
        firsts = at.groupBy("end").agg(F.min("pair").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
        got = saved(firsts.filter("n = 2").select("pair.a", "pair.b"), "matched")
        found = got if found is None else found.unionByName(got)
        if got.isEmpty():
            return found
        used = got.select(F.explode(F.array("a", "b")).alias("end"))
        left = saved(left.join(used, left["a"] == used["end"], "left_anti").join(used, F.col("b") == used["end"], "left_anti"), "pairs")


def doubled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """ranked_lists for lists of any length, by joins: (id, head, pos, ring)."""
    at = saved(nodes.select("id").join(links.select(F.col("a").alias("id"), F.col("b").alias("to")), "id", "left").select("id", "to", F.col("id").alias("least")), "pointers")
    start = at
    while True:
        ahead = at.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("least").alias("_least"))
        least = F.least("least", "_least")  # nulls are passed over
        moved = (least != F.col("least")) | (F.col("to").isNotNull() & F.col("_to").isNull())
        at = saved(at.join(ahead, "to", "left").select("id", F.col("_to").alias("to"), least.alias("least"), moved.alias("moved")), "pointers")
        # a round that lets no list end and no least node fall has seen every ring around
        if at.filter("moved").isEmpty():
            break
    rings = at.filter("to is not null").select("id", F.col("least").alias("head"))
    open_ = start.join(rings, "id", "left").filter("to is not null and (head is null or to <> head)")
    back = nodes.select("id").join(open_.select(F.col("to").alias("id"), F.col("id").alias("up")), "id", "left").select("id", "up", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("pos"))
    back = saved(back.withColumn("head", F.coalesce("up", "id")), "ranks")
    while not back.filter("up is not null").isEmpty():
        above = back.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("pos").alias("_pos"), F.col("head").alias("_head"))
        done, rest = back.filter("up is null"), back.filter("up is not null").join(above, "up")
        back = saved(done.unionByName(rest.select("id", F.col("_up").alias("up"), (F.col("pos") + F.col("_pos")).alias("pos"), F.col("_head").alias("head"))), "ranks")
    return back.select("id", "head", "pos").join(rings.select("id", F.lit(True).alias("ring")), "id", "left").withColumn("ring", F.coalesce("ring", F.lit(False)))


def grouped(links: DataFrame, ends: DataFrame) -> DataFrame:
    """links(a, b) with the group of their ends: (grp, a, b)."""
    return links.join(ends.select("grp", F.col("end").alias("a")), "a").select("grp", "a", "b")


def coinciding(ends: DataFrame, directed: bool, rows: int) -> tuple[DataFrame, DataFrame]:
    """ends(grp, end, x, y) -> links(grp, a, b), and the ends that are left. Linked are two ends of different pieces (2 p and 2 p + 1
    are the ends of p; ``directed``: one end of each kind) that stand in one point where no other end of the group stands: no pair
    comes before theirs, as all others of either end have a distance."""
    key = lambda c: F.when(F.abs(c) < ZERO, 0.0).otherwise(F.col(c))
    # points that share a hash are left to the general way
    e = dealt(ends.withColumn("_p", F.xxhash64(key("x"), key("y"))), ["_p", "grp"], rows)
    point = Window.partitionBy("_p", "grp")
    both = {"_a": F.min("end").over(point), "_b": F.max("end").over(point), "_n": F.count("*").over(point)}
    both |= {f"_{f.__name__}_{c}": f(c).over(point) for f in (F.min, F.max) for c in "xy"}
    finite = F.col("grp").isNotNull() & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    alone = (F.col("_n") == 2) & finite & (F.col("_min_x") == F.col("_max_x")) & (F.col("_min_y") == F.col("_max_y")) & (F.floor(F.col("_a") / 2) != F.floor(F.col("_b") / 2))
    if directed:
        alone = alone & (F.col("_a").bitwiseXOR(F.col("_b")).bitwiseAND(F.lit(1)) == 1)
    e = e.withColumns(both).withColumn("_linked", F.coalesce(alone, F.lit(False))).filter("not _linked or end = _a")
    e = saved(e.select("grp", "end", "x", "y", F.when(F.col("_linked"), F.col("_b")).alias("_b")), "coinciding")
    return e.filter("_b is not null").select("grp", F.col("end").alias("a"), F.col("_b").alias("b")), e.filter("_b is null").select("grp", "end", "x", "y")


def places(nxt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The next node of each node (-1: none) -> head, place from it and whether it is a ring, for each node; rings begin at their least node."""
    n = len(nxt)
    to, least = nxt.copy(), np.arange(n)
    while True:
        on = np.flatnonzero(to >= 0)
        ahead = to[on]
        low, further = np.minimum(least[on], least[ahead]), to[ahead]
        moved = (low < least[on]).any() or (further < 0).any()
        least[on], to[on] = low, further
        if not moved:
            break
    ring = to >= 0
    up = np.full(n, -1)
    linked = np.flatnonzero(nxt >= 0)
    up[nxt[linked]] = linked
    up[np.flatnonzero(ring & (least == np.arange(n)))] = -1
    pos, head = (up >= 0).astype(np.int64), np.where(up >= 0, up, np.arange(n))
    while (on := np.flatnonzero(up >= 0)).size:
        above = up[on]
        # all are read before any is written
        more, top, further = pos[above], head[above], up[above]
        pos[on] += more
        head[on], up[on] = top, further
    return head, pos, ring


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (_k, _to, id, ...) in order of _k: nodes, and their links where _to is not null -> nodes with head, pos, ring."""

    def rank(t: pa.Table) -> list[pa.RecordBatch]:
        t = t.combine_chunks()
        is_link = pc.is_valid(t["_to"])
        out, links = t.drop_columns(["_k", "_to"]).filter(pc.invert(is_link)), t.select(["id", "_to"]).filter(is_link)
        order = np.argsort(out["id"].to_numpy())
        ids = out["id"].to_numpy()[order]
        nxt = np.full(len(ids), -1)
        nxt[np.searchsorted(ids, links["id"].to_numpy())] = np.searchsorted(ids, links["_to"].to_numpy())
        head, pos, ring = places(nxt)
        for name, values in (("head", ids[head]), ("pos", pos), ("ring", ring)):
            back = np.empty_like(values)
            back[order] = values
            out = out.append_column(name, pa.array(back))
        return out.combine_chunks().to_batches(max_chunksize=10_000)

    held, n = [], 0
    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        if n < AT_ONCE:
            continue
        t = pa.Table.from_batches(held)
        k = t["_k"].to_numpy()
        cut = int(np.searchsorted(k, k[-1]))  # the last group may go on
        if cut:
            yield from rank(t.slice(0, cut))
            rest = t.slice(cut).combine_chunks()
            held, n = rest.to_batches(), rest.num_rows
    if n:
        yield from rank(pa.Table.from_batches(held))


def ranked_lists(nodes: DataFrame, links: DataFrame, rows: int) -> DataFrame:
    """nodes(grp, id long, ...), links(grp, a, b) with each a and each b once, inside groups, id once over all -> nodes with head,
    pos, ring: the place of each node from the head of its list, from 0. A ring begins at its least node.

    Whole groups of up to GROUP nodes are ranked in tasks, larger ones by joins.
    """
    key = F.xxhash64("grp").alias("_k")  # groups that share a hash are ranked as one: ids are told apart anyway
    n = nodes.select(key, F.lit(None).cast("long").alias("_to"), *nodes.columns)
    large = saved(n.groupBy("_k").count().filter(F.col("count") > GROUP).select("_k"), "large")
    edges = links.select(key, F.col("b").alias("_to"), "grp", F.col("a").alias("id"))
    some = not large.isEmpty()
    small = lambda df: df.join(large, "_k", "left_anti") if some else df
    both = small(n).unionByName(small(edges), allowMissingColumns=True)
    schema = StructType([StructField(f.name, f.dataType) for f in nodes.schema] + [StructField("head", LongType()), StructField("pos", LongType()), StructField("ring", BooleanType())])
    out = dealt(both, ["_k"], 2 * rows, always=True).sortWithinPartitions("_k").mapInArrow(_ranked, schema)
    if some:
        most = n.join(large, "_k", "left_semi").drop("_k", "_to")
        out = out.unionByName(most.join(doubled(most, edges.join(large, "_k", "left_semi").select(F.col("id").alias("a"), F.col("_to").alias("b"))), "id"))
    return out


def plane_segments(triangles: DataFrame, first: float, step: float) -> DataFrame:
    """triangles(mesh, id, ax, ay, az, bx, ..., cz) -> (mesh, layer, id, x1, y1, x2, y2): where planes z = first + layer step cut
    them, with the solid on the left.

    A triangle lists the planes between its ends, so nothing is joined over intervals. A plane that touches a vertex of the
    mesh is moved up a little, until it touches none. Both triangles at an edge compute the same point, as an edge's ends are
    taken in the order of their coordinates.
    """
    corner = lambda k: F.struct(*[F.col(f"{k}{a}").alias(a) for a in "xyz"])
    t = triangles.select("mesh", "id", *[corner(k).alias(k) for k in "abc"])
    low, high = F.least("a.z", "b.z", "c.z"), F.greatest("a.z", "b.z", "c.z")
    # planes that a triangle may cut, and all that its corners touch
    begin, end = F.ceil((low - first) / step - 1e-3 - NUDGES * NUDGE / step), F.floor((high - first) / step + 1e-3)
    cut = t.withColumn("layer", F.explode(F.sequence(begin.cast("long"), end.cast("long"))))

    def touched(k: str) -> Column:
        """The bit of the place, counted in NUDGE above the row's plane, where a corner stands."""
        off = F.col(f"{k}.z") - (F.col("layer") * step + first)
        place = F.rint(off / NUDGE)  # halves are off anyway
        here = F.floor((F.col(f"{k}.z") - first) / step + 1e-3).cast("long") == F.col("layer")
        return F.when(here & place.between(0, NUDGES - 1) & (F.abs(off - place * NUDGE) <= TOUCHING), F.call_function("shiftleft", F.lit(1), place.cast("int"))).otherwise(0)

    # the lowest place without a corner; a window, so that meshes that are dealt already stay where they are
    bits = F.bit_or("_bits").over(Window.partitionBy("mesh", "layer"))
    cut = cut.withColumn("_bits", reduce(lambda m, n: m.bitwiseOR(n), [touched(k) for k in "abc"])).withColumn("_bits", bits)
    nudges = F.bit_count(F.bitwise_not("_bits").bitwiseAND(F.col("_bits") + 1) - 1)
    cut = cut.withColumn("z", F.col("layer") * step + first + nudges * NUDGE).filter((low < F.col("z")) & (F.col("z") < high))

    # of the edges ab, bc, ca two cross the plane; each step is a selection of its own, so that no expression is repeated inside the next
    under = {f"_{k}": F.col(f"{k}.z") < F.col("z") for k in "abc"}
    edge = lambda p, q: F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v"))
    bc = edge("b", "c")
    cut = cut.filter("a.z is not null and b.z is not null and c.z is not null").withColumns(under)
    cut = cut.withColumns({"_e": F.when(F.col("_a") != F.col("_b"), edge("a", "b")).otherwise(bc), "_f": F.when(F.col("_c") != F.col("_a"), edge("c", "a")).otherwise(bc)})

    def crossing(e: str) -> Column:
        u, v = F.col(f"{e}.u"), F.col(f"{e}.v")
        s = (F.col("z") - u["z"]) / (v["z"] - u["z"])
        return F.struct((u["x"] + s * (v["x"] - u["x"])).alias("x"), (u["y"] + s * (v["y"] - u["y"])).alias("y"))

    d = lambda p, a: F.col(f"{p}.{a}") - F.col(f"a.{a}")
    nx, ny = d("b", "y") * d("c", "z") - d("b", "z") * d("c", "y"), d("b", "z") * d("c", "x") - d("b", "x") * d("c", "z")
    cut = cut.select("mesh", "layer", "id", crossing("_e").alias("p"), crossing("_f").alias("q"), nx.alias("nx"), ny.alias("ny"))
    turned = (F.col("q.x") - F.col("p.x")) * -F.col("ny") + (F.col("q.y") - F.col("p.y")) * F.col("nx") < 0
    cut = cut.select("mesh", "layer", "id", "p", "q", turned.alias("turned"))
    pick = lambda one, other: F.when(F.col("turned"), F.col(one)).otherwise(F.col(other))
    return cut.select("mesh", "layer", "id", pick("q.x", "p.x").alias("x1"), pick("q.y", "p.y").alias("y1"), pick("p.x", "q.x").alias("x2"), pick("p.y", "q.y").alias("y2"))


def _key(*columns: np.ndarray) -> np.ndarray:
    """A hash of integers, by rows."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ c.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def _ranges(begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """begin, begin + 1, ... (n of them) for each row, and the row's number beside each."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + begin[row]


def _chunks(n: np.ndarray) -> Iterator[slice]:
    """Rows in pieces that stand for PAIRS pairs, or for one row's."""
    total, at = np.cumsum(n), 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        yield slice(at, to)
        at = to


def _nearest(g: np.ndarray, p: np.ndarray, q: np.ndarray, eps: float) -> np.ndarray:
    """Groups, places where pieces end and where they begin (2 by n; NaN: none) -> for each piece the one that follows, -1 for none.

    As ``matched``: in rounds of pairs, at most ``eps`` apart, that are each other's nearest, the least number first. What is
    tried is not held, so ends that are near very many others take time, not memory.
    """
    after, cell = np.full(len(g), -1), SIDE * eps
    a, b = np.flatnonzero(np.isfinite(p).all(0)), np.flatnonzero(np.isfinite(q).all(0))
    floor = lambda v: np.floor(v).astype(np.int64)

    def least(to: np.ndarray, d: np.ndarray, other: np.ndarray, best: tuple[np.ndarray, np.ndarray]) -> None:
        o = np.lexsort((other, d, to))
        o = o[np.diff(to[o], prepend=-1) != 0]
        to, d, other = to[o], d[o], other[o]
        less = (d < best[0][to]) | ((d == best[0][to]) & (other < best[1][to]))
        best[0][to[less]], best[1][to[less]] = d[less], other[less]

    with np.errstate(invalid="ignore", over="ignore"):
        while len(a) and len(b):
            keys = _key(g[b], floor(q[0, b] / cell), floor(q[1, b] / cell))
            order = np.argsort(keys, kind="stable")
            keys, inside = keys[order], b[order]
            best_a, best_b = [(np.full(len(g), np.inf), np.full(len(g), -1)) for _ in range(2)]
            low, high = [[floor((p[k, a] + r) / cell) for k in (0, 1)] for r in (-1.001 * eps, 1.001 * eps)]
            for i, j in ((0, 0), (0, 1), (1, 0), (1, 1)):
                cx, cy = (high if i else low)[0], (high if j else low)[1]
                on = np.flatnonzero(((cx != low[0]) if i else True) & ((cy != low[1]) if j else np.full(len(a), True)))
                asked = _key(g[a[on]], cx[on], cy[on])
                begin = np.searchsorted(keys, asked)
                n = np.searchsorted(keys, asked, "right") - begin
                for part in _chunks(n):
                    row, at = _ranges(begin[part], n[part])
                    left, right = a[on[part]][row], inside[at]
                    d = np.sqrt((p[0, left] - q[0, right]) ** 2 + (p[1, left] - q[1, right]) ** 2)
                    ok = (d <= eps) & (g[left] == g[right]) & (left != right)
                    least(left[ok], d[ok], right[ok], best_a)
                    least(right[ok], d[ok], left[ok], best_b)
            won = a[best_a[1][a] >= 0]
            won = won[best_b[1][best_a[1][won]] == won]
            if not len(won):
                break
            after[won] = best_a[1][won]
            a, b = a[(best_a[1][a] >= 0) & (after[a] < 0)], np.setdiff1d(b[best_b[1][b] >= 0], after[won], assume_unique=True)
    return after


def _loops_of(t: pa.Table, eps: float) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """Segments of whole groups, each group with its size in _n -> what ``loops`` gives, in order of loop and place; the number of each row's group, and where loops begin."""
    sizes, n, at = [], t["_n"].to_pylist(), 0
    while at < len(n):
        sizes.append(n[at])
        at += n[at]
    seg = t["seg"].to_numpy()
    order = np.argsort(seg, kind="stable")  # so that a ring begins at its least segment
    seg, g, ok = seg[order], np.repeat(np.arange(len(sizes)), sizes)[order], t["_ok"].to_numpy()[order]
    p, q = (np.array([t[f"{c}{i}"].to_numpy()[order] for c in "xy"], dtype=np.float64) for i in (2, 1))  # where segments end, and where they begin
    both = np.where(ok, np.concatenate([q, p], 1).reshape(2, 2, -1), np.nan).reshape(2, -1)

    # two ends that alone share a point
    whole = np.flatnonzero(np.isfinite(both).all(0))
    x, y = both[:, whole]
    m, many = len(seg), np.tile(g, 2)[whole]
    zero = lambda c: np.where(np.abs(c) < ZERO, 0.0, c)
    h = _key(many, zero(x), zero(y))
    o = np.argsort(h, kind="stable")
    new = np.diff(h[o], prepend=~h[o[:1]], append=~h[o[-1:]]) != 0
    first = np.flatnonzero(new[:-2] & ~new[1:-1] & new[2:])
    i, j = o[first], o[first + 1]
    same = (x[i] == x[j]) & (y[i] == y[j]) & (many[i] == many[j])
    i, j = whole[i[same]], whole[j[same]]
    begins, ends = np.minimum(i, j), np.maximum(i, j) - m
    one = (begins < m) & (ends >= 0) & (begins != ends)
    nxt = np.full(m, -1)
    nxt[ends[one]] = begins[one]
    # all others by nearness
    taken = np.zeros(m, bool)
    taken[begins[one]] = True
    rest = _nearest(g, np.where((nxt < 0) & ok, p, np.nan), np.where(~taken & ok, q, np.nan), eps)
    nxt = np.where(nxt < 0, rest, nxt)

    head, pos, ring = places(nxt)
    o = np.argsort(head * m + pos)
    head, pos, ring, g, p, q = head[o], pos[o], ring[o], g[o], p[:, o], q[:, o]
    start = np.flatnonzero(pos == 0)
    n = np.diff(start, append=m)
    along = np.roll(q, -1, 1)
    along[:, start + n - 1] = q[:, start]
    around = np.add.reduceat(np.nan_to_num(np.sqrt(((p - q) ** 2).sum(0))), start) if m else np.zeros(0)
    gap = np.sqrt(((p[:, start + n - 1] - q[:, start]) ** 2).sum(0))
    closed = np.repeat((ring[start] | (gap <= GAP)) & (n >= 3) & (around >= LEAST_PERIMETER), n)
    out = t.drop_columns(["_n", "_ok"]).take(pa.array(order[o]))
    for name, values in (("loop", seg[head]), ("pos", pos), ("closed", closed), ("nx", along[0]), ("ny", along[1])):
        out = out.append_column(name, pa.array(values))
    return out, g, start


def _areas_of(t: pa.Table, eps: float, by: list[str]) -> pa.Table:
    """What ``loop_areas`` gives of segments of whole groups."""
    t, _, start = _loops_of(t, eps)
    x, y, nx, ny = (t[c].to_numpy() for c in ("x1", "y1", "nx", "ny"))
    area = np.add.reduceat(x * ny - nx * y, start) / 2 if len(start) else np.zeros(0)
    out = t.select([*by, "loop"]).take(pa.array(start)).append_column("n", pa.array(np.diff(start, append=len(x)))).append_column("area", pa.array(area))
    return out.filter(t["closed"].take(pa.array(start)))


def _nesting_of(t: pa.Table, eps: float, by: list[str], size: float) -> pa.Table:
    """What ``nesting`` gives of segments of whole groups; edges meet the points that are asked in the same bands."""
    t, g, start = _loops_of(t, eps)
    closed = t["closed"].to_numpy()
    loop = np.repeat(np.arange(len(start)), np.diff(start, append=len(g)))
    ax, ay, bx, by_ = (t[c].to_numpy() for c in ("x1", "y1", "nx", "ny"))
    heads = start[closed[start]]
    out = t.select([*by, "loop"]).take(pa.array(heads))
    e = np.flatnonzero(closed & (ay != by_))
    low, high = np.minimum(ay[e], by_[e]), np.maximum(ay[e], by_[e])
    cls = np.maximum(0, np.ceil(np.log2((high - low) / size))).astype(np.int64)
    width = 2.0**cls * size
    begin = np.floor(low / width)
    row, band = _ranges(begin.astype(np.int64), (np.floor(high / width) - begin).astype(np.int64) + 1)
    e, cls = e[row], cls[row]
    keys = _key(g[e], cls, band)
    o = np.argsort(keys, kind="stable")
    keys, e, cls, band = keys[o], e[o], cls[o], band[o]
    depth, classes = np.zeros(len(heads), np.int32), np.unique(cls)
    # a point's questions, one for each class, are beside each other
    own, kind = np.repeat(np.arange(len(heads)), len(classes)), np.tile(classes, len(heads))
    at = np.floor(ay[heads[own]] / (2.0**kind * size)).astype(np.int64)
    asked = _key(g[heads[own]], kind, at)
    first = np.searchsorted(keys, asked)
    n = np.searchsorted(keys, asked, "right") - first
    for part in _chunks(n.reshape(len(heads), -1).sum(1)) if len(classes) else ():
        q = slice(part.start * len(classes), part.stop * len(classes))
        row, i = _ranges(first[q], n[q])
        row += q.start
        edge, point = e[i], heads[own[row]]
        x, y = ax[point], ay[point]
        hit = (g[edge] == g[point]) & (cls[i] == kind[row]) & (band[i] == at[row]) & (loop[edge] != loop[point]) & ((ay[edge] > y) != (by_[edge] > y))
        edge, x, y, mine = edge[hit], x[hit], y[hit], own[row[hit]]
        right = x < (bx[edge] - ax[edge]) * (y - ay[edge]) / (by_[edge] - ay[edge]) + ax[edge]
        pairs, times = np.unique(mine[right] * len(start) + loop[edge[right]], return_counts=True)
        np.add.at(depth, pairs[times % 2 == 1] // len(start), 1)
    return out.append_column("depth", pa.array(depth))


def by_groups(batches: Iterator[pa.RecordBatch], each: Callable[[pa.Table], pa.Table]) -> Iterator[pa.RecordBatch]:
    """Rows that lie beside those of their group, with its size in _n, are handed on in whole groups, AT_ONCE rows or so."""
    held, n, cut, end = [], 0, 0, 0  # cut: rows of whole groups, end: where the last group that was begun ends
    for batch in batches:
        sizes = batch.column("_n").to_pylist()
        while end < n + len(sizes):
            cut, end = end, end + sizes[end - n]
        held, n = [*held, batch], n + len(sizes)
        cut = n if end == n else cut
        if n >= AT_ONCE and cut:
            t = pa.Table.from_batches(held)
            yield from each(t.slice(0, cut).combine_chunks()).to_batches(max_chunksize=10_000)
            held, n, end, cut = t.slice(cut).combine_chunks().to_batches(), n - cut, end - cut, 0
    if n:
        yield from each(pa.Table.from_batches(held).combine_chunks()).to_batches(max_chunksize=10_000)


def _in_groups(segments: DataFrame, by: list[str], large: bool | None, each: Callable[[pa.Table], pa.Table], added: dict, rest: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``each`` makes of whole groups of up to GROUP segments in tasks, and ``rest`` of the larger ones. ``large``: whether there are such; None: they are counted."""
    s = segments.select(*by, F.col("seg").cast("long").alias("seg"), *PLACE)
    if large is None:
        large = not s.groupBy(*by).count().filter(F.col("count") > GROUP).isEmpty()
    # a window: segments that are dealt by a part of their group's keys already are not shuffled
    s = s.withColumns({"_n": F.count("*").over(Window.partitionBy(*by)), "_ok": reduce(lambda m, n: m & n, [F.col(k).isNotNull() for k in by])})
    schema = StructType([StructField(k, added[k]() if k in added else s.schema[k].dataType) for k in (*by, *added)])
    small = s.filter(F.col("_n") <= GROUP) if large else s
    out = small.mapInArrow(lambda batches: by_groups(batches, lambda t: each(t).select(schema.names)), schema)
    return out.unionByName(rest(s.filter(F.col("_n") > GROUP)).select(schema.names)) if large else out


PLACE = ["x1", "y1", "x2", "y2"]
LOOPED = {"loop": LongType, "pos": LongType, "seg": LongType} | dict.fromkeys(PLACE, DoubleType) | {"closed": BooleanType, "nx": DoubleType, "ny": DoubleType}


def loops(segments: DataFrame, eps: float = TOLERANCE, by: tuple[str, ...] = ("grp",), large: bool | None = None) -> DataFrame:
    """segments(by, seg long, x1, y1, x2, y2), seg once over all groups -> (by, loop, pos, seg, x1, y1, x2, y2, closed, nx, ny).

    A segment is followed by the one that begins where it ends (at most ``eps`` away; of several, the nearest is taken first,
    then the least numbers). loop is the least segment of a ring, or the first one of a chain that does not close. closed
    tells loops: rings, and chains with a gap of at most GAP, of three segments or more and at least LEAST_PERIMETER
    around. All others are left over, and reported as such. (nx, ny) is where the next segment begins, the first after the last.
    Segments without a key follow none.

    Groups of up to GROUP segments are done in tasks, larger ones by joins (``large``: whether there are any; None: they are counted).
    """
    return _in_groups(segments, list(by), large, lambda t: _loops_of(t, eps)[0], LOOPED, lambda s: _loops_by_joins(s, eps, list(by)))


def areas(segments: DataFrame, eps: float = TOLERANCE, by: tuple[str, ...] = ("grp",), large: bool | None = None) -> DataFrame:
    """``loop_areas`` of ``loops``; of groups that are done in tasks, only the areas leave them."""
    keys, added = list(by), {"loop": LongType, "n": LongType, "area": DoubleType}
    return _in_groups(segments, keys, large, lambda t: _areas_of(t, eps, keys), added, lambda s: loop_areas(_loops_by_joins(s, eps, keys), by))


def nested(segments: DataFrame, size: float, eps: float = TOLERANCE, by: tuple[str, ...] = ("grp",), large: bool | None = None) -> DataFrame:
    """``nesting`` of ``loops``; of groups that are done in tasks, only the depths leave them."""
    keys, added = list(by), {"loop": LongType, "depth": IntegerType}
    return _in_groups(segments, keys, large, lambda t: _nesting_of(t, eps, keys, size), added, lambda s: nesting(_loops_by_joins(s, eps, keys), size, by))


def _loops_by_joins(segments: DataFrame, eps: float, by: list[str]) -> DataFrame:
    grp = {} if by == ["grp"] else {"grp": F.when(F.col("_ok"), F.struct(*by))}
    s = saved(segments.withColumns(grp).select(*dict.fromkeys([*by, "grp"]), "seg", *PLACE), "segments")
    n = s.count()
    ends = both_ends(s, "seg")
    links, left = coinciding(ends, True, 2 * n)
    odd = lambda c: F.col(c) % 2 != 0
    # no segment follows itself
    links = links.unionByName(grouped(matched(near_ends(left.filter(odd("end")), left.filter(~odd("end")), eps).filter("a <> b + 1")), left))
    after = links.select("grp", F.floor(F.when(odd("a"), F.col("a")).otherwise(F.col("b")) / 2).alias("a"), F.floor(F.when(odd("a"), F.col("b")).otherwise(F.col("a")) / 2).alias("b"))
    r = ranked_lists(s.withColumnRenamed("seg", "id"), after, n).withColumnsRenamed({"id": "seg", "head": "loop"})
    inside = Window.partitionBy("loop").orderBy("pos")
    loop = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    around = F.sum(F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2)))
    whole = {"_n": F.count("*"), "_around": around} | {f"_{c}": F.first(c) for c in ("x1", "y1")} | {f"_{c}": F.last(c) for c in ("x2", "y2")}
    r = r.withColumns({k: v.over(loop) for k, v in whole.items()} | {f"_n{c}": F.lead(f"{c}1").over(inside) for c in "xy"} | {"_of": F.count("*").over(inside)})
    gap = F.sqrt(F.pow(F.col("_x2") - F.col("_x1"), 2) + F.pow(F.col("_y2") - F.col("_y1"), 2))
    closed = F.coalesce((F.col("ring") | (gap <= GAP)) & (F.col("_n") >= 3) & (F.col("_around") >= LEAST_PERIMETER), F.lit(False))
    nxt = lambda c: F.when(F.col("_of") < F.col("_n"), F.col(f"_n{c}")).otherwise(F.col(f"_{c}1")).alias(f"n{c}")
    return r.select(*by, "loop", "pos", "seg", *PLACE, closed.alias("closed"), nxt("x"), nxt("y"))


def loop_areas(looped: DataFrame, by: tuple[str, ...] = ("grp",)) -> DataFrame:
    """(by, loop, n, area): the signed area of each closed loop, counterclockwise positive; a small gap is closed straight."""
    return looped.filter("closed").groupBy(*by, "loop").agg(F.count("*").alias("n"), (F.sum(F.col("x1") * F.col("ny") - F.col("nx") * F.col("y1")) / 2).alias("area"))


def nesting(looped: DataFrame, size: float, by: tuple[str, ...] = ("grp",)) -> DataFrame:
    """(by, loop, depth): how many other loops of the group hold each closed loop; odd ones are holes.

    A loop's first point is asked: it lies in another loop if that has an odd number of edges to its right at its height.
    Edges are dealt to bands of height by size class (bands of 2^k times ``size`` for edges up to that high, so two bands
    at most), points to their band of each class; no loop meets all others.
    """
    by = list(by)
    looped = saved(looped.filter("closed").select(*by, "loop", "pos", "x1", "y1", "nx", "ny"), "loops")
    edges = looped.select(*by, "loop", F.col("x1").alias("ax"), F.col("y1").alias("ay"), F.col("nx").alias("bx"), F.col("ny").alias("by")).filter("ay <> by")
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    edges = edges.withColumn("class", F.greatest(F.lit(0), F.ceil(F.log2((high - low) / size))).cast("int"))
    width = lambda c: F.pow(F.lit(2.0), F.col(c)) * size
    edges = edges.withColumn("band", F.explode(F.sequence(F.floor(low / width("class")), F.floor(high / width("class")))))
    classes = [r["class"] for r in edges.select("class").distinct().collect()]  # one for each doubling of the height
    heads = looped.filter("pos = 0").select(*by, F.col("loop").alias("own"), F.col("x1").alias("x"), F.col("y1").alias("y"))
    asked = heads.withColumn("class", F.explode(F.array(*[F.lit(c) for c in classes]).cast("array<int>"))).withColumn("band", F.floor(F.col("y") / width("class")))
    right = F.col("x") < (F.col("bx") - F.col("ax")) * (F.col("y") - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax")
    hit = asked.join(edges, [*by, "class", "band"]).filter((F.col("own") != F.col("loop")) & ((F.col("ay") > F.col("y")) != (F.col("by") > F.col("y")))).filter(right)
    inside = hit.groupBy("own", "loop").agg(F.count("*").alias("n")).filter("n % 2 = 1").groupBy(F.col("own")).agg(F.count("*").alias("depth"))
    return heads.join(inside, "own", "left").select(*by, F.col("own").alias("loop"), F.coalesce("depth", F.lit(0)).cast("int").alias("depth"))


def joined(pieces: DataFrame, eps: float) -> DataFrame:
    """pieces(grp, piece long, x1, y1, x2, y2): the ends of polylines, piece once over all groups -> (grp, piece, chain, pos,
    flipped): polylines of one group whose ends touch (at most ``eps`` apart), joined until none are left.

    An end is joined once: pairs of ends are gone through by distance, then by piece. Of a chain's two directions, that one
    is given in which its first piece has the smaller number than its last (a single piece is not flipped); rings begin
    with their least piece as it is. chain is the first piece.
    """
    p = saved(pieces, "pieces")
    # ends: 2 piece is where a piece begins, 2 piece + 1 where it ends; a node for each piece and direction has the number of the end that it leads to
    ends = both_ends(p, "piece")
    n = p.count()
    links, left = coinciding(ends, False, 2 * n)
    near = near_ends(left, left, eps).filter("a < b").filter(F.floor(F.col("a") / 2) != F.floor(F.col("b") / 2))
    links = links.unionByName(grouped(matched(near), left))
    other = lambda c: F.col(c).bitwiseXOR(F.lit(1))
    after = links.select("grp", "a", other("b").alias("b")).unionByName(links.select("grp", F.col("b").alias("a"), other("a").alias("b")))
    # a node leads to end e; then comes the piece that is entered at the end matched with e, which leads to its other end
    ranks = ranked_lists(ends.select("grp", F.col("end").alias("id")), after, 2 * n).withColumnRenamed("ring", "_ring")
    # forward nodes are odd: of a piece's two nodes the one that leads to its end; order rings by piece, forward first
    w = Window.partitionBy("head")
    piece = lambda c: F.floor(F.col(c) / 2)
    single = F.col("head") == F.col("_tail")
    chosen = F.when(F.col("_ring"), True).when(single, F.col("head") % 2 == 1).otherwise(piece("head") < piece("_tail"))
    # both directions of a ring begin at the same least node or its twin; the one with its least piece forward is kept, turned to begin there
    r = ranks.withColumn("_p", piece("id")).withColumns({"_tail": F.max_by("id", "pos").over(w), "_len": F.count("*").over(w)}).filter(chosen)
    first = F.min_by(F.col("pos"), F.struct("_p")).over(w)
    forward = F.min_by(F.col("id") % 2 == 1, F.struct("_p")).over(w)
    r = r.withColumns({"_first": first, "_fwd": forward}).filter(~F.col("_ring") | F.col("_fwd"))
    pos = F.when(F.col("_ring"), F.pmod(F.col("pos") - F.col("_first"), F.col("_len"))).otherwise(F.col("pos"))
    chain = F.when(F.col("_ring"), F.min("_p").over(w)).otherwise(piece("head"))
    return r.select("grp", F.col("_p").alias("piece"), chain.alias("chain"), pos.alias("pos"), (F.col("id") % 2 == 0).alias("flipped"))


def joined_points(points: DataFrame, order: DataFrame) -> DataFrame:
    """points(piece, i, x, y), what ``joined`` gives -> (grp, chain, i, x, y): the points of the chains; one that repeats the point before it (within 1e-6) is left out."""
    p = points.join(order, "piece").withColumn("_k", F.when(F.col("flipped"), -F.col("i")).otherwise(F.col("i")))
    by = Window.partitionBy("chain").orderBy("pos", "_k")
    far = F.sqrt(F.pow(F.col("x") - F.lag("x").over(by), 2) + F.pow(F.col("y") - F.lag("y").over(by), 2))
    p = p.withColumn("_d", far).filter("_d is null or _d > 1e-6")
    return p.select("grp", "chain", (F.row_number().over(by) - 1).alias("i"), "x", "y")
