"""Rules that rewrite sequences of stops: express hops become the local way, near stations become one interchange."""

from __future__ import annotations

import itertools
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import geo
from . import fold, graph, proximity, sequence
from .linking import GROUP, by_groups
from .shared import saved

# Passes, hops of a way, shortest hop that is looked at, how far from the straight line its stops may be (a share of the hop, and metres), and where along it.
PASSES, MOST_HOPS, LEAST_M = 4, 8, 50.0
OFF_SHARE, OFF_M = 0.3, 350.0
ALONG = (0.02, 0.98)
KX, KY = geo.METRES_PER_DEGREE


def _on_the_way(lat: Column, lon: Column) -> Column:
    """Whether a place lies along the hop of the row, from (lat_a, lon_a) to (lat_b, lon_b), metres long."""
    kx, ky = geo.METRES_PER_DEGREE[0] * F.cos(F.radians("lat_a")), geo.METRES_PER_DEGREE[1]
    bx, by = (F.col("lon_b") - F.col("lon_a")) * kx, (F.col("lat_b") - F.col("lat_a")) * ky
    px, py = (lon - F.col("lon_a")) * kx, (lat - F.col("lat_a")) * ky
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * bx + py * by) / (bx * bx + by * by)))
    return (geo.hypot(px - t * bx, py - t * by) < F.greatest(OFF_SHARE * F.col("metres"), F.lit(OFF_M))) & (t > ALONG[0]) & (t < ALONG[1])


def local_ways(steps: DataFrame, places: DataFrame, most: int | None = MOST_HOPS) -> DataFrame:
    """steps(line, seq, ord, a, b), places(station, lat, lon) -> (line, a, b, way): the shortest other way of each hop.

    A way runs over hops of the same line in either direction, at most ``most`` (None: any number), through stops that lie
    along the straight line only, and not over the hop itself. Of several the first is taken, where a stop's neighbours stand in the order
    in which the line's sequences name them. All hops are searched at once, a hop further each round: a stop that was
    reached keeps its first way, which bounds what a round carries by the stops along each hop.
    """
    both = steps.filter("a <> b").select("line", F.struct("seq", "ord").alias("r"), F.explode(F.array(F.struct(F.col("a").alias("cur"), F.col("b").alias("nb")), F.struct(F.col("b").alias("cur"), F.col("a").alias("nb")))).alias("e"))
    near = saved(both.groupBy("line", "e.cur", "e.nb").agg(F.min("r").alias("r")).join(places.select(F.col("station").alias("nb"), F.col("lat").alias("lat_n"), F.col("lon").alias("lon_n")), "nb"), "neighbours")
    end = lambda k: places.select(F.col("station").alias(k), F.col("lat").alias(f"lat_{k}"), F.col("lon").alias(f"lon_{k}"))
    hops = steps.select("line", "a", "b").distinct().join(end("a"), "a").join(end("b"), "b")
    hops = hops.withColumn("metres", geo.metres_between(*(F.col(c) for c in ("lat_a", "lon_a", "lat_b", "lon_b")))).filter(F.col("metres") >= LEAST_M)
    key, fixed = ["line", "a", "b"], ["lat_a", "lon_a", "lat_b", "lon_b", "metres"]
    at = saved(hops.select(*key, *fixed, F.col("a").alias("cur"), F.array().cast("array<struct<seq:bigint,ord:bigint>>").alias("rank"), F.array("a").alias("way")), "ways")
    seen, found = at.select(*key, "cur"), None
    for _ in range(most) if most is not None else itertools.count():
        to = at.join(near, ["line", "cur"]).filter(~((F.col("cur") == F.col("a")) & (F.col("nb") == F.col("b")))).filter((F.col("nb") == F.col("b")) | _on_the_way(F.col("lat_n"), F.col("lon_n")))
        step = F.struct(F.concat("rank", F.array(F.struct(F.col("r.seq").cast("long").alias("seq"), F.col("r.ord").cast("long").alias("ord")))).alias("rank"), F.concat("way", F.array("nb")).alias("way"))
        best = to.groupBy(*key, *fixed, F.col("nb").alias("cur")).agg(F.min(step).alias("s")).join(seen, [*key, "cur"], "left_anti")
        at = saved(best.select(*key, *fixed, "cur", "s.rank", "s.way"), "ways")
        got = at.filter("cur = b").select(*key, "way")
        found = got if found is None else found.unionByName(got)
        seen = seen.unionByName(at.select(*key, "cur"))
        at = at.join(got.select(*key), key, "left_anti")
        if at.isEmpty():
            break
    return found


def expand_express(stops: DataFrame, places: DataFrame | None = None, passes: int = PASSES, most: int | None = MOST_HOPS) -> DataFrame:
    """stops(line, seq, ord, station) -> the same, with each hop that has a local way (``local_ways``) replaced by it (``most``
    hops at most; None: any number); again until nothing changes, ``passes`` times at most. Lines without such a hop stay as they are.
    Sequences of other lines are numbered anew, from 1. Without ``places``(station, lat, lon), stops have lat and lon.

    A line is done in one task; lines of more than GROUP stops by joins.
    """
    s = stops.select("line", "seq", F.col("ord").cast("long").alias("ord"), "station", *(["lat", "lon"] if places is None else []))
    schema = StructType([s.schema[c] for c in ("line", "seq", "ord", "station")])
    out = to_arrow_schema(schema)
    large = not s.groupBy("line").count().filter(F.col("count") > GROUP).isEmpty()
    if places is not None:
        s = s.join(places.select("station", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).dropDuplicates(["station"]), "station", "left")
    # a window: stops that are dealt by their lines already are not shuffled
    s = s.withColumn("_n", F.count("*").over(Window.partitionBy("line")))

    def each(t: pa.Table) -> pa.Table:
        line, seq, number, station, lat, lon, n = (t[c].to_pylist() for c in ("line", "seq", "ord", "station", "lat", "lon", "_n"))
        rows, at = [], 0
        while at < len(n):
            group = range(at, at + n[at])
            seqs: dict = {}
            for i in sorted(group, key=lambda i: (seq[i] is None, seq[i] or 0, number[i] or 0)):
                seqs.setdefault(seq[i], []).append((number[i], station[i]))
            near = {station[i]: (lat[i], lon[i]) for i in group if lat[i] is not None and lon[i] is not None}
            done = expanded_line(seqs, near, passes, most) if line[at] is not None else seqs
            rows += [(line[at], k, i, x) for k, v in done.items() for i, x in v]
            at += n[at]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    small = s.filter(F.col("_n") <= GROUP) if large else s
    done = small.mapInArrow(lambda batches: by_groups(batches, each), schema)
    if not large:
        return done
    most_stops = s.filter(F.col("_n") > GROUP)
    if places is None:
        places = most_stops.select("station", "lat", "lon").filter("lat is not null and lon is not null").dropDuplicates(["station"])
    return done.unionByName(_expanded_by_joins(most_stops, places, passes, most).select(schema.names))


def expanded_line(seqs: dict, place: dict, passes: int, most: int | None) -> dict:
    """seqs: key -> [(ord, station)] in order, of one line, place: station -> (lat, lon) -> seqs, expanded; in rounds, as ``local_ways``."""

    def way_of(a, b, near):
        (la, lo), (lb, ob) = place[a], place[b]
        kx = KX * math.cos(math.radians((la + lb) / 2))
        metres = math.sqrt(((lo - ob) * kx) ** 2 + ((la - lb) * KY) ** 2)
        if metres < LEAST_M:
            return None
        kx = KX * math.cos(math.radians(la))
        bx, by = (ob - lo) * kx, (lb - la) * KY

        def along(s):
            px, py = (place[s][1] - lo) * kx, (place[s][0] - la) * KY
            t = max(0.0, min(1.0, (px * bx + py * by) / (bx * bx + by * by)))
            return ALONG[0] < t < ALONG[1] and math.sqrt((px - t * bx) ** 2 + (py - t * by) ** 2) < max(OFF_SHARE * metres, OFF_M)

        at, seen, hops = {a: ((), (a,))}, {a}, 0
        while at and (most is None or hops < most):
            best, hops = {}, hops + 1
            for cur, (rank, way) in at.items():
                for nb, r in near.get(cur, {}).items():
                    if nb in seen or (cur == a and nb == b) or not (nb == b or along(nb)):
                        continue
                    step = ((*rank, r), (*way, nb))
                    if nb not in best or step < best[nb]:
                        best[nb] = step
            if b in best:
                return best[b][1]
            at = best
            seen.update(best)
        return None

    for _ in range(passes):
        near, hops = {}, {}
        for k, stops in seqs.items():
            for (i, a), (_, b) in zip(stops, stops[1:], strict=False):
                if a is None or b is None:
                    continue
                hops[a, b] = None
                for cur, nb in ((a, b), (b, a)) if a != b else ():
                    if nb in place:
                        to = near.setdefault(cur, {})
                        to[nb] = min(to.get(nb, (k, i)), (k, i))
        ways = {h: w for h in hops if h[0] in place and h[1] in place and (w := way_of(*h, near))}
        if not ways:
            return seqs
        out = {}
        for k, stops in seqs.items():
            new = [stops[0][1]]
            for (_, a), (_, b) in zip(stops, stops[1:], strict=False):
                new += ways[a, b][1:] if (a, b) in ways else [] if b is None else [b]
            out[k] = list(enumerate(new, 1))
        seqs = out
    return seqs


def _expanded_by_joins(stops: DataFrame, places: DataFrame, passes: int, most: int | None) -> DataFrame:
    stops = saved(stops.select("line", "seq", F.col("ord").cast("long").alias("ord"), "station"), "stops")
    for _ in range(passes):
        steps = saved(sequence.steps(stops, ["line", "seq"], "ord", "station"), "steps")
        ways = saved(local_ways(steps, places, most), "local")
        if ways.isEmpty():
            break
        first = stops.join(stops.groupBy("line", "seq").agg(F.min("ord").alias("ord")), ["line", "seq", "ord"]).select("line", "seq", (F.col("ord") - 1).alias("at"), F.lit(0).alias("k"), "station")
        rest = steps.join(ways, ["line", "a", "b"], "left").withColumn("way", F.coalesce(F.expr("slice(way, 2, size(way) - 1)"), F.array("b")))
        rest = rest.select("line", "seq", F.col("ord").alias("at"), F.posexplode("way").alias("k", "station"))
        stops = saved(sequence.renumber(first.unionByName(rest), ["line", "seq"], "at", "k").select("line", "seq", "ord", "station"), "stops")
    return stops


def merged_interchanges(stops: DataFrame, places: DataFrame, radius_m: float) -> tuple[DataFrame, DataFrame]:
    """stops(line, seq, ord, station), places(station, lat, lon, name) -> (station, target, lat, lon, name) of the stations that
    have another one within the radius, and the stops with stations that were merged replaced, repeats left out.

    Pairs are gone through by distance (then by station). The second one is merged into the first, both followed to where
    they went before, unless they share a line, or a neighbour of either is served by lines of both (two stations on
    parallel lines). The merged station stands in the middle, has both names unless one holds the other, and the lines and
    neighbours of both.

    What a pair decides depends on stations in reach and on neighbours that may be merged themselves, so the fold runs over
    components of both kinds of links: a component is at most one connected network. Neighbours that no pair can change
    travel along with their lines.
    """
    own = saved(stops.groupBy("station").agg(F.sort_array(F.collect_set(F.col("line"))).alias("lines")).join(places.select("station", "lat", "lon", "name"), "station"), "served")
    near = proximity.within(own.select(F.col("station").alias("id"), "lat", "lon"), "id", radius_m)
    pairs = saved(near.select("a", "b", F.col("metres").alias("d")), "pairs")
    in_pair = saved(pairs.select(F.explode(F.array("a", "b")).alias("station")).distinct(), "candidates")
    links = sequence.steps(stops, ["line", "seq"], "ord", "station").select("a", "b").filter("a <> b")
    ways = saved(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(in_pair.withColumnRenamed("station", "a"), "a", "left_semi").distinct(), "neighbours")
    inner = ways.join(in_pair.withColumnRenamed("station", "b"), "b").select("a", "b")
    part = graph.connected_components(pairs.select("a", "b").unionByName(inner)).withColumnRenamed("component", "part")
    around = ways.join(own.select(F.col("station").alias("b"), F.col("lines").alias("lines_b")), "b").groupBy("a").agg(F.collect_list(F.struct(F.col("b").alias("station"), F.col("lines_b").alias("lines"))).alias("near"))
    rows = in_pair.join(own, "station").join(around.withColumnRenamed("a", "station"), "station", "left")
    rows = rows.select(F.col("station").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(-1.0).alias("d"), "lat", "lon", "name", "lines", "near")
    asked = pairs.select("a", "b", "d", *[F.lit(None).cast(t).alias(c) for c, t in (("lat", "double"), ("lon", "double"), ("name", "string"))], F.lit(None).cast(rows.schema["lines"].dataType).alias("lines"), F.lit(None).cast(rows.schema["near"].dataType).alias("near"))
    both = rows.unionByName(asked).join(part.withColumnRenamed("id", "a"), "a")

    def run(g):
        lines, near, place, name, to = {}, {}, {}, {}, {}
        of = {}  # lines of neighbours that are in no pair

        def root(s):
            while s in to:
                s = to[s]
            return s

        for r in g:
            a = r["a"]
            if r["b"] is None:
                lines[a], near[a], place[a], name[a] = set(r["lines"]), {x["station"] for x in r["near"] or ()}, (r["lat"], r["lon"]), r["name"]
                of.update((x["station"], x["lines"]) for x in r["near"] or ())
                continue
            a, b = root(a), root(r["b"])
            if a == b or lines[a] & lines[b]:
                continue
            passing = (set(lines.get(root(n), of.get(n, ()))) for n in near[a] | near[b])
            if any(p & lines[a] and p & lines[b] for p in passing):
                continue
            place[a] = tuple((x + y) / 2 for x, y in zip(place[a], place[b], strict=True))
            x, y = name[a], name[b]
            name[a] = x if y in x or x in y else f"{x} / {y}"
            lines[a] |= lines[b]
            near[a] |= near[b]
            to[b] = a
        return [(s, root(s), *place[root(s)], name[root(s)]) for s in sorted(lines)]

    merged = saved(fold.ordered_fold(both, ["part"], ["d", "a", "b"], run, "station long, target long, lat double, lon double, name string", pairs.count() + in_pair.count()), "merged")
    moved = stops.join(merged.filter("station <> target").select("station", "target"), "station", "left").withColumn("station", F.coalesce("target", "station")).drop("target")
    return merged, sequence.drop_consecutive_duplicates(moved, ["line", "seq"], "ord", "station").select("line", "seq", "ord", "station")
