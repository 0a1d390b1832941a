"""Order-dependent folds: rules whose next step depends on what was decided before.

Each runs within an independent key, in a stated order. Rows are dealt by key and
sorted in Spark, and stream through a task that holds one group at a time, so a
task takes many small groups without a call for each. Keys are what bounds a
group's size (a name, a farm, a colour); none of these folds may be given one
group that grows with the input.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import graph, proximity
from .shared import dealt

MERGE_RADIUS_M = 650.0
CHANGEOVER_S = 300.0


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[list[dict]], Iterable[tuple]], schema: str, rows: int = 0, rows_a_task: int | None = None) -> DataFrame:
    """Applies fn to each group's rows (as dicts), sorted by ``order``, which must break all ties; fn gives the result's rows. ``rows``: about how many rows there are, where they are many for the session's shuffle partitions; with ``rows_a_task``, for folds that take long over a row, the tasks are so many by that alone."""
    out = to_arrow_schema(StructType.fromDDL(schema))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [[] for _ in out]
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, out, strict=True)], schema=out)

    def run(batches):
        at, group, rows = None, [], []
        for b in batches:
            for r in b.to_pylist():
                key = tuple(r[k] for k in keys)
                if group and key != at:
                    rows.extend(fn(group))
                    group = []
                at = key
                group.append(r)
            if len(rows) > 5000:
                yield batch(rows)
                rows = []
        if group:
            rows.extend(fn(group))
        yield batch(rows)

    spread = df.repartition(max(1, math.ceil(rows / rows_a_task)), *keys) if rows_a_task else dealt(df, keys, rows, always=True)
    return spread.sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def greedy_clusters(nodes: DataFrame, key: str, order: str, radius_m: float = MERGE_RADIUS_M) -> DataFrame:
    """nodes(key, order, id, lat, lon) -> (id, cluster): each node joins the first open cluster of its key whose
    running mean is nearer than the radius, else opens one; a cluster is named by its first node.

    The mean is less than the radius away from the node that joined last, so who joins is within twice the radius of
    that one: nodes of one key are folded by the components of that graph, however many nodes have the key.
    """
    near = proximity.within(nodes.select("id", "lat", "lon", key), "id", 2 * radius_m, by=key)
    part = graph.connected_components(near).withColumnRenamed("id", "_i")
    nodes = nodes.join(part, F.col("id") == F.col("_i"), "left").withColumn("_part", F.coalesce("component", "id")).drop("_i", "component")

    def fold(g):
        lat, lon, n, name, out = [], [], [], [], []
        for i, la, lo in ((r["id"], r["lat"], r["lon"]) for r in g):
            for c in range(len(n)):
                kx = 111320 * math.cos(math.radians((lat[c] + la) / 2))
                if math.hypot((lon[c] - lo) * kx, (lat[c] - la) * 110574) < radius_m:
                    lat[c], lon[c] = (lat[c] * n[c] + la) / (n[c] + 1), (lon[c] * n[c] + lo) / (n[c] + 1)
                    n[c] += 1
                    out.append(name[c])
                    break
            else:
                lat.append(la), lon.append(lo), n.append(1), name.append(i), out.append(i)
        return [(r["id"], c) for r, c in zip(g, out, strict=True)]

    return ordered_fold(nodes, ["_part"], [order], fold, "id long, cluster long")


def fold_similar(lines: DataFrame, group: str) -> DataFrame:
    """lines(group, line, family, stations array) -> (line, target): a line is folded into the first kept line of its
    group with which it shares 3 stations (same family), else max(3, 0.9 of the smaller one); the target then has both's stations."""

    def fold(g):
        kept: list[list] = []
        out = []
        for line, family, st in ((r["line"], r["family"], r["stations"]) for r in g):
            own = set(st)
            for k in kept:
                shared = len(own & k[2])
                if shared >= (3 if k[1] == family else max(3, 0.9 * min(len(own), len(k[2])))):
                    k[2] |= own
                    out.append(k[0])
                    break
            else:
                kept.append([line, family, own])
                out.append(line)
        return [(r["line"], t) for r, t in zip(g, out, strict=True)]

    return ordered_fold(lines, [group], ["line"], fold, "line long, target long")


def greedy_matching(pairs: DataFrame, group: str, rows: int = 0) -> DataFrame:
    """pairs(group, a, b, d) -> (group, a, b, d): by ascending distance, each a and b used once. Ties: least a, then b."""

    def fold(g):
        used_a, used_b = set(), set()
        for r in g:
            if r["a"] not in used_a and r["b"] not in used_b:
                used_a.add(r["a"]), used_b.add(r["b"])
                yield r[group], r["a"], r["b"], r["d"]

    return ordered_fold(pairs, [group], ["d", "a", "b"], fold, f"{group} long, a long, b long, d double", rows)


def schedule(jobs: DataFrame, machines: DataFrame, group: str, changeover_s: float = CHANGEOVER_S) -> DataFrame:
    """jobs(group, job, seconds, kind), machines(group, machine, kind, factor, ord) -> (group, job, machine, start_s, end_s).

    Longest job first; each goes to the eligible machine that would end it first
    (the first of those that tie), which is free again after the changeover.
    Jobs without an eligible machine are left out. A null kind fits all.
    """
    names = machines.select(group, F.lit(None).cast("double").alias("minus"), F.col("ord").cast("long").alias("job"), F.col("factor").alias("seconds"), "kind", "machine")
    own = jobs.select(group, (-F.col("seconds")).alias("minus"), "job", F.col("seconds").cast("double").alias("seconds"), "kind", F.lit(None).cast("string").alias("machine"))

    def fold(g):  # machines come first, as nulls sort before all
        pool = [dict(machine=r["machine"], kind=r["kind"], factor=r["seconds"], free=0.0) for r in g if r["machine"] is not None]
        for job, sec, kind in ((r["job"], r["seconds"], r["kind"]) for r in g if r["machine"] is None):
            fit = [m for m in pool if kind is None or m["kind"] == kind]
            if not fit:
                continue
            best = min(fit, key=lambda m: m["free"] + sec * m["factor"])
            start, end = best["free"], best["free"] + sec * best["factor"]
            best["free"] = end + changeover_s
            yield g[0][group], job, best["machine"], start, end

    return ordered_fold(names.unionByName(own), [group], ["minus", "job"], fold, f"{group} long, job long, machine string, start_s double, end_s double")


def shelves(items: DataFrame, group: str, width: float, height: float) -> DataFrame:
    """items(group, item, w, h) -> (group, item, plate, x, y): tallest first, left to right in rows, rows upwards, plate after plate.

    An item larger than the plate gets a plate of its own at its corner.
    """

    def fold(g):
        plate, x, y, row = 1, 0.0, 0.0, 0.0
        for item, w, h in ((r["item"], r["w"], r["h"]) for r in g):
            if x > 0 and x + w > width:
                x, y, row = 0.0, y + row, 0.0
            if (x > 0 or y > 0) and y + h > height:
                plate, x, y, row = plate + 1, 0.0, 0.0, 0.0
            yield g[0][group], item, plate, x, y
            x, row = x + w, max(row, h)

    return ordered_fold(items.withColumn("minus", -F.col("h")), [group], ["minus", "item"], fold, f"{group} long, item long, plate long, x double, y double")
