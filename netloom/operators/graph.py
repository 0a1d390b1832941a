"""Graph operators on edge tables (a, b)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import saved


def both_ways(edges: DataFrame) -> DataFrame:
    e = edges.filter("a <> b").select("a", "b")
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def degrees(edges: DataFrame) -> DataFrame:
    """Distinct neighbours of each node."""
    return both_ways(edges).groupBy(F.col("a").alias("station")).agg(F.countDistinct("b").alias("degree"))


def majors(colours: DataFrame, degree: DataFrame) -> DataFrame:
    """Nodes where lines meet, end or branch: several colours, or not just two neighbours."""
    n = F.coalesce("degree", F.lit(0)).cast("long")
    return colours.join(degree, "station", "left").select("station", n.alias("degree"), "n_colours", ((F.col("n_colours") > 1) | (n != 2)).alias("major"))


def shared_stations(served: DataFrame, group: str) -> DataFrame:
    """Pairs of lines of one group with the number of stations that they share, and each line's number of stations."""
    n = served.groupBy("line").agg(F.count("*").alias("n"))
    x = served.select(F.col("line").alias("a"), "station", group)
    y = served.select(F.col("line").alias("b"), "station", group)
    p = x.join(y, ["station", group]).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    return p.join(n.select(F.col("line").alias("a"), F.col("n").alias("n_a")), "a").join(n.select(F.col("line").alias("b"), F.col("n").alias("n_b")), "b")


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id that each node reaches.

    Alternates two steps: every node's larger neighbours are linked to the least
    node in reach (large star), then every node and its smaller neighbours are
    (small star), until only stars are left. The rounds are logarithmic in the
    longest chain; each is written to shared storage, which ends the lineage.
    """
    e = saved(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = None
    while True:
        ways = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        reach = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = ways.filter("v > u").join(reach, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = saved(small.distinct(), "stars")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def corridors(edges: DataFrame, major: DataFrame) -> DataFrame:
    """Chains of nodes between majors, each once, the smaller end first: (a, b, path). Nodes that are no majors have two neighbours.

    Each directed edge points at the one that follows it behind a node between;
    pointers are doubled until they stand at an edge into a major, which takes
    rounds logarithmic in the longest chain. Edges with the same last edge, in
    order of their distance from it, are a corridor. Rings without a major are
    none: their pointers are left when a round ends no other.
    """
    e = saved(both_ways(edges).distinct(), "edges")
    m = major.select(F.col("station").alias("b")).distinct().withColumn("end", F.lit(True))
    e = saved(e.join(m, "b", "left").select("a", "b", F.coalesce("end", F.lit(False)).alias("end")), "ends")
    last = e.filter("end").select("a", "b", F.col("a").alias("x"), F.col("b").alias("y"), F.lit(0).cast("long").alias("n"), "end")
    follow = e.select(F.col("a").alias("x"), F.col("b").alias("y"))
    step = e.filter("not end").join(follow, (F.col("b") == F.col("x")) & (F.col("a") != F.col("y"))).select("a", "b", "x", "y", F.lit(1).cast("long").alias("n"), "end")
    at = saved(last.unionByName(step), "pointers")
    left = at.filter("not end").count()
    while left:
        to = at.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("n").alias("n2"), F.col("end").alias("end2"))
        moved = at.filter("not end").join(to, ["x", "y"]).select("a", "b", F.col("x2").alias("x"), F.col("y2").alias("y"), (F.col("n") + F.col("n2")).alias("n"), F.col("end2").alias("end"))
        at = saved(at.filter("end").unionByName(moved), "pointers")
        now = at.filter("not end").count()
        if now == left:
            break
        left = now
    paths = at.filter("end").groupBy("x", "y").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "a"))).alias("s"))
    path = paths.select(F.concat(F.transform("s", lambda v: v["a"]), F.array("y")).alias("path"))
    back = F.reverse("path")
    canonical = F.when(F.col("path") <= back, F.col("path")).otherwise(back)
    return path.select(canonical.alias("path")).distinct().select(F.element_at("path", 1).alias("a"), F.element_at("path", -1).alias("b"), "path")


def hops(edges: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """(start, id, depth): breadth-first distance from each start, up to ``most`` steps."""
    e = saved(both_ways(edges).distinct(), "edges")
    seen = starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth"))
    edge = seen
    for k in range(1, most + 1):
        nxt = edge.join(e, edge["id"] == e["a"]).select("start", F.col("b").alias("id")).distinct()
        edge = saved(nxt.join(seen.select("start", "id"), ["start", "id"], "left_anti").withColumn("depth", F.lit(k)), "hops")
        if edge.isEmpty():
            break
        seen = seen.unionByName(edge)
    return seen


def top(df: DataFrame, keys: list[str], n: int, *order, spread: str | None = None) -> DataFrame:
    """The first n rows of each group, with _r. With ``spread``, a column that tells rows apart, groups are first cut to n in 64 parts each, so a large one is no single window."""
    if spread:
        part = F.pmod(F.xxhash64(spread), F.lit(64))
        w = Window.partitionBy(*keys, "_part").orderBy(*order)
        df = df.withColumn("_part", part).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_part", "_r")
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= n)
