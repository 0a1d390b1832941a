"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, scratch


def _large_star(e: DataFrame) -> DataFrame:
    """The hubs of large stars are few; ``lookup`` spreads their links."""
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    return lookup(both.filter("v > u"), least, ["u"], 2 * e.count(), ["v"]).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    hop = e.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hop.unionByName(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """links(a, b) of two different long ids -> (id, component), the smallest id that each linked id reaches.

    Null ends and loops are ignored; repeated and reversed links are one. Ids
    without links are not in the result. The number of rounds is logarithmic
    in the longest chain; each round is written to the shared folder.
    """
    e = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = scratch(e, "links")
    mark = None
    while True:
        e = scratch(_small_star(_large_star(e)).distinct(), "stars")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = e.select(F.col("v").alias("id")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))


def extended(member: DataFrame, links: DataFrame) -> DataFrame:
    """What components gives for the links behind member(id, component) and these links(a, b) together: only components that the new links touch are worked on."""
    for end in ("a", "b"):
        links = links.join(member.withColumnsRenamed({"id": "__nl_i", "component": "__nl_c"}), F.col(end) == F.col("__nl_i"), "left").withColumn(end, F.coalesce("__nl_c", end)).drop("__nl_i", "__nl_c")
    joined = components(links)
    root = joined.select(F.col("id").alias("__nl_i"), F.col("component").alias("__nl_c"))
    old = member.join(root, F.col("component") == F.col("__nl_i"), "left").select("id", F.coalesce("__nl_c", "component").alias("component"))
    return scratch(old.unionByName(joined.join(member.select("id"), "id", "left_anti")), "members")
