"""Intervals [lo, hi) as rows: intersection, subtraction, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping and touching spans of each key as one."""
    w = Window.partitionBy(*keys).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    s = spans.withColumn("_new", (F.coalesce(F.col("lo") > F.max("hi").over(w), F.lit(True))).cast("int"))
    s = s.withColumn("_grp", F.sum("_new").over(Window.partitionBy(*keys).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy(*keys, "_grp").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_grp")


def intersect(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Common parts of spans of equal keys."""
    y = b.select(*keys, F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    j = a.select(*keys, "lo", "hi").join(y, keys).filter("lo < hi2 and lo2 < hi")
    return j.select(*keys, F.greatest("lo", "lo2").alias("lo"), F.least("hi", "hi2").alias("hi"))


def subtract(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """What of the spans of a no span of b covers.

    One pass over the ends of both sides, in order: a stretch between two ends is kept where some
    span of a and none of b is open.
    """
    ends = None
    for df, da, db in ((a, 1, 0), (b, 0, 1)):
        e = df.select(*keys, F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(da).alias("da"), F.lit(db).alias("db")), F.struct(F.col("hi").alias("at"), F.lit(-da).alias("da"), F.lit(-db).alias("db")))).alias("e")).select(*keys, "e.*")
        ends = e if ends is None else ends.unionByName(e)
    return merged(_stretches(ends, keys).filter("na > 0 and nb = 0").select(*keys, "lo", "hi"), keys)


def _stretches(ends: DataFrame, keys: list[str]) -> DataFrame:
    at = ends.groupBy(*keys, "at").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    w = Window.partitionBy(*keys).orderBy("at")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return at.select(*keys, F.col("at").alias("lo"), F.lead("at").over(w).alias("hi"), F.sum("da").over(run).alias("na"), F.sum("db").over(run).alias("nb")).filter("hi is not null")


def covered_by(spans: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Stretches that at least n spans cover."""
    ends = spans.select(*keys, F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("da")), F.struct(F.col("hi").alias("at"), F.lit(-1).alias("da")))).alias("e")).select(*keys, "e.at", "e.da", F.lit(0).alias("db"))
    return merged(_stretches(ends, keys).filter(F.col("na") >= n).select(*keys, "lo", "hi"), keys)
