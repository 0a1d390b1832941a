"""The driver's tables read as a network.

A stop pattern is an order, its stops are the order's lines, a station is a
part, and a line is the nation of the customer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sequence
from ..operators.shared import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stops(spark: SparkSession, sf_dir: str, rows: int = 1, beside: Column | None = None) -> DataFrame:
    """(seq, ord, station): ordered stops of all patterns. rows: how many rows each becomes in the tasks to which stops are dealt.
    beside: a column of seq; patterns for which it is the same are dealt to one task, and it is given as well."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("seq"), F.col("l_partkey").alias("station"), "l_linenumber", "l_suppkey")
    keys = ["seq"] if beside is None else ["beside", "seq"]
    li = dealt(li if beside is None else li.withColumn("beside", beside), keys[:1], rows * li.count())
    return sequence.renumber(li, keys, "l_linenumber", "station", "l_suppkey").select("seq", "ord", "station", *keys[:-1])


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, line): the line of each pattern."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("line"))
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select("seq", "line")


def line_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stops(spark, sf_dir).join(patterns(spark, sf_dir), "seq")


def lat(key: Column) -> Column:
    return F.lit(40.0) + (key * 7919 % 10007) / F.lit(10007.0)


def lon(key: Column) -> Column:
    return F.lit(-75.0) + (key * 104729 % 10009) / F.lit(10009.0)


def towns(key: Column) -> list[Column]:
    """lat and lon in towns of a hundred keys each, 2 km wide and far from each other: more rows make more towns, not denser ones."""
    n = F.floor(key / 100)
    return [(40 + (n % 700) * 0.05 + (key * 7919 % 101) / F.lit(5050.0)).alias("lat"), (-75 + F.floor(n / 700) * 0.05 + (key * 104729 % 103) / F.lit(5150.0)).alias("lon")]


STOPS = """
stops AS (
  SELECT l_orderkey AS seq, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ord, l_partkey AS station FROM lineitem
), patterns AS (
  SELECT o_orderkey AS seq, c_nationkey AS line FROM orders JOIN customer ON o_custkey = c_custkey
), line_stops AS (SELECT stops.*, line FROM stops JOIN patterns USING (seq))
"""
STATION = "p_partkey AS station, 40.0::DOUBLE + (p_partkey * 7919 % 10007) / 10007.0::DOUBLE AS lat, -75.0::DOUBLE + (p_partkey * 104729 % 10009) / 10009.0::DOUBLE AS lon"
