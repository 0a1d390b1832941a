"""Operators on ordered sequences: rows with a sequence key, an ordinal and a value.

Order is always explicit: a sequence is a set of rows with an ordinal column,
never the order in which rows happen to arrive. Every window is partitioned by
the sequence, so work spreads over sequences and one shuffle on the key serves
all operators in a chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import saved


def _by(keys: list[str], *order: str | Column):
    return Window.partitionBy(*keys).orderBy(*order)


def drop_consecutive_duplicates(df: DataFrame, keys: list[str], ord_: str, value: str) -> DataFrame:
    """Rows whose value differs from the row before in their sequence."""
    before = F.lag(value).over(_by(keys, ord_))
    return df.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col("_before") != F.col(value))).drop("_before")


def steps(df: DataFrame, keys: list[str], ord_: str, value: str) -> DataFrame:
    """(keys, ord, a, b) for each pair of consecutive values."""
    nxt = F.lead(value).over(_by(keys, ord_))
    return df.select(*keys, ord_, F.col(value).alias("a"), nxt.alias("b")).filter("b is not null")


def undirected(edges: DataFrame) -> DataFrame:
    """Edges with the smaller end first, loops dropped."""
    return edges.filter("a <> b").withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")})


def termini(df: DataFrame, keys: list[str], ord_: str, value: str) -> DataFrame:
    """First and last value of each sequence: one aggregation, combined before the shuffle."""
    return df.groupBy(*keys).agg(F.min_by(value, ord_).alias("first_value"), F.max_by(value, ord_).alias("last_value"))


def renumber(df: DataFrame, keys: list[str], *order: str | Column, name: str = "ord") -> DataFrame:
    return df.withColumn(name, F.row_number().over(_by(keys, *order)).cast("long"))


def numbered(df: DataFrame, keys: list[str], *order: str | Column, name: str = "ord") -> DataFrame:
    """As renumber, for keys that may hold any share of all rows: no window over a key.

    Rows are sorted by ranges of (keys, order) and written; a row's number is its place among those of its key in its
    range, plus what the key has in the ranges before. Keys must not be null.
    """
    by = [*keys, *order]
    placed = saved(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    begin = placed.groupBy(*keys, part.alias("_p")).agg(F.min("_at").alias("_min"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(_by(keys, "_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begin = begin.select(*keys, "_p", (before - F.col("_min") + 1).alias("_shift"))
    return placed.withColumn("_p", part).join(begin, [*keys, "_p"]).withColumn(name, F.col("_at") + F.col("_shift")).drop("_p", "_at", "_shift")


def tag(prefix: str, n: Column, width: int) -> Column:
    """Zero-padded tag; numbers that are longer keep all digits."""
    s = n.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s))


def unique_ids(df: DataFrame, base: str, *order: str | Column, name: str = "id") -> DataFrame:
    """x, x-2, x-3, ... for rows that share a base id, in order."""
    n = F.row_number().over(_by([base], *order))
    return df.withColumn(name, F.when(n == 1, F.col(base)).otherwise(F.concat_ws("-", F.col(base), n.cast("string"))))


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The entry at place floor(n/2), from 0, of the sorted values of each group."""
    w = Window.partitionBy(*keys)
    ranked = df.filter(F.col(value).isNotNull()).withColumn("_n", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy(value)))
    return ranked.filter(F.col("_r") == F.floor(F.col("_n") / 2) + 1).select(*keys, F.col(value).alias("upper_median"))


def first_of(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The first row of each group; the order must break all ties."""
    return df.withColumn("_r", F.row_number().over(_by(keys, *order))).filter("_r = 1").drop("_r")


def arc_length(df: DataFrame, keys: list[str], ord_: str, x: str = "x", y: str = "y") -> DataFrame:
    """Adds step (length of the segment that ends here) and s (length from the start)."""
    w = _by(keys, ord_)
    step = F.coalesce(F.sqrt(F.pow(F.col(x) - F.lag(x).over(w), 2) + F.pow(F.col(y) - F.lag(y).over(w), 2)), F.lit(0.0))
    return df.withColumn("step", step).withColumn("s", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def carry_last(df: DataFrame, keys: list[str], ord_: str, **values: Column) -> DataFrame:
    """Modal state: for each new column, the last value of its expression that is not null, up to and with the row."""
    w = _by(keys, ord_).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({k: F.last(v, ignorenulls=True).over(w) for k, v in values.items()})


def segmented_sum(df: DataFrame, keys: list[str], ord_: str, reset: Column, amount: Column, name: str) -> DataFrame:
    """Running sum that starts anew (with the row's own amount) where reset holds."""
    w = _by(keys, ord_).rowsBetween(Window.unboundedPreceding, 0)
    cut = df.withColumn("_seg", F.sum(F.when(reset, 1).otherwise(0)).over(w))
    return cut.withColumn(name, F.sum(amount).over(Window.partitionBy(*keys, "_seg").orderBy(ord_).rowsBetween(Window.unboundedPreceding, 0))).drop("_seg")
