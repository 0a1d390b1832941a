"""Mixing sources to target weights by systematic sampling.

Each document of a source is expected target/size times in the mix. In each
source, documents stand in a fixed order (by size, then by a hash), their
expected copies are summed up along it, one random offset is added, and a
document is taken once for every whole number that its stretch of the sum
crosses. Ordering by size makes all sizes appear in their share, so the words
taken come near the target.

A source may hold a third of all rows, so the running count is not one window
over a source. It is built from four levels: size classes of the source, two
digits of the hash, and the row's place in what is left, each a window over at
most a few hundred entries or one small leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes(source, source_size) -> source, source_size, target.

    Sources in code point order, null last, get the weights in turn and share
    the total size by them; none gets more than ``most`` times its size, and what
    that leaves is shared by the others' weights. The level at which all is given
    out is found in one pass over the sources in order of size/weight: a source
    is full if its bound lies under what the ones after it would get.
    The table of sources is taken to be small, as its weights are set by hand.
    """
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(turn) - 1) % len(weights) + 1).cast("int"))
    s = sizes.select("source", "source_size").withColumn("w", pick.cast("long")).withColumn("bound", F.col("source_size") * most)
    before = Window.orderBy(F.col("bound") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("bound").over(before), F.lit(0))
    weight = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))
    s = s.withColumn("level", left.cast("double") / weight.cast("double")).withColumn("ok", F.col("level") * F.col("w") <= F.col("bound"))
    level = F.coalesce(F.min(F.when(F.col("ok"), F.struct(F.col("bound") / F.col("w"), "level"))).over(every)["level"], F.lit(0.0))
    return s.withColumn("level", level).select("source", "source_size", F.least(F.col("bound").cast("double"), F.col("level") * F.col("w")).alias("target"))


def size_class(size: Column) -> Column:
    """The size with all but its seven leading binary digits set to zero."""
    drop = F.greatest(F.length(F.bin(size)) - 7, F.lit(0))
    return (F.floor(size / F.pow(F.lit(2.0), drop)) * F.pow(F.lit(2.0), drop)).cast("long")


def _ranked(docs: DataFrame) -> DataFrame:
    """Adds __nl_rank, the place of each row in its source by (class, hash, id), from 1, without a window over a source."""
    leaf = ["source", "__nl_class", "__nl_d1", "__nl_d2"]
    docs = docs.withColumns({"__nl_class": size_class(F.col("size")), "__nl_d1": F.substring("__nl_h", 1, 2), "__nl_d2": F.substring("__nl_h", 3, 2)})
    counts = docs.groupBy(*leaf).agg(F.count("*").alias("n"))

    def before(table: DataFrame, depth: int) -> DataFrame:
        w = Window.partitionBy(*leaf[:depth]).orderBy(leaf[depth]).rowsBetween(Window.unboundedPreceding, -1)
        return table.groupBy(*leaf[: depth + 1]).agg(F.sum("n").alias("n")).withColumn(f"b{depth}", F.coalesce(F.sum("n").over(w), F.lit(0))).drop("n")

    found = counts
    for depth in (1, 2, 3):
        b = before(counts, depth).withColumnsRenamed({k: f"{k}_r" for k in leaf[: depth + 1]})
        cond = F.col("source").eqNullSafe(F.col("source_r"))
        for k in leaf[1 : depth + 1]:
            cond = cond & (F.col(k) == F.col(f"{k}_r"))
        found = found.join(b, cond).drop(*[f"{k}_r" for k in leaf[: depth + 1]])
    offsets = found.select(F.col("source").alias("__nl_s"), *[F.col(k).alias(f"{k}_o") for k in leaf[1:]], (F.col("b1") + F.col("b2") + F.col("b3")).alias("__nl_before"))
    place = Window.partitionBy(*leaf).orderBy("__nl_h", "doc_id")
    ranked = docs.withColumn("__nl_place", F.row_number().over(place))
    cond = F.col("source").eqNullSafe(F.col("__nl_s"))
    for k in leaf[1:]:
        cond = cond & (F.col(k) == F.col(f"{k}_o"))
    out = ranked.join(offsets, cond).withColumn("__nl_rank", F.col("__nl_before") + F.col("__nl_place"))
    return out.drop("__nl_s", *[f"{k}_o" for k in leaf[1:]], *leaf[1:], "__nl_before", "__nl_place")


def offset(source: Column, seed: str = SEED) -> Column:
    """The random offset of a source, in [0, 1): fixed by its name and the seed."""
    name = F.concat(F.lit(seed), F.coalesce(F.concat(F.lit(":"), source), F.lit("")))
    return F.conv(F.substring(F.md5(F.encode(name, "UTF-8")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """docs(doc_id, source, size long, ...) -> its columns, source_size, target, copies and taken; one row per input row.

    copies is how often the mix takes the document, from 0 to ``most``; taken is
    copies times size. For the mix itself, repeat each row ``copies`` times.

    A null source is one source, last in order. Null ids, repeated rows and
    rows that tie in size stand in the order of their hashes; rows alike in all
    of source, size and id are exchangeable, so reruns agree. A source of size 0
    has target 0 and takes nothing. An empty table gives an empty result.
    Columns other than those named above may be present, and are kept.
    """
    docs = docs.withColumn("__nl_h", F.md5(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")))
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    shares = scratch(targets(sizes, weights, most).coalesce(1), "targets").withColumnRenamed("source", "__nl_t")
    ranked = _ranked(docs)
    out = ranked.join(shares, F.col("source").eqNullSafe(F.col("__nl_t")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(0.0)
    u = offset(F.col("source"), seed)
    copies = F.floor(rate * F.col("__nl_rank").cast("double") + u) - F.floor(rate * (F.col("__nl_rank") - 1).cast("double") + u)
    out = out.withColumn("copies", F.least(copies, F.lit(most)).cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    return out.drop("__nl_h", "__nl_t", "__nl_rank")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, source_size * 3 AS bound FROM s
), l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(bound) OVER b, 0) AS DOUBLE) / CAST(sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS DOUBLE) AS level FROM w
  WINDOW b AS (ORDER BY bound / CAST(w AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(CAST(bound AS DOUBLE), w * (SELECT coalesce(arg_min(level, bound / CAST(w AS DOUBLE)), 0) FROM l WHERE level * w <= bound)) AS target FROM l
), r AS (
  SELECT d.*, t.source_size, t.target, row_number() OVER (PARTITION BY d.source ORDER BY
      CAST(floor(size / pow(2.0, greatest(length(bin(size)) - 7, 0))) * pow(2.0, greatest(length(bin(size)) - 7, 0)) AS BIGINT), h, doc_id) AS rank,
    CASE WHEN t.source_size > 0 THEN t.target / CAST(t.source_size AS DOUBLE) ELSE 0 END AS rate,
    CAST(CAST('0x' || substr(md5('mix' || coalesce(':' || d.source, '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, size * CAST(least(floor(rate * rank + u) - floor(rate * (rank - 1) + u), 3) AS BIGINT) AS taken FROM r
"""
