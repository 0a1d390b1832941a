"""Helpers shared by the training-data operators: words, keys, scratch tables.

Every operator here keeps the columns of its input apart from its own: it first
selects what it reads, and joins decisions back by a document key, so extra
columns (also ones named like a result) never clash.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What parts words: the space and U+0009 to U+000D, nothing else.
SPACE_CHARS = " \t\n\x0b\f\r"
SPACES = r"[\x20\x09-\x0D]+"
KEY = ["__nl_id", "__nl_k1", "__nl_k2"]
#: A key with one in so many of all rows is frequent: there are at most so many of them.
FREQUENT = 1000


def let(value: Column, body) -> Column:
    """``body`` over ``value``, which is evaluated once (a lambda variable holds it)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text as an array; empty for null or blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def with_key(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds the document key: the id and 128 bits of the text. Rows equal in both are one document."""
    return df.withColumns(
        {
            KEY[0]: F.col(id_col),
            KEY[1]: F.xxhash64(F.col(text_col)),
            KEY[2]: F.xxhash64(F.lit("second"), F.col(text_col)),
        }
    )


def same_key(a: DataFrame, b: DataFrame) -> Column:
    """Null-safe equality of the document keys of two frames."""
    cond = F.lit(True)
    for k in KEY:
        cond = cond & a[k].eqNullSafe(b[k])
    return cond


def equal(a: list, b: list) -> Column:
    return reduce(lambda x, y: x & y, (F.col(x) == F.col(y) for x, y in zip(a, b, strict=True)))


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], total: int, spread: list[str]) -> DataFrame:
    """rows with the columns of table(keys, n, ...), on equal keys; n is how many rows have them, ``total`` how many there are.

    Keys of a thousandth of all rows or more, of which there are a thousand at most, are sent to all tasks; their rows are
    spread by a hash of the columns ``spread``, so that no task of the other join gets such a key.
    """
    own = [c for c in table.columns if c not in keys]

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select(*[F.col(k).alias(f"{k}_{tag}") for k in keys], F.struct(*own).alias(f"__nl_{tag}"))

    often = F.col("n") * FREQUENT >= total
    hot, rest = F.broadcast(side(table.filter(often), "hot")), side(table.filter(~often), "rest")
    met = rows.join(hot, equal(keys, [f"{k}_hot" for k in keys]), "left")
    met = met.withColumn("__nl_to", F.when(F.col("__nl_hot").isNull(), F.col(keys[0])).otherwise(F.xxhash64(*spread)))
    met = met.join(rest, equal(["__nl_to", *keys[1:]], [f"{k}_rest" for k in keys]), "left")
    found = met.withColumn("__nl_v", F.coalesce("__nl_hot", "__nl_rest")).filter("__nl_v is not null")
    return found.select(*rows.columns, *[F.col(f"__nl_v.{c}").alias(c) for c in own])


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir. Where that is unset, a session on one machine gets a folder of its own; a cluster is told to set it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="netloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def scratch(df: DataFrame, name: str, rows_a_file: int | None = None) -> DataFrame:
    """Writes a table into the shared folder and reads it: lineage ends there, and a lost executor costs nothing.

    A reader holds some 4,096 rows of one file at a time; for tables whose rows are large, ``rows_a_file`` is what it holds at most.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/netloom/{name}-{uuid.uuid4().hex}"
    writer = df.write if rows_a_file is None else df.write.option("maxRecordsPerFile", rows_a_file)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranked(rows: DataFrame, order: list[Column], most: int | None = None) -> DataFrame:
    """Adds rank: the place of each row in the whole order, from 1, up to ``most``; null for the rest.

    Rows are sorted by ranges and written; a place is that in its range, plus the rows of the ranges before. What is
    gathered is one count for each partition.
    """
    placed = scratch(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__nl_at", F.monotonically_increasing_id()), "placed")
    part, before, table = F.shiftright("__nl_at", 33), 0, []
    for p, n in sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()):
        table.append((p, before))
        before += n
    starts = rows.sparkSession.createDataFrame(table, "__nl_p long, __nl_before long")
    rank = F.col("__nl_before") + F.col("__nl_at").bitwiseAND((1 << 33) - 1) + 1
    found = rank if most is None else F.when(rank <= most, rank)
    return placed.join(F.broadcast(starts), part == F.col("__nl_p")).withColumn("rank", found).drop("__nl_at", "__nl_p", "__nl_before")


def clear_scratch(spark: SparkSession) -> None:
    """Removes the intermediate tables once results are written."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/netloom")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_over(df: DataFrame, limit: int) -> bool:
    """Whether the frame has more rows than the limit; reads no more than needed."""
    return df.limit(limit + 1).count() > limit


__all__ = ["F", "KEY", "SPACES", "SPACE_CHARS", "Window", "clear_scratch", "equal", "let", "lookup", "n_words", "ranked", "rows_over", "same_key", "scratch", "shared_dir", "table", "with_key", "words"]
