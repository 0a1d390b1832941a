"""Reports written to files and read back: what comes back is what the tables hold."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import shared_root
from ..registry import query
from ..sources import writers
from .tables import table


def _target(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/netloom/{name}-{uuid.uuid4().hex}"


@query(
    "O07",
    "SELECT CAST(c_nationkey AS BIGINT) AS line, count(*) AS stations, CAST(round(sum(c_acctbal) * 100) AS BIGINT) AS cents, CAST(min(c_custkey) AS BIGINT) AS first_id, min(c_name) AS first_name FROM customer GROUP BY 1",
)
def json_documents(spark: SparkSession, d: str) -> DataFrame:
    """A document for each line, with a nested one, written as JSON and read back."""
    c = table(spark, d, "customer")
    docs = c.groupBy(F.col("c_nationkey").cast("long").alias("line")).agg(F.struct(F.count("*").alias("stations"), F.round(F.sum("c_acctbal") * 100).cast("long").alias("cents")).alias("totals"), F.struct(F.min("c_custkey").cast("long").alias("id"), F.min("c_name").alias("name")).alias("first"))
    path = _target(spark, "lines.json")
    writers.write_json(docs, path)
    return writers.read_json(spark, path, docs.schema).select("line", "totals.stations", "totals.cents", F.col("first.id").alias("first_id"), F.col("first.name").alias("first_name"))


@query(
    "O08 V06",
    """SELECT CAST(p_partkey AS BIGINT) AS part, 'R-' || CASE WHEN length(CAST(p_partkey % 100 AS VARCHAR)) < 2 THEN '0' ELSE '' END || CAST(p_partkey % 100 AS VARCHAR) AS tag, p_name || ', "' || p_brand || '"' || CASE WHEN p_partkey % 3 = 0 THEN chr(10) || p_type ELSE '' END AS label, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_brand END AS note FROM part""",
)
def tape_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels for tapes with commas, quotes, line breaks and empty fields, written as CSV and read back."""
    k = F.col("p_partkey")
    text = F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"'), F.when(k % 3 == 0, F.concat(F.lit("\n"), "p_type")).otherwise(F.lit("")))
    rows = table(spark, d, "part").select(k.cast("long").alias("part"), F.concat(F.lit("R-"), F.lpad((k % 100).cast("string"), 2, "0")).alias("tag"), text.alias("label"), F.when(k % 4 == 0, F.lit("")).otherwise(F.col("p_brand")).alias("note"))
    path = _target(spark, "labels.csv")
    writers.write_csv(rows, path)
    return writers.read_csv(spark, path, rows.schema)


@query(
    "O13 O09",
    """SELECT CAST(o_custkey AS VARCHAR) AS key, string_agg('| ' || o_orderkey || ' | ' || o_orderstatus || ' | ' || o_orderpriority || ' |' || chr(10), '' ORDER BY o_orderkey) AS text FROM orders GROUP BY 1""",
)
def report_files(spark: SparkSession, d: str) -> DataFrame:
    """A file of table lines for each customer, its orders in order, written and read back whole."""
    line = F.concat(F.lit("| "), F.col("o_orderkey").cast("string"), F.lit(" | "), "o_orderstatus", F.lit(" | "), "o_orderpriority", F.lit(" |"))
    path = _target(spark, "reports")
    writers.write_texts(table(spark, d, "orders").withColumn("line", line), path, "o_custkey", "o_orderkey", "line")
    return writers.read_texts(spark, path)
