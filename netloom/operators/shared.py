"""Intermediate tables in storage that all executors share."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What a task sorts or groups at once, at most: so its memory does not grow with the input.
ROWS_A_TASK = 250_000

#: The folder of a session on one machine that names none; the setting itself cannot be changed in a session.
_OWN: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a session on one machine gets a folder of its own; a cluster is told to set it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _OWN.setdefault("root", "file://" + tempfile.mkdtemp(prefix="netloom-"))
    return root


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it again: lineage ends, a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/netloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, keys: list[str], rows: int, always: bool = False) -> DataFrame:
    """The frame dealt by its keys to as many tasks as ``rows`` rows need, by number: shuffle partitions without a number are
    merged when a query runs, so that a task's rows would grow with the input. What one task can hold is dealt to the
    session's partitions (``always``) or left as it is."""
    n = math.ceil(rows / ROWS_A_TASK)
    if n > 1:
        return df.repartition(max(n, df.sparkSession.sparkContext.defaultParallelism), *keys)
    return df.repartition(*keys) if always else df


def clear_saved(spark: SparkSession) -> None:
    """Removes the intermediate tables, once results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/netloom")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
