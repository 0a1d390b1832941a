"""Committed writes: a reader finds the old result or the new one, never a part of one.

Spark's tasks write into a staging folder beside the target, where a lost
executor's attempts leave nothing that counts; when the job has ended, the folder
takes the target's place by renaming.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import partial
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import dealt

#: The table of the files that write_texts wrote, in the folder that holds them; readers of files pass it over.
INDEX = "_files"


def committed(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Calls ``write`` with a staging folder, and renames that to ``path``; an older result stays until then. After a failure the staging folder is removed and the older result stands."""
    jvm = spark._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    mark = uuid.uuid4().hex
    staging, old = f"{path}.staging-{mark}", f"{path}.old-{mark}"
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        write(staging)
        if fs.exists(at(path)):
            fs.rename(at(path), at(old))
        if not fs.rename(at(staging), at(path)):
            if fs.exists(at(old)):
                fs.rename(at(old), at(path))
            raise OSError(f"cannot rename to {path}")
    finally:
        fs.delete(at(staging), True)
        if fs.exists(at(path)):
            fs.delete(at(old), True)


def write_json(df: DataFrame, path: str) -> None:
    """A JSON object a row, one a line; nulls are left out."""
    committed(df.sparkSession, path, lambda to: df.write.json(to))


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """All fields quoted, quotes doubled, with a header; line breaks stay inside their fields. Null is an empty field without quotes, the empty string one with quotes."""
    opts = {"header": "true", "quoteAll": "true", "escape": '"', "emptyValue": '""', "nullValue": "\\N"}
    committed(df.sparkSession, path, lambda to: df.write.options(**opts).csv(to))


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).options(header="true", quote='"', escape='"', multiLine="true", mode="FAILFAST", emptyValue="", nullValue="\\N").csv(path)


#: Folders of a key that is null (as Spark names it) or empty; no other key is written so. Bytes of texts in a batch, about.
_NULL, _EMPTY, _BATCH = "__HIVE_DEFAULT_PARTITION__", "%", 8 << 20


def _opened(path: str) -> fs.FileSystem | None:
    """The file system of a path for tasks that write files themselves; None where Arrow knows none."""
    try:
        return fs.FileSystem.from_uri(path)[0]
    except (pa.ArrowInvalid, OSError, ImportError):
        return None


def _folder(key: str | None) -> str:
    return "key=" + (_NULL if key is None else quote(key, safe="") or _EMPTY)


def _write_files(to: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's part: writes rows (key, value) sorted by key; a file has its name only once it is whole. Gives (key, file)."""
    store, root = fs.FileSystem.from_uri(to)
    at, out, part, done = None, None, "", []

    def finish():
        out.close()
        store.move(part, f"{root}/{_folder(at)}/lines.txt")
        done.append((at, f"{_folder(at)}/lines.txt"))

    for b in batches:
        for key, value in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if out is None or key != at:
                if out is not None:
                    finish()
                at = key
                store.create_dir(f"{root}/{_folder(at)}", recursive=True)
                part = f"{root}/{_folder(at)}/_{uuid.uuid4().hex}"
                out = store.open_output_stream(part)
            out.write(f"{value or ''}\n".encode())
    if out is not None:
        finish()
    yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], ["key", "file"])


def _read_files(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's part: (key, file) -> (key, text)."""
    store, root = fs.FileSystem.from_uri(path)
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["key", "text"])
    rows, size = [], 0
    for b in batches:
        for key, file in zip(*(c.to_pylist() for c in b.columns), strict=True):
            with store.open_input_stream(f"{root}/{file}") as f:
                text = f.read()
            rows.append((key, text.decode()))
            size += len(text)
            if size > _BATCH:
                yield batch(rows)
                rows, size = [], 0
    yield batch(rows)


def write_texts(df: DataFrame, path: str, key: str, order: str, line: str) -> None:
    """One text file for each key, its lines in order, in a folder named by the key; the files of many keys are written by many tasks, each file by one.

    Tasks write the files themselves and list them in a table beside them, so the driver neither moves nor lists a file. Where
    Arrow cannot open the path, Spark's writer does, which costs the driver time for each key.
    """
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(order).alias("_order"), F.col(line).alias("value"))
    lines = dealt(rows, ["key"], df.count(), always=True).sortWithinPartitions("key", "_order").select("key", "value")
    if _opened(path) is None:
        committed(df.sparkSession, path, lambda to: lines.write.partitionBy("key").text(to))
    else:
        committed(df.sparkSession, path, lambda to: lines.mapInArrow(partial(_write_files, to), "key string, file string").write.parquet(f"{to}/{INDEX}"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(key, text): the files that write_texts wrote, each as one text."""
    if _opened(path) is None:
        return spark.read.text(path, wholetext=True).select(F.col("key").cast("string").alias("key"), F.col("value").alias("text"))
    return spark.read.schema("key string, file string").parquet(f"{path}/{INDEX}").mapInArrow(partial(_read_files, path), "key string, text string")
