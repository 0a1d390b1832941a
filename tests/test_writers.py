import os

import pytest
from pyspark.sql import functions as F

from netloom.operators.shared import clear_saved, saved
from netloom.sources import writers

ROWS = [(1, 'a,"b"', "x"), (2, "two\nlines", ""), (3, None, "é日本"), (4, "", None), (5, "\\N is not null", '"')]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(ROWS, "id int, a string, b string")


def test_json_and_csv_come_back_equal(rows, spark, tmp_path):
    for write, read in ((writers.write_json, writers.read_json), (writers.write_csv, writers.read_csv)):
        path = f"{tmp_path}/{write.__name__}"
        write(rows, path)
        assert sorted(map(tuple, read(spark, path, rows.schema).collect())) == ROWS
    assert sorted(os.listdir(tmp_path)) == ["write_csv", "write_json"]


def test_one_file_for_each_key(spark, tmp_path):
    df = spark.range(100).select((F.col("id") % 7).alias("job"), (-F.col("id")).alias("n"), F.concat(F.lit("line "), F.col("id").cast("string")).alias("line"))
    writers.write_texts(df, f"{tmp_path}/jobs", "job", "n", "line")
    got = {r["key"]: r["text"] for r in writers.read_texts(spark, f"{tmp_path}/jobs").collect()}
    assert got == {str(k): "".join(f"line {i}\n" for i in reversed(range(k, 100, 7))) for k in range(7)}


def test_a_failed_write_leaves_the_older_result(rows, spark, tmp_path):
    path = f"{tmp_path}/out"
    writers.write_json(rows, path)
    bad = rows.withColumn("a", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        writers.write_json(bad, path)
    assert writers.read_json(spark, path, rows.schema).count() == len(ROWS)
    writers.write_json(rows.limit(2), path)
    assert writers.read_json(spark, path, rows.schema).count() == 2 and os.listdir(tmp_path) == ["out"]


def test_intermediate_tables_are_cleared(rows, spark, monkeypatch, tmp_path):
    from netloom.operators import shared

    monkeypatch.setattr(shared, "shared_root", lambda _: f"file://{tmp_path}")
    saved(rows, "t")
    assert os.listdir(f"{tmp_path}/netloom")
    clear_saved(spark)
    assert not os.path.exists(f"{tmp_path}/netloom")
