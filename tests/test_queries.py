import pytest

from netloom import registry

FOUND = registry.all_queries()


@pytest.mark.parametrize("name", [k for k, q in FOUND.items() if q.oracle])
def test_against_sql(name, same):
    same(FOUND[name].fn, FOUND[name].oracle)


@pytest.mark.parametrize("name", [k for k, q in FOUND.items() if not q.oracle])
def test_folds_give_rows(name, spark, data_dir):
    assert FOUND[name].fn(spark, data_dir).count() > 0


def test_entry_without_training_data(monkeypatch):
    """The entry point works where the training-data package is not there, and hides no other import error."""
    import importlib

    import __spark_entry__ as e

    real = importlib.import_module

    def gone(name, *a):
        if name.startswith("netloom.llm"):
            raise ModuleNotFoundError(name=name)
        return real(name, *a)

    monkeypatch.setattr(importlib, "import_module", gone)
    assert "line_station_counts" in e.queries() and not any(k.startswith("op") and k[2].isdigit() for k in e.queries())

    def broken(name, *a):
        if name.startswith("netloom.llm"):
            raise ModuleNotFoundError(name="sentencepiece")
        return real(name, *a)

    monkeypatch.setattr(importlib, "import_module", broken)
    with pytest.raises(ModuleNotFoundError):
        e.queries()


def test_wikitext_counts_reads_whole_texts(spark, tmp_path):
    rows = [(1, "x" * 600 + " |stations = 4321"), (2, "no template"), (3, "x" * 20_000 + " |stations = 4321"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["n"] for r in FOUND["wikitext_counts"].fn(spark, str(tmp_path)).collect()}
    assert got == {1: 4321, 2: 2, 3: 3, 4: None}


def test_wikitext_oracle_reads_whole_texts(duck):
    con = duck.cursor()
    con.execute("CREATE TEMP TABLE documents AS SELECT 1 AS doc_id, repeat('x', 600) || ' |stations = 4321' AS text")
    assert con.sql(FOUND["wikitext_counts"].oracle).fetchall() == [(1, 4321)]
