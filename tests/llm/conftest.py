import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Null, empty and blank texts, null ids, ties, repeated rows.
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", None, "a", 4), (None, "one two three four five six seven", "en", None, 33),
    (4, "word", "en", "b", 4), (4, "word", "en", "b", 4), (5, "a b c d e f g h i j k l", "en", "b", 23), (6, "a b c d e f g h i j k l", "en", "b", 23),
    (7, "Ünïcödé 日本語   x y !", "de", "b", 20),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows, with an extra column that has a result's name."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(ODD, DOCS).withColumns({"n_words": F.lit("x"), "kept": F.lit(7), "size_": F.lit(1)})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
