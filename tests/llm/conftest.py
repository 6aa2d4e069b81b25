import pytest
from pyspark.sql import functions as F

LONG = "alpha beta gamma delta epsilon zeta. " * 4000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, extra clashing columns."""
    rows = [(1, "one two three four five six", "en", "b"), (1, "one two three four five six", "en", "b"),
            (2, None, "en", "a"), (3, "", None, "a"), (4, " \t\n", "de", None), (None, "stray words here", None, None),
            (5, LONG, "en", "a"), (6, LONG, "en", "é"), (7, "ONE two Three four five six", "fr", "é"),
            (8, "only", "de", "b"), (9, "x y", "de", "b"), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    for name in ("size", "shard", "_g", "_row", "_key", "score", "fp", "_nth", "key", "path", "n"):
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    return docs


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("false")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
