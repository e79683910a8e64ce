import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    rows = [
        (1, "a b c d e f g", "en", "s", 13, 1), (1, "a b c d e f g", "en", "s", 13, 1), (2, None, None, None, None, None), (3, "", "en", None, 0, 0),
        (4, long, "en", "s", len(long), 1), (5, long + " tail", "en", "t", len(long) + 5, 1), (None, "a b c d e f g", "en", "s", 13, None),
        (6, "a b c d e f g", "fr", "u", 13, 7), (7, "  \t\n ", "fr", "u", 5, 7), (8, "é ü 漢字 👍", "de", "", 7, 7),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra int")
    # names that the operators use inside
    return df.withColumn("size", F.lit("x")).withColumn("target", F.lit(1)).withColumn("n_words", F.lit("clash")).withColumn("component", F.lit(0)).withColumn("_k", F.lit(0))


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 0), (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
