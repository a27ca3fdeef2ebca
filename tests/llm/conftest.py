import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names operators use."""
    long = "word and another thing, " * 4000
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "Hello there, good people of the town.", "en", None, 9), (3, "Hello there, good people of the town.", "en", None, 9), (4, long, None, "b", len(long)), (5, "x" * 30_000, "de", "b", 30_000), (None, "no id at all", "fr", "a", 12), (6, " \t\n ", "es", "a", 4), (7, "ñandú Straße ÇA!! 12 | 3", "es", "c", 24), (8, "12 34 !!", None, "c", 8)]
    df = spark.createDataFrame(rows, COLUMNS)
    return df.selectExpr("*", "1 AS score", "'k' AS key", "array(1) AS home", "2 AS fp", "3 AS n", "'t' AS topic")
