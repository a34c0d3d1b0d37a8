import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, ties, repeated rows and a column that clashes with results."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog again and again", "en", "a"),
        (2, "the QUICK brown fox jumps over the lazy dog again and again", "en", "a"),
        (3, None, "en", "a"),
        (4, "", None, "b"),
        (5, "  \t\n ", "en", None),
        (6, "one two", "en", "b"),
        (7, "one\ntwo", "en", "b"),
        (8, "word " * 30_000, "en", "b"),
        (9, "der schnelle braune Fuchs springt über den faulen Hund", "de", "b"),
        (9, "der schnelle braune Fuchs springt über den faulen Hund", "de", "b"),
        (None, "a text without an id that is here all the same", "en", "b"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return frame.selectExpr("*", "'x' as shard", "1.5D as score", "'y' as host", "7L as n")
