import pytest
from pyspark.sql import functions as F

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from it", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog and runs away from it", "en", "a"),
    (3, None, "en", "a"),
    (4, "", "de", None),
    (5, " \t\n ", None, "b"),
    (6, "12345 !!! ???", "en", "b"),
    (7, "Der schnelle braune Fuchs springt über den faulen Hund und läuft davon", "de", "b"),
    (None, "Nobody knows my number", "en", "c"),
    (8, "wort " * 60_000, "de", "c"),
    (9, "x" * 300_000, "en", None),
    (10, "one", "en", "a"),
    (10, "one", "en", "a"),
]


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in any column, empty and long texts, repeated rows, and columns whose names operators use."""
    rows = [(*r, 0, "mine", 1.5, 7) for r in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, score double, _key long")


@pytest.fixture(scope="session")
def no_docs(messy):
    return messy.where(F.lit(False))
