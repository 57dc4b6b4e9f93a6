import pytest

from quillspark.llm.queries import table

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, fp string, terms int, spans string"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return table(spark, sf, "documents")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and blank texts, a long one, repeated rows and ids, columns with clashing names."""
    base = "the quick brown fox jumps over the lazy dog and runs away from here at once"
    rows = [
        (1, base, "en", "a", 10), (1, base, "en", "a", 10), (2, base, "en", None, None), (3, None, None, None, None), (4, "", "en", "b", 0),
        (5, " \n\t ", "en", "b", 4), (None, base + " again", "en", "c", 1), (None, None, None, None, None), (7, "Straße und Bäume im Wald sind schön", "de", "c", 9),
        (7, "ein anderer Text mit anderer Nummer", "de", "c", 9), (8, ("mot " * 60000) + "fin", "fr", "d", 1), (9, "12345 !!! 678", "en", "d", 3), (10, "😀 \U0001d400 á ǅ", "en", "d", 3),
    ]
    return spark.createDataFrame([(*r, "x", "y", 1, "z") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
