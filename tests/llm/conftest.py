"""Edge rows that every operator must stand: nulls in any column, empty and long texts, ties, repeated rows, extra columns."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, key string, ids string, n int"


@pytest.fixture(scope="session")
def edge(spark):
    words = " ".join(f"w{k}" for k in range(400))
    rows = [
        (1, words, "en", "a", 10),
        (2, words, "en", "a", 10),
        (2, words, "en", "a", 10),
        (3, None, None, None, None),
        (4, "", "", "", 0),
        (5, " \n\t ", "en", "b", 4),
        (None, "the same words here again and again", "en", None, 1),
        (None, None, None, None, None),
        (6, words + " one more end", "de", "b", 9),
        (7, "The quick <|endoftext|> \U0001f600 brown \x1c fox\n\njumps " * 3000, "en", "a", 5),
        (8, "a" * 20000, "en", "c", 5),
        (9, "Der schnelle Fuchs und die Katze sind nicht im Haus", "de", "c", 5),
    ]
    return spark.createDataFrame([(*r, 1, "k", "i", 2) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
