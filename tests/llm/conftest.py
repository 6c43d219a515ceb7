import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def rows():
    return brute.corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, repeated rows, ties, empty and long texts, and columns named like the operators' own."""
    extra = ", n_words int, n_lines string, kept string, size string, copies int, score string, fp string, rank int"
    body = [
        (None, None, None, None, None),
        (None, "a b c d", "en", "a", 7),
        (5, None, None, None, None),
        (5, "same text\nhere", "en", None, 14),
        (5, "same text\nhere", "en", None, 14),
        (6, "same text\nhere", "en", "b", 14),
        (7, "", "de", "b", 0),
        (8, "word " * 30_000, "en", "b", 150_000),
        (9, "Ä" * 50_000 + "\n" + "line\n" * 3_000, "de", "c", 65_001),
        (2**53 + 1, "far id with some text", "en", "c", 21),
    ]
    tail = (1, "x", "y", "z", 2, "s", "f", 3)
    return spark.createDataFrame([(*b, *tail) for b in body], DOCS + extra)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
