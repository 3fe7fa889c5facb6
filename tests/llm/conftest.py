import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[2]), str(Path(__file__).resolve().parents[1])]

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, kept string, _row string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing names."""
    long_text = "the quick brown fox jumps over the lazy dog and runs home. " * 4000
    rows = [
        (1, "Hello there world of words", "en", "a", 5, 1, "x", "r"),
        (1, "Hello there world of words", "en", "a", 5, 1, "x", "r"),
        (2, "Hello  there\nworld of words", "en", "a", None, None, None, None),
        (3, "", "en", None, 0, 0, "", ""),
        (4, None, None, None, None, None, None, None),
        (None, "Hello there world of words", None, "b", 1, 1, "y", "s"),
        (None, None, "en", "b", 1, 1, "y", "s"),
        (5, long_text, "en", "c", 1, 1, "z", "t"),
        (6, long_text + "x", "en", "c", 1, 1, "z", "t"),
        (7, " \t\n\x0b\x0c\r ", "de", "d", 1, 1, "z", "t"),
        (8, "12345 !!! ---", "zz", "d", 1, 1, "z", "t"),
        (9, "\ufdd0a@b.cd 4111 1111 1111 1111 \U0001f600 +1 (555) 010-9999", "en", "d", 1, 1, "z", "t"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
