from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators use themselves.
CLASHES = "score string, id int, node int, n int, start int, nearest int, ids int, lang_pred int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and blank texts, a long text, ties, repeated rows, and clashing extra columns."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 3),
        (4, "The small dog runs home now, over the hill.", "en", "a", 43),
        (5, "The small dog runs home now, over the hill.", "en", "a", 43),
        (5, "The small dog runs home now, over the hill.", "en", "a", 43),
        (6, long, "en", "b", len(long)), (None, "Der kleine Hund ist sehr gross und alt.", "de", None, 1),
        (7, "Der kleine Hund ist sehr gross und alt.", "de", "b", -1), (8, "1234 !!! ...", None, "b", 12),
        (9, "one two", None, "c", 7), (10, "ONE\vtwo", None, "c", 7),
    ]
    extra = ("x", 1, 2, 3, 4, 5, 6, 7)
    return spark.createDataFrame([(*r, *extra) for r in rows], f"{DOCS}, {CLASHES}")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], f"{DOCS}, {CLASHES}")


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"
