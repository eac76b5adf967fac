"""Documents that the tests of the corpus operators share."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 string, row string, h int, n double, word string, found string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, lang]) with extra columns whose names the operators use inside."""

    def documents(rows):
        full = []
        for r in rows:
            doc_id, text, lang = (*r, None)[:3]
            full.append((doc_id, text, lang, None, None if text is None else len(text), "x", None, 1, None, "w", "f"))
        return spark.createDataFrame(full, SCHEMA)

    return documents


LONG = " ".join(f"w{i % 977}q{i % 13}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty and very long texts, ties, repeated rows."""
    return make(
        [
            (1, None, "en"), (2, "", "en"), (3, "a b c", None), (3, "a b c", None), (None, "a b c", "de"), (None, None, None),
            (4, LONG, "en"), (5, LONG + " end", "en"), (6, "!!! ??? 123", "fr"), (7, "\n\n\n", "en"), (8, "é ü 漢字 \U0001f600", "de"),
            (9, "<|endoftext|> password = <|endoftext|>", "en"),
        ]
    )


@pytest.fixture(scope="session")
def empty(make):
    return make([])
