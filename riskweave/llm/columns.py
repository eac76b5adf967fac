"""Column expressions shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\f\r"


def text_of(col: str) -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; pure ASCII takes the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def hash_pair(*cols: Column) -> tuple[Column, Column]:
    """Two differently seeded 64-bit hashes: 128 bits name a text or line."""
    return F.xxhash64(*cols), F.xxhash64(F.lit(0x5BD1E995), *cols)


def with_text_key(docs, text: Column):
    """Add ``k1, k2``: rows with equal texts share them, so null or repeated ids do no harm."""
    k1, k2 = hash_pair(text)
    return docs.withColumns({"k1": k1, "k2": k2})
