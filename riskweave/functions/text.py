"""Scalar rules of the entity tables, all built from native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Id prefixes that mark an entity as present on a sanction list.
SANCTION_PREFIXES = (
    "OFAC_SDN",
    "EU_FINANCIAL_SANCTIONS",
    "UN_CONSOLIDATED",
    "UK_SANCTIONS",
    "WORLD_BANK_DEBARRED",
    "IDB_SANCTIONED",
    "SAT_69",
    "SAT_69B",
)

# Text that stands for "no country given".
NO_COUNTRY = ("unknown", "", "nan")
UNKNOWN_COUNTRY = "DESCONOCIDO"


def blank_to_null(c: Column) -> Column:
    """Trimmed text, with blanks as null."""
    return F.nullif(F.trim(c), F.lit(""))


def country_code(raw: Column, mapped: Column) -> Column:
    """Normalised country: unknown marker, mapped code, or first three letters.

    A three-letter code upper-cased equals its first three characters
    upper-cased, so one expression serves both rules.
    """
    clean = F.trim(raw)
    return F.when(
        clean.isNull() | F.lower(clean).isin(*NO_COUNTRY), F.lit(UNKNOWN_COUNTRY)
    ).otherwise(F.coalesce(mapped, F.upper(F.substring(clean, 1, 3))))


def entity_type(raw: Column) -> Column:
    """PM is a company, PF a person, everything else is other."""
    return F.when(raw == "PM", "MORAL").when(raw == "PF", "FISICA").otherwise("OTRO")


def is_review(raw: Column, mode: str = "strict") -> Column:
    """Review flag: exact true/1, or (``loose``) either token anywhere."""
    text = raw.cast("string")
    if mode == "strict":
        hit = F.lower(text).isin("true", "1")
    elif mode == "loose":
        hit = text.rlike("(?i)true|1")
    else:
        raise ValueError(f"unknown review mode {mode!r}")
    return F.coalesce(hit, F.lit(False))


def overall_decision(review_items: Column, evidence_items: Column) -> Column:
    return (
        F.when(review_items > 0, "needs_review")
        .when(evidence_items > 0, "accepted")
        .otherwise("no_match")
    )


def to_long(raw: Column) -> Column:
    """Number text to LONG; blanks, words and "2.0" all handled, never raising."""
    return raw.try_cast("double").try_cast("long")


def is_sanctioned(node: Column) -> Column:
    test = F.lit(False)
    for prefix in SANCTION_PREFIXES:
        test = test | F.startswith(node, F.lit(prefix))
    return F.coalesce(test, F.lit(False))


def url_host(url: Column) -> Column:
    """Host part, with a special name for one well-known list export."""
    after_scheme = F.element_at(F.split(url, "//"), -1)
    return F.when(url.contains("exports/SDN.XML"), "OFAC SDN List").otherwise(
        F.split_part(after_scheme, F.lit("/"), F.lit(1))
    )


def hash_prefix(value: Column) -> Column:
    return F.left(value, F.lit(6))


def percent_text(weight: Column) -> Column:
    return F.format_string("%.1f%%", weight * 100)


def shorten(value: Column, limit: int = 30) -> Column:
    return F.when(
        F.length(value) > limit, F.concat(F.left(value, F.lit(limit - 3)), F.lit("..."))
    ).otherwise(value)


def node_role(sanctioned: Column, outlier: Column) -> Column:
    return F.when(sanctioned, "blacklist").when(outlier == 1, "outlier").otherwise("ordinary")


def rounded(c: Column, digits: int = 6) -> Column:
    """Round and turn a negative zero into zero."""
    return F.round(c, digits) + F.lit(0.0)
