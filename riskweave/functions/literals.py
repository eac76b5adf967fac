"""Columns holding a Python literal or JSON as text.

``from_json`` accepts single quotes, so almost every row parses in the JVM.
Only rows that use ``None``/``True``/``False``, tuples-free but escaped text or
the like pass their value to a vectorised parser; all other rows hand it a null.
"""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_JSON_OPTIONS = {"allowBackslashEscapingAnyCharacter": "true"}


def _literal_to_json(value):
    if value is None:
        return None
    try:
        return json.dumps(ast.literal_eval(value), ensure_ascii=False)
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def literal_to_json(values: pd.Series) -> pd.Series:
    return values.map(_literal_to_json, na_action="ignore")


def literal_as_json(text: Column) -> Column:
    """JSON text for a Python literal; plain rows stay untouched in the JVM."""
    trimmed = F.trim(text)
    special = trimmed.rlike(r"\b(None|True|False)\b|\\")
    return F.when(special, literal_to_json(F.when(special, trimmed))).otherwise(trimmed)


def parse_list(text: Column, ddl: str) -> Column:
    """Literal list of structs; null unless the text is a list."""
    as_json = literal_as_json(text)
    return F.when(F.startswith(as_json, F.lit("[")), F.from_json(as_json, ddl, _JSON_OPTIONS))


def parse_dict(text: Column, ddl: str) -> Column:
    """Literal dict as a struct; null unless the text is a dict."""
    as_json = literal_as_json(text)
    return F.when(F.startswith(as_json, F.lit("{")), F.from_json(as_json, ddl, _JSON_OPTIONS))


def json_objects(text: Column, ddl: str) -> Column:
    """Objects of a JSON list.

    The list is split into element texts first, so one odd element does not
    lose its neighbours.  A lone object is not a list and gives null.
    """
    trimmed = F.trim(text)
    items = F.when(
        F.startswith(trimmed, F.lit("[")), F.from_json(trimmed, "array<string>")
    )
    return F.transform(
        F.filter(items, lambda x: F.startswith(F.trim(x), F.lit("{"))),
        lambda x: F.from_json(x, ddl),
    )
