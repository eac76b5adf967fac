"""Every query by name, with the SQL that checks it where SQL can say it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES = (
    "entity_queries",
    "link_queries",
    "vector_queries",
    "graph_queries",
    "outlier_queries",
    "model_queries",
    "alert_queries",
)


def _collect(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        module = importlib.import_module(f"riskweave.plans.{name}")
        out.update(getattr(module, attribute))
    return out


def all_queries() -> dict[str, Query]:
    return _collect("QUERIES")


def all_oracles() -> dict[str, str]:
    return _collect("ORACLES")
