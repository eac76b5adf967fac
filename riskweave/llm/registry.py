"""All corpus queries with their SQL."""

from __future__ import annotations

from riskweave.llm.oracles import ORACLES
from riskweave.llm.queries import QUERIES


def all_queries() -> dict:
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    return dict(ORACLES)
