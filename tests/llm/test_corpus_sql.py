"""The corpus queries that SQL can express agree with DuckDB."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
import oracle_check

from riskweave.llm.oracles import ORACLES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    got = entry.queries()[name](spark, SMALL).toPandas()
    assert oracle_check.compare(got, oracle_check.oracle(SMALL).execute(entry.oracle_sql()[name]).df()) is None
