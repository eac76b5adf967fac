"""Every query with SQL must agree with DuckDB on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
import oracle_check

from conftest import SMALL

# The rest of the queries are compared by tools/oracle_check.py on larger tables.
FAST = [
    "entity_catalog", "consolidate_catalog", "consolidate_full_outer", "profile_text", "edges_physical",
    "edges_filtered", "edge_explanations", "evidence_details", "tfidf_weights", "cosine_links_dense",
    "knn_outliers", "roc_auc_exact", "chains_3hop", "structuring_windows", "monthly_limits", "cycles_fundamental", "feature_totals",
]


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(FAST) <= set(entry.oracle_sql())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", FAST)
def test_query_agrees_with_sql(spark, name):
    con = oracle_check.oracle(SMALL)
    got = entry.queries()[name](spark, SMALL).toPandas()
    assert oracle_check.compare(got, con.execute(entry.oracle_sql()[name]).df()) is None
