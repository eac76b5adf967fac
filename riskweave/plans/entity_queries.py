"""Queries over the catalog, the consolidated table and the text profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions.text import rounded
from riskweave.operators import catalog, consolidate, profiles
from riskweave.plans import roles
from riskweave.plans.roles import with_ctes


def entity_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.entity_catalog(*roles.raw(spark, sf_dir))


def consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources, evidence, match = roles.raw(spark, sf_dir)
    return consolidate.consolidate_catalog(
        catalog.entity_catalog(sources, evidence, match), sources, evidence, match
    )


def consolidate_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidated(spark, sf_dir).withColumn(
        "max_identity_score", rounded(F.col("max_identity_score"))
    )


def consolidate_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidate.consolidate_full_outer(*roles.raw(spark, sf_dir)).withColumn(
        "max_identity_score", rounded(F.col("max_identity_score"))
    )


def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidate.label_distribution(consolidated(spark, sf_dir))


def profile_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources, evidence, match = roles.raw(spark, sf_dir)
    cat = catalog.entity_catalog(sources, evidence, match)
    return profiles.profile_text(cat, evidence).select(
        "entity_id", "all_evidence", "entity_profile_text"
    )


QUERIES = {
    "entity_catalog": entity_catalog,
    "consolidate_catalog": consolidate_catalog,
    "consolidate_full_outer": consolidate_full_outer,
    "label_distribution": label_distribution,
    "profile_text": profile_text,
}

ORACLES = {
    "entity_catalog": with_ctes("catalog") + " SELECT * FROM catalog",
    "consolidate_catalog": with_ctes("consolidated")
    + " SELECT * REPLACE (round(max_identity_score, 6) AS max_identity_score) FROM consolidated",
    "consolidate_full_outer": with_ctes("evidence", "sources", "match")
    + """,
      s AS (SELECT entity_id, count(*) AS n, count(*) FILTER (WHERE found > 0) AS h FROM sources GROUP BY 1),
      e AS (SELECT coalesce(entity_id, '') AS entity_id, max(identity_score) AS sc, count(*) AS n,
              count(*) FILTER (WHERE regexp_matches(review_required, '(?i)true|1')) AS r
            FROM evidence GROUP BY 1),
      m AS (SELECT coalesce(entity_id, '') AS entity_id, arg_min(match_count, ord) AS match_count,
              arg_min(sources_hit, ord) AS sources_hit FROM match_summary GROUP BY 1)
      SELECT coalesce(s.entity_id, e.entity_id, m.entity_id) AS entity_id,
        coalesce(s.n, 0) AS sources_evaluated, coalesce(s.h, 0) AS sources_with_hallazgo,
        round(coalesce(e.sc, 0.0), 6) AS max_identity_score,
        coalesce(e.n, 0) AS evidence_items, coalesce(e.r, 0) AS review_items,
        coalesce(m.match_count, 0) AS match_count, coalesce(m.sources_hit, '') AS sources_hit,
        CASE WHEN coalesce(e.r, 0) > 0 THEN 'needs_review' WHEN coalesce(e.n, 0) > 0 THEN 'accepted'
             ELSE 'no_match' END AS overall_decision
      FROM s FULL JOIN e ON s.entity_id = e.entity_id
      FULL JOIN m ON m.entity_id = coalesce(s.entity_id, e.entity_id)""",
    "label_distribution": with_ctes("consolidated")
    + """ SELECT is_suspicious_analyst AS label, count(*) AS rows,
        round(count(*) / (SELECT count(*) FROM consolidated)::DOUBLE, 4) AS share
      FROM consolidated GROUP BY 1""",
    "profile_text": with_ctes("catalog")
    + """,
      items AS (
        SELECT entity_id, ord, 'Fragmento: ' || coalesce(trim(snippet), '')
          || CASE WHEN coalesce(trim(review_reason), '') <> '' THEN ' | Motivo: ' || trim(review_reason) ELSE '' END AS t
        FROM evidence WHERE entity_id IS NOT NULL),
      firsts AS (SELECT entity_id, t, min(ord) AS o FROM items GROUP BY 1, 2),
      texts AS (SELECT entity_id, string_agg(t, ' ; ' ORDER BY o) AS a FROM firsts GROUP BY 1)
      SELECT c.entity_id, coalesce(a, 'Sin evidencias recopiladas') AS all_evidence,
        'Entidad: ' || entity_name || ' | Tipo: ' || entity_type || ' | País: ' || country_code
          || ' | Evidencias: ' || coalesce(a, 'Sin evidencias recopiladas') AS entity_profile_text
      FROM catalog c LEFT JOIN texts USING (entity_id)""",
}
