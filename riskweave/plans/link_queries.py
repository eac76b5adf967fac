"""Queries over edges, evidence details and ego networks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions import text
from riskweave.operators import edges as E
from riskweave.operators import ego, evidence
from riskweave.plans import roles
from riskweave.plans.entity_queries import consolidated
from riskweave.plans.roles import with_ctes


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consolidated entities with a given outlier flag and the list test."""
    return consolidated(spark, sf_dir).withColumns(
        {
            "is_outlier": F.when(
                (F.col("max_identity_score") > 0.45) | (F.col("evidence_items") > 80), 1
            ).otherwise(0),
            "is_blacklist": text.is_sanctioned(F.col("entity_id")),
        }
    )


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.physical_edges(roles.evidence(spark, sf_dir))


def edges_physical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


def shared_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = roles.evidence(spark, sf_dir)
    all_edges = E.physical_edges(ev)
    return E.shared_keys_of(all_edges, ev, E.SHARED_REFERENCE).withColumn(
        "host", text.url_host(F.col("key"))
    )


def edges_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.collapse(_edges(spark, sf_dir))


def edges_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.strong_edges(roles.evidence(spark, sf_dir))


def relation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.relation_counts(_edges(spark, sf_dir))


def topology_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.topology_stats(consolidated(spark, sf_dir), _edges(spark, sf_dir))


def node_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.node_degree(consolidated(spark, sf_dir), _edges(spark, sf_dir))


def edge_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = roles.evidence(spark, sf_dir)
    return E.explain_edges(E.physical_edges(ev), ev)


def evidence_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.evidence_details(roles.evidence(spark, sf_dir)).select(
        "entity_id",
        F.array_join("lists", "|").alias("lists"),
        F.array_join("reasons", "|").alias("reasons"),
        "status",
        "country",
    )


def node_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    details = evidence.evidence_details(roles.evidence(spark, sf_dir))
    return evidence.node_labels(flagged(spark, sf_dir), details)


def ego_top30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ego.ego_network(_edges(spark, sf_dir))


def priority_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = E.linked_entities(roles.evidence(spark, sf_dir))
    return ego.priority_entities(consolidated(spark, sf_dir), linked).select(
        "entity_id", "entity_name", "is_suspicious_analyst"
    )


def node_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(spark, sf_dir).select(
        "entity_id",
        "is_outlier",
        text.node_role(F.col("is_blacklist"), F.col("is_outlier")).alias("role"),
    )


QUERIES = {
    "edges_physical": edges_physical,
    "shared_keys": shared_keys,
    "edges_collapsed": edges_collapsed,
    "edges_filtered": edges_filtered,
    "relation_counts": relation_counts,
    "topology_stats": topology_stats,
    "node_degree": node_degree,
    "edge_explanations": edge_explanations,
    "evidence_details": evidence_details,
    "node_labels": node_labels,
    "ego_top30": ego_top30,
    "priority_entities": priority_entities,
    "node_roles": node_roles,
}

_HOST = (
    "CASE WHEN contains({0}, 'exports/SDN.XML') THEN 'OFAC SDN List'"
    " ELSE split_part(split_part({0}, '//', 2), '/', 1) END"
)

# Reasons of one evidence row, in order, from the structured source columns.
DETAILS_CTE = """
facts AS (
  SELECT e.entity_id, e.ord, e.source_id, trim(e.country) AS country, trim(e.snippet) AS snippet, v.k,
    CASE e.ord % 6 WHEN 0 THEN 'active' WHEN 1 THEN 'presumed' END AS status,
    CASE e.ord % 6
      WHEN 0 THEN ['S' || (v.k % 3), 'Regime: R' || (v.k % 2), 'Prog: P1', 'Prog: P' || (v.k % 2)]
      WHEN 1 THEN ['C' || (v.k % 3), 'Prog: PX']
      WHEN 2 THEN ['Regime: R9'] ELSE [] END AS reasons
  FROM evidence e JOIN ev0 v ON v.event_id = e.ord WHERE e.entity_id IS NOT NULL),
given AS (
  SELECT entity_id, reason, min(ord * 10 + pos) AS seq
  FROM (SELECT entity_id, ord, unnest(reasons) AS reason, generate_subscripts(reasons, 1) AS pos FROM facts)
  GROUP BY 1, 2),
firsts AS (
  SELECT entity_id, min(ord) FILTER (WHERE len(reasons) > 0) AS reason_ord,
    min(ord) FILTER (WHERE coalesce(snippet, '') <> '') AS snippet_ord,
    arg_min(snippet, ord) FILTER (WHERE coalesce(snippet, '') <> '') AS snippet,
    arg_min(status, ord) FILTER (WHERE status IS NOT NULL) AS status,
    arg_min(country, ord) FILTER (WHERE coalesce(country, '') <> '') AS country
  FROM facts GROUP BY 1),
all_reasons AS (
  SELECT entity_id, reason, seq FROM given
  UNION ALL
  SELECT entity_id, snippet, -1 FROM firsts
  WHERE snippet IS NOT NULL AND (reason_ord IS NULL OR snippet_ord < reason_ord)),
lists AS (
  SELECT entity_id, list(source_id ORDER BY o) AS lists
  FROM (SELECT entity_id, source_id, min(ord) AS o FROM facts GROUP BY 1, 2) GROUP BY 1),
details AS (
  SELECT f.entity_id, l.lists, coalesce(r.reasons, []) AS reasons, f.status, f.country
  FROM firsts f LEFT JOIN lists l USING (entity_id)
  LEFT JOIN (SELECT entity_id, list(reason ORDER BY seq) AS reasons FROM all_reasons GROUP BY 1) r USING (entity_id))"""

ORACLES = {
    "edges_physical": with_ctes("edges") + " SELECT * FROM edges",
    "shared_keys": with_ctes("edges")
    + f" SELECT source, target, first_key AS key, {_HOST.format('first_key')} AS host FROM url_pairs",
    "edges_collapsed": with_ctes("collapsed") + " SELECT * FROM collapsed",
    "edges_filtered": with_ctes("collapsed") + " SELECT * FROM strong_edges",
    "relation_counts": with_ctes("edges") + " SELECT relation_type, count(*) AS edges FROM edges GROUP BY 1",
    "topology_stats": with_ctes("consolidated", "edges")
    + """ SELECT 'Total de Entidades (Nodos)' AS "Métrica", (SELECT count(*) FROM consolidated) AS "Valor"
      UNION ALL SELECT 'Relaciones por Referencias Compartidas', count(*) FROM edges WHERE relation_type = 'shared_reference'
      UNION ALL SELECT 'Relaciones por Contenido Compartido', count(*) FROM edges WHERE relation_type = 'shared_content'
      UNION ALL SELECT 'Vínculos Semánticos Ocultos Detectados (Embeddings)', 0
      UNION ALL SELECT 'Total de Enlaces en el Grafo', count(*) FROM edges
      UNION ALL SELECT 'Comunidades Estructurales Identificadas (Louvain)', 0""",
    "node_degree": with_ctes("consolidated", "collapsed")
    + """,
      ends AS (SELECT source AS entity_id, target AS other FROM collapsed UNION ALL SELECT target, source FROM collapsed),
      nodes AS (SELECT entity_id FROM consolidated UNION SELECT entity_id FROM ends)
      SELECT n.entity_id, count(e.other) AS degree FROM nodes n LEFT JOIN ends e USING (entity_id) GROUP BY 1""",
    "edge_explanations": with_ctes("edges")
    + f""" SELECT e.source, e.target, e.relation_type, e.weight,
        CASE WHEN u.first_key IS NOT NULL THEN 'Ref. Compartida' || chr(10) || '(' || {_HOST.format('u.first_key')} || ')'
             WHEN h.first_key IS NOT NULL THEN 'Contenido Compartido' || chr(10) || '(Hash: ' || left(h.first_key, 6) || ')'
             ELSE 'Enlace Físico (' || e.relation_type || ')' END AS explanation,
        CASE WHEN u.first_key IS NOT NULL THEN 'Ref: ' || {_HOST.format('u.first_key')}
             WHEN h.first_key IS NOT NULL THEN 'Hash: ' || left(h.first_key, 6) ELSE 'Físico' END AS short_label
      FROM edges e LEFT JOIN url_pairs u ON u.source = e.source AND u.target = e.target
      LEFT JOIN hash_pairs h ON h.source = e.source AND h.target = e.target""",
    "evidence_details": with_ctes("evidence")
    + ","
    + DETAILS_CTE
    + """ SELECT entity_id, array_to_string(lists, '|') AS lists, array_to_string(reasons, '|') AS reasons,
        status, country FROM details""",
    "node_labels": with_ctes("flagged")
    + ","
    + DETAILS_CTE
    + """ SELECT f.entity_id, concat_ws(chr(10), f.entity_name || chr(10) || '(' || f.entity_id || ')',
        CASE WHEN is_outlier = 1 THEN '[ANÓMALO]' END,
        CASE WHEN len(d.lists) > 0 THEN 'Listas: ' || array_to_string(d.lists, ',') END,
        'Estado: ' || d.status,
        CASE WHEN len(d.reasons) > 0 THEN 'Motivo:' || chr(10) || array_to_string(d.reasons, '; ') END,
        CASE WHEN d.entity_id IS NULL AND is_outlier = 0 AND NOT is_blacklist THEN '(Nodo Ordinario)' END) AS label
      FROM flagged f LEFT JOIN details d USING (entity_id)""",
    "ego_top30": with_ctes("edges")
    + """,
      adj AS (SELECT source AS entity_id, target AS neighbour_id, relation_type, weight FROM edges
              UNION ALL SELECT target, source, relation_type, weight FROM edges)
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY
          CASE WHEN relation_type = 'semantic_similarity' THEN 0 ELSE 1 END, weight DESC, neighbour_id, relation_type) AS position
        FROM adj) WHERE position <= 30""",
    "priority_entities": with_ctes("consolidated", "edges")
    + """ SELECT entity_id, entity_name, is_suspicious_analyst FROM consolidated
      WHERE entity_id IN (SELECT source FROM edges UNION SELECT target FROM edges)
      ORDER BY is_suspicious_analyst DESC, entity_id LIMIT 10""",
    "node_roles": with_ctes("flagged")
    + """ SELECT entity_id, is_outlier, CASE WHEN is_blacklist THEN 'blacklist' WHEN is_outlier = 1 THEN 'outlier'
        ELSE 'ordinary' END AS role FROM flagged""",
}
