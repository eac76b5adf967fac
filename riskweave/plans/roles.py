"""Input tables derived from the test tables.

The raw inputs of a deployment are lookups, evidence and match summaries.  The
given tables hold none of them, so each is derived here from ``events`` and
``customer`` (plus ``nation``).  Scalar rules are written once as SQL
expressions, used by the Spark frames and by the DuckDB text alike; only the
table shapes are stated twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def entity_id_expr(col: str) -> str:
    return (
        f"((CASE {col} % 10 WHEN 0 THEN 'OFAC_SDN-' WHEN 1 THEN 'SAT_69B-' ELSE 'CL-' END)"
        f" || CAST({col} AS STRING))"
    )


K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"
HOUR = "(CAST(CAST(ts AS DATE) AS STRING) || '-' || CAST(extract(hour FROM ts) AS STRING))"
RAW_TYPE = (
    "(CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'PM'"
    " WHEN c_mktsegment IN ('HOUSEHOLD', 'AUTOMOBILE') THEN 'PF' ELSE 'XX' END)"
)

EVIDENCE_EXPRS = {
    "ord": "event_id",
    "evidence_id": "CAST(event_id AS STRING)",
    "entity_id": f"(CASE WHEN event_id % 997 = 0 THEN NULL ELSE {entity_id_expr('user_id')} END)",
    "source_id": "event_type",
    "identity_score": "value / 500.0",
    "review_required": (
        "(CASE WHEN event_type = 'error' AND value > 200 THEN 'True'"
        " WHEN event_type = 'click' AND k = 7 AND user_id % 4 = 1 THEN '1'"
        " WHEN event_type = 'view' AND k = 10 THEN '10'"
        " WHEN k = 33 THEN 'untrue' ELSE 'False' END)"
    ),
    "url_or_reference": (
        "(CASE WHEN k = 42 THEN 'https://lists.example.gov/exports/SDN.XML' WHEN k = 43 THEN NULL"
        f" ELSE 'https://h' || CAST(k % 17 AS STRING) || '.example.org/ref/' || CAST(k AS STRING) || '/' || {HOUR} END)"
    ),
    "raw_content_hash": (
        "(CASE WHEN event_type = 'signup' THEN NULL ELSE"
        f" md5(CAST(k AS STRING) || '|' || {HOUR} || '|' || event_type) END)"
    ),
    "country": (
        "(CASE event_id % 4 WHEN 0 THEN 'Land ' || CAST(user_id % 25 AS STRING)"
        " WHEN 1 THEN 'fra' WHEN 2 THEN '' ELSE NULL END)"
    ),
    "snippet": (
        "(CASE WHEN event_id % 5 = 0 THEN NULL ELSE ' ' || event_type || ' k' || CAST(k % 10 AS STRING) || ' ' END)"
    ),
    "review_reason": "(CASE WHEN event_type = 'error' THEN 'reason ' || CAST(k % 4 AS STRING) ELSE NULL END)",
    "extracted_fields": (
        "(CASE event_id % 6"
        " WHEN 0 THEN replace('{~statement_of_reasons~: ~S' || CAST(k % 3 AS STRING) || '~, ~regime_name~: ~R'"
        " || CAST(k % 2 AS STRING) || '~, ~programs_json~: \"[~P1~, ~P' || CAST(k % 2 AS STRING) || '~]\", ~status~: ~active~}', '~', chr(39))"
        " WHEN 1 THEN replace('{~csd_cancellation_reason~: ~C' || CAST(k % 3 AS STRING) || '~, ~programs_json~: ~PX~, ~supposition~: ~presumed~}', '~', chr(39))"
        " WHEN 2 THEN replace('{~review_reason~: None, ~status~: None, ~regime_name~: ~R9~}', '~', chr(39))"
        " WHEN 4 THEN 'not a dict' WHEN 5 THEN replace('[~list~]', '~', chr(39)) ELSE NULL END)"
    ),
}

QUERY_USED = (
    "(CASE WHEN user_id % 10 = 7 THEN NULL"
    " WHEN event_type = 'view' AND user_id % 10 = 8 THEN '[broken'"
    " ELSE replace('[{~entity_id~: ~' || eid || '~, ~query_value~: ~' || c_name || '~, ~metadata~: {~country_code~: '"
    " || (CASE WHEN event_type = 'signup' THEN 'None' WHEN event_type = 'click' THEN '~per~' ELSE '~Land ' || CAST(c_nationkey AS STRING) || '~' END)"
    f" || ', ~entity_type~: ~' || {RAW_TYPE} || '~}}}}]', '~', chr(39)) END)"
)

MATCH_EXPRS = {
    "ord": "c_custkey",
    # a fifth of the rows lack their id, so those entities are only known from lookups and evidence
    "entity_id": f"(CASE WHEN c_custkey % 5 = 4 THEN NULL ELSE {entity_id_expr('c_custkey')} END)",
    "entity_name": "c_name",
    "input_country": "(CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'mex' ELSE n_name END)",
    "input_entity_type": RAW_TYPE,
    "sources_hit": "c_mktsegment",
    "match_count": "(CASE WHEN c_custkey % 11 = 0 THEN '' ELSE CAST(c_custkey % 7 AS STRING) || '.0' END)",
    "matches_json": (
        "(CASE c_custkey % 4 WHEN 0 THEN '[]'"
        " WHEN 1 THEN '{\"country\": \"Land 1\"}'"
        " WHEN 2 THEN '[{\"country\": \"Land ' || CAST(c_nationkey AS STRING) || '\"}, 5]'"
        " ELSE '[{\"country\": \" land ' || CAST((c_nationkey + 3) % 25 AS STRING) || ' \"}, {\"country\": null}]' END)"
    ),
}

# A match row is labelled when the entity produced a high-valued error.
LABEL_RULE = "event_type = 'error' AND value > 250"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").withColumn("k", F.expr(K))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation")
    customer = read(spark, sf_dir, "customer")
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey)


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _events(spark, sf_dir)
    return ev.select(*[F.expr(e).alias(n) for n, e in EVIDENCE_EXPRS.items()])


def source_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = (
        _events(spark, sf_dir)
        .groupBy("user_id", "event_type")
        .agg(F.count_if(F.col("value") > 150).alias("n"), F.min("event_id").alias("ord"))
    )
    named = grouped.join(
        read(spark, sf_dir, "customer"), F.col("user_id") == F.col("c_custkey")
    ).withColumn("eid", F.expr(entity_id_expr("user_id")))
    return named.select(
        "ord",
        F.col("eid").alias("entity_id"),
        F.col("event_type").alias("source_id"),
        F.expr("CASE WHEN n = 0 THEN '' ELSE CAST(n AS STRING) || '.0' END").alias("evidence_count"),
        F.expr(QUERY_USED).alias("query_used"),
    )


def match_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = (
        read(spark, sf_dir, "events")
        .groupBy("user_id")
        .agg(F.max(F.when(F.expr(LABEL_RULE), 1).otherwise(0)).alias("is_suspicious_analyst"))
    )
    return _customers(spark, sf_dir).join(label, F.col("c_custkey") == F.col("user_id"), "left").select(
        *[F.expr(e).alias(n) for n, e in MATCH_EXPRS.items()],
        F.coalesce("is_suspicious_analyst", F.lit(0)).alias("is_suspicious_analyst"),
    )


def raw(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        source_results(spark, sf_dir),
        evidence(spark, sf_dir),
        match_summary(spark, sf_dir),
    )


# --- the same tables as DuckDB common table expressions ------------------------

_EV = f"ev0 AS (SELECT event_id, user_id, ts, event_type, value, {K} AS k FROM events)"

_EVIDENCE = (
    "evidence AS (SELECT "
    + ", ".join(f"{e} AS {n}" for n, e in EVIDENCE_EXPRS.items())
    + " FROM ev0)"
)

# The lookups carry their query as plain columns here; nothing is parsed.
_SOURCES = f"""
sources AS (
  SELECT g.ord, {entity_id_expr('g.user_id')} AS entity_id, g.event_type AS source_id, g.n AS found,
    NOT (g.user_id % 10 = 7 OR (g.event_type = 'view' AND g.user_id % 10 = 8)) AS has_query,
    c.c_name AS query_value, {RAW_TYPE} AS query_type,
    CASE WHEN g.event_type = 'signup' THEN NULL WHEN g.event_type = 'click' THEN 'per'
         ELSE 'Land ' || CAST(c.c_nationkey AS STRING) END AS query_country
  FROM (SELECT user_id, event_type, count(*) FILTER (WHERE value > 150) AS n, min(event_id) AS ord
        FROM events GROUP BY user_id, event_type) g
  JOIN customer c ON c.c_custkey = g.user_id)"""

# ``m_country`` is the country named in the row's match list, if any.
_MATCH = f"""
match_summary AS (
  SELECT {", ".join(f"{e} AS {n}" for n, e in MATCH_EXPRS.items() if n not in ("matches_json", "match_count"))},
    CASE WHEN c_custkey % 11 = 0 THEN 0 ELSE c_custkey % 7 END AS match_count,
    CASE c_custkey % 4 WHEN 2 THEN 'land ' || CAST(c_nationkey AS STRING)
         WHEN 3 THEN 'land ' || CAST((c_nationkey + 3) % 25 AS STRING) END AS m_country,
    coalesce(l.lab, 0) AS is_suspicious_analyst
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT user_id, max(CASE WHEN {LABEL_RULE} THEN 1 ELSE 0 END) AS lab
             FROM events GROUP BY user_id) l ON l.user_id = c_custkey)"""

_CATALOG = """
country_map AS (
  SELECT m_country AS country_key, arg_max(upper(trim(input_country)), ord) AS code
  FROM match_summary
  WHERE m_country IS NOT NULL AND upper(trim(input_country)) NOT IN ('', 'UNKNOWN')
  GROUP BY m_country),
candidates AS (
  SELECT entity_id, entity_name AS name, input_entity_type AS raw_type, input_country AS country, 0 AS prio, ord
  FROM match_summary WHERE entity_id IS NOT NULL
  UNION ALL
  SELECT entity_id, query_value, query_type, query_country, 1, ord FROM sources WHERE has_query
  UNION ALL
  SELECT s.entity_id, 'Entidad Desconocida ' || s.entity_id, NULL,
    (SELECT arg_min(coalesce(e.country, ''), e.ord) FROM evidence e WHERE e.entity_id = s.entity_id), 2, s.ord
  FROM sources s),
winners AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY prio, ord) AS rn FROM candidates)
  WHERE rn = 1),
catalog AS (
  SELECT w.entity_id, w.name AS entity_name,
    CASE w.raw_type WHEN 'PM' THEN 'MORAL' WHEN 'PF' THEN 'FISICA' ELSE 'OTRO' END AS entity_type,
    CASE WHEN w.country IS NULL OR lower(trim(w.country)) IN ('', 'unknown', 'nan') THEN 'DESCONOCIDO'
         ELSE coalesce(m.code, upper(substring(trim(w.country), 1, 3))) END AS country_code
  FROM winners w LEFT JOIN country_map m ON m.country_key = lower(trim(w.country)))"""

_CONSOLIDATED = """
src_agg AS (
  SELECT entity_id, count(*) AS sources_evaluated, count(*) FILTER (WHERE found > 0) AS sources_with_hallazgo
  FROM sources GROUP BY entity_id),
ev_agg AS (
  SELECT entity_id, max(identity_score) AS max_identity_score, count(*) AS evidence_items,
    count(*) FILTER (WHERE lower(review_required) IN ('true', '1')) AS review_items
  FROM evidence WHERE entity_id IS NOT NULL GROUP BY entity_id),
consolidated AS (
  SELECT c.*, coalesce(sources_evaluated, 0) AS sources_evaluated,
    coalesce(sources_with_hallazgo, 0) AS sources_with_hallazgo,
    coalesce(max_identity_score, 0.0) AS max_identity_score,
    coalesce(evidence_items, 0) AS evidence_items, coalesce(review_items, 0) AS review_items,
    coalesce(m.match_count, 0) AS match_count, coalesce(m.sources_hit, '') AS sources_hit,
    CASE WHEN coalesce(review_items, 0) > 0 THEN 'needs_review'
         WHEN coalesce(evidence_items, 0) > 0 THEN 'accepted' ELSE 'no_match' END AS overall_decision,
    coalesce(m.is_suspicious_analyst, 0) AS is_suspicious_analyst
  FROM catalog c LEFT JOIN src_agg USING (entity_id) LEFT JOIN ev_agg USING (entity_id)
  LEFT JOIN match_summary m USING (entity_id))"""


def _pair_cte(name: str, key: str, relation: str, weight: float) -> str:
    return f"""
{name}_members AS (SELECT DISTINCT {key} AS key, entity_id FROM evidence
                   WHERE {key} IS NOT NULL AND entity_id IS NOT NULL),
{name} AS (
  SELECT a.entity_id AS source, b.entity_id AS target, '{relation}' AS relation_type,
    sum({weight}::DOUBLE) AS weight, min(a.key) AS first_key
  FROM {name}_members a JOIN {name}_members b ON a.key = b.key AND a.entity_id < b.entity_id
  GROUP BY 1, 2)"""


_EDGES = (
    _pair_cte("url_pairs", "url_or_reference", "shared_reference", 1.0)
    + ","
    + _pair_cte("hash_pairs", "raw_content_hash", "shared_content", 1.5)
    + """,
edges AS (
  SELECT source, target, relation_type, weight FROM url_pairs
  UNION ALL SELECT source, target, relation_type, weight FROM hash_pairs)"""
)

_COLLAPSED = """
strong_edges AS (SELECT * FROM edges WHERE relation_type <> 'shared_reference' OR weight >= 2.0),
collapsed AS (
  SELECT source, target, arg_max(relation_type, relation_type) AS relation_type,
    arg_max(weight, relation_type) AS weight FROM edges GROUP BY source, target),
strong AS (
  SELECT source, target, arg_max(relation_type, relation_type) AS relation_type,
    arg_max(weight, relation_type) AS weight FROM strong_edges GROUP BY source, target)"""

_FLAGS = """
flagged AS (
  SELECT *, CASE WHEN max_identity_score > 0.45 OR evidence_items > 80 THEN 1 ELSE 0 END AS is_outlier,
    starts_with(entity_id, 'OFAC_SDN') OR starts_with(entity_id, 'SAT_69') AS is_blacklist
  FROM consolidated)"""

CTES = {
    "evidence": [_EV, _EVIDENCE],
    "sources": [_SOURCES],
    "match": [_MATCH],
    "catalog": [_EV, _EVIDENCE, _SOURCES, _MATCH, _CATALOG],
    "consolidated": [_EV, _EVIDENCE, _SOURCES, _MATCH, _CATALOG, _CONSOLIDATED],
    "flagged": [_EV, _EVIDENCE, _SOURCES, _MATCH, _CATALOG, _CONSOLIDATED, _FLAGS],
    "edges": [_EV, _EVIDENCE, _EDGES],
    "collapsed": [_EV, _EVIDENCE, _EDGES, _COLLAPSED],
}


def with_ctes(*names: str, recursive: bool = False) -> str:
    """``WITH`` clause holding the named tables, each once, in order."""
    parts: list[str] = []
    for name in names:
        for part in CTES[name]:
            if part not in parts:
                parts.append(part)
    order = [_EV, _EVIDENCE, _SOURCES, _MATCH, _CATALOG, _CONSOLIDATED, _FLAGS, _EDGES, _COLLAPSED]
    parts.sort(key=order.index)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(parts)
