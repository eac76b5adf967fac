"""Queries over supervised models, transaction alerts and report text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions.text import rounded
from riskweave.functions.vectors import feature_array
from riskweave.operators import narrative, supervised
from riskweave.operators.scaling import DETECTOR_FEATURES
from riskweave.plans import roles
from riskweave.plans.entity_queries import consolidated
from riskweave.plans.roles import with_ctes
from riskweave.session import materialise
from riskweave.streaming import alerts

TO_MXN = {"MXN": 1.0, "USD": 17.0, "EUR": 18.5}
TO_USD = {"MXN": 0.0588, "USD": 1.0, "EUR": 1.09}
LEVEL_LIMITS = {"BUILDING": 40_000.0, "MACHINERY": 60_000.0, "HOUSEHOLD": 30_000.0}
STRUCTURING_LIMIT = 150.0

TX_EXPRS = {
    "tx_id": "o_orderkey",
    "entity_id": roles.entity_id_expr("o_custkey"),
    "ts": "o_orderdate",
    "amount": "o_totalprice / 10.0",
    "currency": "(CASE o_orderkey % 3 WHEN 0 THEN 'MXN' WHEN 1 THEN 'USD' ELSE 'EUR' END)",
    "kind": "(CASE WHEN o_orderstatus = 'F' THEN 'cash' WHEN o_orderstatus = 'O' THEN 'international' ELSE 'other' END)",
}


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as transactions, with the customer's segment as account level."""
    orders, customer = roles.read(spark, sf_dir, "orders"), roles.read(spark, sf_dir, "customer")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
    return joined.select(
        *[F.expr(e).alias(n) for n, e in TX_EXPRS.items()], F.col("c_mktsegment").alias("level")
    )


def small_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of small payments."""
    return roles.read(spark, sf_dir, "events").select(
        F.col("event_id").alias("tx_id"),
        F.expr(roles.entity_id_expr("user_id")).alias("entity_id"),
        "ts",
        F.col("value").alias("amount"),
    )


def threshold_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = alerts.threshold_alerts(transactions(spark, sf_dir), TO_MXN, TO_USD)
    return out.select("tx_id", "entity_id", "rule", rounded(F.col("converted"), 8).alias("converted"))


def monthly_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = alerts.monthly_limits(transactions(spark, sf_dir), LEVEL_LIMITS)
    return out.select(
        F.date_format("month", "yyyy-MM").alias("month"),
        "entity_id",
        "level",
        "operations",
        rounded(F.col("total"), 4).alias("total"),
        "limit",
    )


def structuring_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = alerts.structuring_windows(small_payments(spark, sf_dir), STRUCTURING_LIMIT, "24 hours", "12 hours")
    return out.select(
        "entity_id",
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"),
        "operations",
        rounded(F.col("total"), 4).alias("total"),
    )


def narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narrative.narratives(consolidated(spark, sf_dir))


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = roles.read(spark, sf_dir, "labels").select("doc_id", "toxic")
    return supervised.stratified_split(labels, "toxic", "doc_id", order=F.col("doc_id")).select(
        "doc_id", "toxic", F.col("is_train").cast("int").alias("is_train")
    )


def labelled_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidated(spark, sf_dir).select(
        F.col("entity_id").alias("id"),
        feature_array(DETECTOR_FEATURES).alias("vec"),
        F.col("is_suspicious_analyst").cast("int").alias("label"),
    )


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine-model comparison."""
    points = materialise(labelled_points(spark, sf_dir), "labelled")
    table, _ = supervised.compare_models(points)
    return materialise(table, "compared")


def supervised_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir).select(
        F.col("Modelo").alias("model"),
        rounded(F.col("`PR-AUC`")).alias("pr_auc"),
        rounded(F.col("`F1-Score`")).alias("f1"),
        rounded(F.col("`ROC-AUC`")).alias("roc_auc"),
    )


def best_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _compared(spark, sf_dir)
    name = supervised.best_model(table)
    return table.where(F.col("Modelo") == (name or "")).select(
        F.col("Modelo").alias("model"), rounded(F.col("`F1-Score`")).alias("f1")
    )


QUERIES = {
    "threshold_alerts": threshold_alerts,
    "monthly_limits": monthly_limits,
    "structuring_windows": structuring_windows,
    "narrative": narratives,
    "stratified_split": stratified_split,
    "supervised_metrics": supervised_metrics,
    "best_classifier": best_classifier,
}

_TX = (
    "WITH tx AS (SELECT "
    + ", ".join(f"{e} AS {n}" for n, e in TX_EXPRS.items())
    + ", c_mktsegment AS level FROM orders JOIN customer ON o_custkey = c_custkey)"
)


def _rates(rates: dict[str, float], col: str) -> str:
    return f"(CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in rates.items()) + " END)"


ORACLES = {
    "threshold_alerts": _TX
    + f""", c AS (SELECT *, amount * {_rates(TO_MXN, 'currency')} AS mxn, amount * {_rates(TO_USD, 'currency')} AS usd FROM tx)
      SELECT tx_id, entity_id, CASE kind WHEN 'cash' THEN 'cash_limit' ELSE 'transfer_limit' END AS rule,
        round(CASE kind WHEN 'cash' THEN mxn ELSE usd END, 8) AS converted
      FROM c WHERE (kind = 'cash' AND mxn >= {alerts.CASH_LIMIT_MXN}) OR (kind = 'international' AND usd >= {alerts.TRANSFER_LIMIT_USD})""",
    "monthly_limits": _TX
    + f""", m AS (SELECT strftime(ts, '%Y-%m') AS month, entity_id, level, count(*) AS operations, sum(amount) AS total,
              {_rates(LEVEL_LIMITS, 'level')} AS "limit" FROM tx GROUP BY 1, 2, 3)
      SELECT month, entity_id, level, operations, round(total, 4) AS total, "limit" FROM m WHERE total > "limit" """,
    "structuring_windows": f"""WITH small AS (
        SELECT {roles.entity_id_expr('user_id')} AS entity_id, value,
          unnest([floor(epoch(ts) / 43200) * 43200, floor(epoch(ts) / 43200) * 43200 - 43200]) AS s
        FROM events WHERE value < {STRUCTURING_LIMIT})
      SELECT entity_id, strftime(make_timestamp((s * 1000000)::BIGINT), '%Y-%m-%d %H:%M') AS window_start,
        count(*) AS operations, round(sum(value), 4) AS total
      FROM small GROUP BY entity_id, s HAVING count(*) >= 2 AND sum(value) >= {STRUCTURING_LIMIT}""",
    "narrative": with_ctes("consolidated")
    + """ SELECT entity_id, entity_name || ' (' || entity_id || '): '
        || CASE entity_type WHEN 'FISICA' THEN 'Persona Física' WHEN 'MORAL' THEN 'Persona Moral' ELSE 'Entidad de otro tipo' END
        || ', ' || CASE country_code WHEN 'DESCONOCIDO' THEN 'país no determinado' ELSE 'país ' || country_code END || '. '
        || format('Evidencias: {} (en revisión: {}); coincidencia máxima de identidad: {:.2f}; fuentes con hallazgo: {}.',
             evidence_items, review_items, max_identity_score, sources_with_hallazgo) AS narrative
      FROM consolidated""",
    "stratified_split": """SELECT doc_id, toxic,
        CASE WHEN row_number() OVER (PARTITION BY toxic ORDER BY doc_id)
          <= floor(0.7::DOUBLE * count(*) OVER (PARTITION BY toxic) + 1e-9) THEN 1 ELSE 0 END AS is_train FROM labels""",
}
