"""Queries over outlier detectors and exact evaluation metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions.text import rounded
from riskweave.operators import detectors, metrics
from riskweave.operators.scaling import DETECTOR_FEATURES, Scaler
from riskweave.plans import roles
from riskweave.plans.entity_queries import consolidated
from riskweave.plans.link_queries import flagged
from riskweave.plans.roles import with_ctes
from riskweave.session import materialise


def feature_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled detector features of every entity, as ``(id, vec)``."""
    rows = materialise(consolidated(spark, sf_dir), "consolidated")
    return Scaler.fit(rows).transform(rows)


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label"
    )


def _scored(out: DataFrame, name: str = "entity_id") -> DataFrame:
    return out.select(F.col("id").alias(name), rounded(F.col("score")).alias("score"), "flag")


def scaled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = feature_points(spark, sf_dir)
    return points.select(
        F.col("id").alias("entity_id"),
        *[rounded(F.get("vec", F.lit(i))).alias(c) for i, c in enumerate(DETECTOR_FEATURES)],
    )


def knn_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = materialise(feature_points(spark, sf_dir), "points")
    return _scored(detectors.KNNDistance.fit_transform(points)[1])


def lof_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = materialise(feature_points(spark, sf_dir), "points")
    out = detectors.LocalOutlierFactor.fit_transform(points)[1]
    # among many equal points factors reach 10^10, where six decimals are below a double's precision
    score = F.col("score")
    return _scored(out.withColumn("score", F.when(score >= 1e6, F.round(score, -4)).otherwise(score)))


def isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = materialise(feature_points(spark, sf_dir), "points")
    return _scored(detectors.IsolationForest.fit_transform(points)[1])


def one_class_rff(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = materialise(feature_points(spark, sf_dir), "points")
    return _scored(detectors.OneClassSVM.fit_transform(points)[1])


def robust_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = materialise(feature_points(spark, sf_dir), "points")
    return _scored(detectors.RobustCovariance.fit_transform(points)[1])


def embedding_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = embedding_points(spark, sf_dir).select("id", "vec")
    model = detectors.IsolationForest.fit(points, contamination="auto")
    return _scored(model.transform(points), "vec_id")


def cluster_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = metrics.centroid_distances(embedding_points(spark, sf_dir))
    return gaps.agg(
        F.count_distinct("label").alias("clusters"), rounded(F.avg("distance")).alias("cohesion")
    )


def silhouette_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = metrics.silhouette_samples(embedding_points(spark, sf_dir))
    w = F.col("copies")
    return samples.groupBy("label").agg(
        F.sum(w).alias("points"), rounded(F.sum(F.col("silhouette") * w) / F.sum(w)).alias("silhouette")
    )


def separability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialise(flagged(spark, sf_dir), "flagged")
    points = Scaler.fit(rows).transform(rows).join(
        rows.select(F.col("entity_id").alias("id"), F.col("is_outlier").alias("label")), "id"
    )
    sil, far = metrics.separability(materialise(points, "points"))
    return spark.createDataFrame(
        [(round(sil, 6), round(far, 6))], "silhouette double, mean_outlier_distance double"
    )


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(spark, sf_dir).select(
        F.col("is_suspicious_analyst").alias("truth"),
        F.col("is_outlier").alias("guess"),
        F.col("max_identity_score").alias("score"),
    )


def f1_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.f1_table(_judged(spark, sf_dir)).withColumn("f1", rounded(F.col("f1")))


def roc_auc_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.curve_areas(_judged(spark, sf_dir)).select(rounded(F.col("roc_auc")).alias("roc_auc"))


def pr_auc_trapezoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.curve_areas(_judged(spark, sf_dir)).select(rounded(F.col("pr_auc")).alias("pr_auc"))


QUERIES = {
    "scaled_features": scaled_features,
    "knn_outliers": knn_outliers,
    "lof_scores": lof_scores,
    "isolation_forest": isolation_forest,
    "one_class_rff": one_class_rff,
    "robust_covariance": robust_covariance,
    "embedding_outliers": embedding_outliers,
    "cluster_cohesion": cluster_cohesion,
    "silhouette_exact": silhouette_exact,
    "separability": separability,
    "f1_score": f1_score,
    "roc_auc_exact": roc_auc_exact,
    "pr_auc_trapezoid": pr_auc_trapezoid,
}

_SCALED = (
    ", feat AS MATERIALIZED (SELECT entity_id, "
    + ", ".join(
        f"({c} - (SELECT avg({c}) FROM {{0}})) / (SELECT stddev_pop({c}) FROM {{0}}) AS x{i}"
        for i, c in enumerate(DETECTOR_FEATURES)
    )
    + " FROM {0})"
)

_PLACES = with_ctes("consolidated") + _SCALED.format("consolidated") + """,
  places AS MATERIALIZED (SELECT min(entity_id) AS id, x0, x1, x2, count(*) AS copies FROM feat GROUP BY x0, x1, x2),
  gaps AS MATERIALIZED (
    SELECT a.id, b.id AS nid, b.copies, sqrt((a.x0 - b.x0)**2 + (a.x1 - b.x1)**2 + (a.x2 - b.x2)**2) AS d
    FROM places a, places b)"""


def _near(name: str, source: str, k: int) -> str:
    return f""",
  {name} AS MATERIALIZED (SELECT *, least(copies, {k} - used) AS taken FROM (
    SELECT *, coalesce(sum(copies) OVER (PARTITION BY id ORDER BY round(d, 9), nid
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM {source}) WHERE used < {k})"""


_SPREAD = """, spread AS (SELECT f.entity_id, s.score FROM feat f
    JOIN places p ON p.x0 = f.x0 AND p.x1 = f.x1 AND p.x2 = f.x2 JOIN scored s ON s.id = p.id)"""

_EMB = """WITH e AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"""

_JUDGED = (
    with_ctes("flagged")
    + """, steps AS (SELECT max_identity_score AS s, count(*) FILTER (WHERE is_suspicious_analyst = 1)::DOUBLE AS p,
      count(*) FILTER (WHERE is_suspicious_analyst <> 1)::DOUBLE AS n FROM flagged GROUP BY 1),
    cum AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS pp, sum(n) OVER () AS nn
      FROM steps WINDOW w AS (ORDER BY s DESC))"""
)

ORACLES = {
    "scaled_features": with_ctes("consolidated")
    + _SCALED.format("consolidated")
    + " SELECT entity_id, "
    + ", ".join(f"round(x{i}, 6) + 0.0 AS {c}" for i, c in enumerate(DETECTOR_FEATURES))
    + " FROM feat",
    "knn_outliers": _PLACES
    + _near("near", "gaps", 5)
    + ", scored AS (SELECT id, max(d) AS score FROM near GROUP BY 1)"
    + _SPREAD
    + """ SELECT entity_id, round(score, 6) AS score,
        CASE WHEN score >= (SELECT quantile_cont(score, 0.95) FROM spread) THEN 1 ELSE 0 END AS flag FROM spread""",
    "lof_scores": _PLACES
    + ", others AS (SELECT id, nid, copies - (id = nid)::INT AS copies, d FROM gaps WHERE copies - (id = nid)::INT > 0)"
    + _near("near", "others", 20)
    + _near("near_self", "gaps", 20)
    + """,
  reach AS MATERIALIZED (SELECT id, max(d) AS kd FROM near GROUP BY 1),
  dens AS MATERIALIZED (SELECT n.id, 1.0 / (sum(greatest(d, kd) * taken) / sum(taken) + 1e-10) AS lrd
           FROM near n JOIN reach r ON r.id = n.nid GROUP BY 1),
  train AS (SELECT n.id, sum(o.lrd * taken) / sum(taken) / any_value(m.lrd) AS f
            FROM near n JOIN dens o ON o.id = n.nid JOIN dens m ON m.id = n.id GROUP BY 1),
  dens_self AS (SELECT n.id, 1.0 / (sum(greatest(d, kd) * taken) / sum(taken) + 1e-10) AS lrd
           FROM near_self n JOIN reach r ON r.id = n.nid GROUP BY 1),
  scored AS (SELECT n.id, sum(o.lrd * taken) / sum(taken) / any_value(m.lrd) AS score
            FROM near_self n JOIN dens o ON o.id = n.nid JOIN dens_self m ON m.id = n.id GROUP BY 1)"""
    + _SPREAD
    + """ SELECT entity_id, CASE WHEN score >= 1e6 THEN round(score, -4) ELSE round(score, 6) END AS score,
        CASE WHEN score > (SELECT quantile_cont(t.f, 0.95) FROM feat f
            JOIN places p ON p.x0 = f.x0 AND p.x1 = f.x1 AND p.x2 = f.x2 JOIN train t ON t.id = p.id)
          THEN 1 ELSE 0 END AS flag FROM spread""",
    "cluster_cohesion": _EMB
    + """, c AS (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e)
             GROUP BY 1, 2),
      centre AS (SELECT label, list(m ORDER BY pos) AS m FROM c GROUP BY 1)
      SELECT count(DISTINCT label) AS clusters, round(avg(list_distance(v, m)), 6) AS cohesion FROM e JOIN centre USING (label)""",
    "silhouette_exact": _EMB
    + """, sums AS (SELECT a.id, a.label, b.label AS other, sum(list_distance(a.v, b.v)) AS t, count(*) AS n
                FROM e a, e b GROUP BY 1, 2, 3),
      ab AS (SELECT id, label, max(CASE WHEN label = other THEN t / (n - 1) END) AS a,
               min(CASE WHEN label <> other THEN t / n END) AS b FROM sums GROUP BY 1, 2)
      SELECT label, count(*) AS points, round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM ab GROUP BY 1""",
    "separability": with_ctes("flagged")
    + _SCALED.format("flagged")
    + """, e AS MATERIALIZED (SELECT entity_id AS id, x0, x1, x2, is_outlier AS label FROM feat JOIN flagged USING (entity_id)),
      sums AS (SELECT a.id, a.label, b.label AS other, count(*) AS n,
          sum(sqrt((a.x0 - b.x0)**2 + (a.x1 - b.x1)**2 + (a.x2 - b.x2)**2)) AS t FROM e a, e b GROUP BY 1, 2, 3),
      ab AS (SELECT id, max(CASE WHEN label = other THEN t / (n - 1) END) AS a,
               min(CASE WHEN label <> other THEN t / n END) AS b FROM sums GROUP BY 1),
      m AS (SELECT avg(x0) AS m0, avg(x1) AS m1, avg(x2) AS m2 FROM e WHERE label = 0)
      SELECT (SELECT round(avg(CASE WHEN greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) FROM ab) AS silhouette,
        (SELECT round(avg(sqrt((x0 - m0)**2 + (x1 - m1)**2 + (x2 - m2)**2)), 6) FROM e, m WHERE label = 1) AS mean_outlier_distance""",
    "f1_score": with_ctes("flagged")
    + """ SELECT tp, fp, fn, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1 FROM (
        SELECT count(*) FILTER (WHERE is_suspicious_analyst = 1 AND is_outlier = 1) AS tp,
          count(*) FILTER (WHERE is_suspicious_analyst <> 1 AND is_outlier = 1) AS fp,
          count(*) FILTER (WHERE is_suspicious_analyst = 1 AND is_outlier <> 1) AS fn FROM flagged)""",
    "roc_auc_exact": _JUDGED
    + """ SELECT CASE WHEN max(pp) = 0 OR max(nn) = 0 THEN 0.0::DOUBLE
        ELSE round(sum(n / nn * (tp + tp - p) / (2 * pp)), 6) END AS roc_auc FROM cum""",
    "pr_auc_trapezoid": _JUDGED
    + """ SELECT CASE WHEN max(pp) = 0 OR max(nn) = 0 THEN 0.0::DOUBLE
        ELSE round(sum(p / pp * (tp / (tp + fp)
          + CASE WHEN tp + fp - p - n > 0 THEN (tp - p) / (tp + fp - p - n) ELSE 1.0 END) / 2), 6) END AS pr_auc FROM cum""",
}
