"""Queries over clustering and communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions.text import rounded
from riskweave.operators import agglomerative, clustering, communities, density, edges, mixture
from riskweave.plans import roles
from riskweave.plans.entity_queries import consolidated
from riskweave.plans.outlier_queries import embedding_points
from riskweave.session import materialise


def points_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.ml_points(embedding_points(spark, sf_dir).select("id", "vec"))


def _named(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("id").alias("vec_id"), F.col("label").alias("cluster"))


def kmeans_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = points_of(spark, sf_dir)
    model = clustering.best_kmeans(points, clustering.MAX_CLUSTERS)
    return clustering.with_centroid_distance(model, points).select(
        F.col("id").alias("vec_id"), F.col("label").alias("cluster"), rounded(F.col("distance")).alias("distance")
    )


def minibatch_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(clustering.minibatch_kmeans(points_of(spark, sf_dir), clustering.MAX_CLUSTERS))


def gaussian_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(clustering.gaussian_mixture(points_of(spark, sf_dir), clustering.MAX_CLUSTERS))


def mixture_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, variance and covariance with the next entry that the fitted mixture gives each entry.

    The rounds of a right fit keep them equal to the points' own.
    """
    model = mixture.fit_mixture(embedding_points(spark, sf_dir).select("id", "vec"), clustering.MAX_CLUSTERS)
    mean, cov = model.total_covariance()
    width = len(mean)
    rows = [
        (i + 1, round(float(mean[i]), 6), round(float(cov[i, i]), 6), round(float(cov[i, (i + 1) % width]), 6)) for i in range(width)
    ]
    return spark.createDataFrame(rows, "entry int, mean double, variance double, next_covariance double")


def mixture_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of every point's responsibilities, and whether its label has the largest."""
    points = embedding_points(spark, sf_dir).select("id", "vec")
    told = mixture.fit_mixture(points, clustering.MAX_CLUSTERS).responsibilities(points)
    total = F.aggregate("parts", F.lit(0.0), lambda a, x: a + x)
    return told.select(
        F.col("id").alias("vec_id"), F.round(total, 9).alias("total"), (F.get("parts", F.col("label")) == F.array_max("parts")).alias("likeliest")
    )


def cf_microclusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(clustering.cf_clusters(points_of(spark, sf_dir), clustering.MAX_CLUSTERS))


def ward_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(clustering.ward(points_of(spark, sf_dir), clustering.MAX_CLUSTERS))


def ward_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of merges of Ward's hierarchy, the cheapest, and what all of them add to the inner sum of squares."""
    merges = agglomerative.ward_merges(embedding_points(spark, sf_dir).select("id", "vec"))
    return merges.agg(
        F.count(F.lit(1)).alias("merges"), rounded(F.min("cost")).alias("cheapest"), rounded(F.sum("cost")).alias("total")
    )


def feature_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over all clustering features: rows, entries, squares; and whether every feature keeps its radius."""
    features, _ = agglomerative.cluster_features(embedding_points(spark, sf_dir).select("id", "vec"), clustering.CF_RADIUS)
    sums = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x) * F.col("size")
    squares = F.col("squares") + F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x) * F.col("size")
    inside = F.sqrt(F.col("squares") / F.col("size")) <= clustering.CF_RADIUS * (1 + 1e-9)
    return features.agg(
        F.sum("size").cast("long").alias("rows"), rounded(F.sum(sums)).alias("entries"), rounded(F.sum(squares)).alias("squares"), F.bool_and(inside).alias("inside")
    )


def bisecting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(clustering.bisecting(points_of(spark, sf_dir), clustering.MAX_CLUSTERS))


def density_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = embedding_points(spark, sf_dir).select("id", "vec")
    return _named(density.density_clusters(vectors, min_cluster_size=10, min_samples=5))


def pca_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = points_of(spark, sf_dir)
    out = clustering.Projection.fit(points, 2).transform(points)
    return out.select(
        F.col("id").alias("vec_id"),
        rounded(F.get("coords", F.lit(0))).alias("pca_x"),
        rounded(F.get("coords", F.lit(1))).alias("pca_y"),
    )


def cluster_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Theme of each given embedding label."""
    rows = embedding_points(spark, sf_dir)
    return rows.groupBy(clustering.cluster_theme(F.col("label")).alias("theme")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def louvain_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = materialise(edges.physical_edges(roles.evidence(spark, sf_dir)), "edges")
    return communities.louvain(consolidated(spark, sf_dir), links)


def community_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary over given groups, so that SQL can check it: the country code
    stands for the community and the degree for the rank."""
    nodes = consolidated(spark, sf_dir)
    links = edges.physical_edges(roles.evidence(spark, sf_dir))
    ranked = nodes.join(edges.node_degree(nodes, links), "entity_id").select(
        "entity_id", "entity_name", F.col("country_code").alias("community_id"), F.col("degree").alias("pagerank")
    )
    return communities.community_summary(ranked)


QUERIES = {
    "kmeans_clusters": kmeans_clusters,
    "minibatch_kmeans": minibatch_kmeans,
    "gaussian_mixture": gaussian_mixture,
    "mixture_moments": mixture_moments,
    "mixture_shares": mixture_shares,
    "cf_microclusters": cf_microclusters,
    "ward_clusters": ward_clusters,
    "ward_heights": ward_heights,
    "feature_totals": feature_totals,
    "bisecting": bisecting,
    "density_clusters": density_clusters,
    "pca_2d": pca_2d,
    "cluster_themes": cluster_themes,
    "louvain_communities": louvain_communities,
    "community_summary": community_summary,
}

_THEME = (
    "CASE label "
    + " ".join(f"WHEN {n} THEN '{t}'" for n, t in clustering.CLUSTER_THEMES.items())
    + f" ELSE '{clustering.OTHER_THEME}' END"
)

_CELLS = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
  cell AS MATERIALIZED (SELECT unnest(v) AS x, unnest(v[2:] || [v[1]]) AS y, generate_subscripts(v, 1) AS entry FROM e)"""

ORACLES = {
    "mixture_moments": _CELLS
    + """ SELECT entry::INT AS entry, round(avg(x), 6) + 0.0 AS mean, round(var_pop(x), 6) + 0.0 AS variance,
      round(covar_pop(x, y), 6) + 0.0 AS next_covariance FROM cell GROUP BY 1""",
    "ward_heights": _CELLS
    + """, places AS (SELECT DISTINCT v FROM e),
      first AS (SELECT min(list_distance(a.v, b.v) ^ 2 * na * nb / (na + nb)) AS cheapest
        FROM (SELECT v, count(*)::DOUBLE AS na FROM e GROUP BY 1) a JOIN (SELECT v, count(*)::DOUBLE AS nb FROM e GROUP BY 1) b ON a.v < b.v)
      SELECT (SELECT count(*) - 1 FROM places) AS merges, (SELECT round(cheapest, 6) FROM first) AS cheapest,
        (SELECT round(sum(s), 6) FROM (SELECT var_pop(x) * count(*) AS s FROM cell GROUP BY entry)) AS total""",
    "feature_totals": _CELLS
    + """ SELECT (SELECT count(*) FROM e) AS rows, round(sum(x), 6) + 0.0 AS entries, round(sum(x * x), 6) AS squares, true AS inside FROM cell""",
    "mixture_shares": "SELECT vec_id, 1.0::DOUBLE AS total, true AS likeliest FROM embeddings",
    "cluster_themes": f"SELECT {_THEME} AS theme, count(*) AS rows FROM embeddings GROUP BY 1",
    "community_summary": roles.with_ctes("consolidated", "collapsed")
    + """,
      ends AS (SELECT source AS entity_id FROM collapsed UNION ALL SELECT target FROM collapsed),
      deg AS (SELECT c.entity_id, c.entity_name, c.country_code, count(e.entity_id) AS d
              FROM consolidated c LEFT JOIN ends e USING (entity_id) GROUP BY 1, 2, 3),
      r AS (SELECT *, row_number() OVER (PARTITION BY country_code ORDER BY d DESC, entity_id) AS rn,
              count(*) OVER (PARTITION BY country_code) AS size FROM deg)
      SELECT country_code AS community_id, any_value(size) AS size,
        string_agg(entity_name, ', ' ORDER BY rn) || CASE WHEN any_value(size) > 5 THEN '...' ELSE '' END AS miembros_principales
      FROM r WHERE rn <= 5 GROUP BY 1""",
}
