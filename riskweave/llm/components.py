"""Connected components by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.session import drop_table, materialise_at

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex is linked to the least of its neighbourhood."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A vertex and its smaller neighbours are linked to the least of them; ``a > b`` in ``edges``."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def _is_stars(edges: DataFrame) -> bool:
    """Whether every vertex points to one root that points nowhere; ``a > b`` in ``edges``."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.lit(1).alias("out")), F.struct(F.col("b").alias("v"), F.lit(0).alias("out")))).alias("e"))
    per = ends.groupBy("e.v").agg(F.sum("e.out").alias("out"), F.count(F.lit(1)).alias("n"))
    return not per.where("out > 1 OR (out = 1 AND n > 1)").limit(1).count()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(v, root)`` for every vertex with an edge but the roots themselves.

    ``edges`` has long columns ``a, b``; loops and repeats are fine.  The root is
    the least vertex.  Sums over the neighbours of a hub are partial aggregates
    and its edges stay spread in the joins; state is a written table per round,
    and rounds end when only stars are left.
    """
    spark = edges.sparkSession
    hi, lo = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now, path = materialise_at(edges.where("a <> b").select(hi, lo).distinct(), "links")
    for _ in range(MAX_ROUNDS):
        if _is_stars(now):
            return now.select(F.col("a").alias("v"), F.col("b").alias("root"))
        stars, next_path = materialise_at(_small_star(_large_star(now)).distinct(), "links")
        drop_table(spark, path)
        now, path = stars, next_path
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
