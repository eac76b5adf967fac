"""Standardised feature vectors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions.stats import column_moments

DETECTOR_FEATURES = ("evidence_items", "max_identity_score", "sources_with_hallazgo")


@dataclass
class Scaler:
    """Mean and population deviation per feature; a constant column keeps scale 1."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    deviations: tuple[float, ...]

    @classmethod
    def fit(cls, df: DataFrame, features: Sequence[str] = DETECTOR_FEATURES) -> Scaler:
        moments = column_moments(df, features)
        return cls(
            tuple(features),
            tuple(m for m, _ in moments),
            tuple(d if d > 0 else 1.0 for _, d in moments),
        )

    def columns(self) -> list:
        return [
            (F.coalesce(F.col(n).cast("double"), F.lit(0.0)) - F.lit(m)) / F.lit(d)
            for n, m, d in zip(self.features, self.means, self.deviations)
        ]

    def transform(self, df: DataFrame, id_col: str = "entity_id") -> DataFrame:
        """``(id, vec)`` with the scaled features."""
        return df.select(F.col(id_col).alias("id"), F.array(*self.columns()).alias("vec"))

    def save(self, spark: SparkSession, path: str) -> None:
        rows = list(zip(range(len(self.features)), self.features, self.means, self.deviations))
        spark.createDataFrame(rows, "at int, feature string, mean double, deviation double").coalesce(
            1
        ).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Scaler:
        rows = spark.read.parquet(path).orderBy("at").collect()
        return cls(
            tuple(r["feature"] for r in rows),
            tuple(r["mean"] for r in rows),
            tuple(r["deviation"] for r in rows),
        )
