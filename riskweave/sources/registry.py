"""Output layout of a run, table sinks, and the shared model registry."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.session import path_exists

MODES = ("train", "use")
RUN_ID_FORMAT = "%Y-%m-%d_%H-%M-%S"


@dataclass(frozen=True)
class RunContext:
    """Where one run reads shared models and writes its tables."""

    root: str
    mode: str
    run_id: str

    @classmethod
    def start(cls, root: str, mode: str = "use", run_id: str | None = None) -> RunContext:
        mode = mode.strip().lower()
        if mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        return cls(root.rstrip("/"), mode, run_id or datetime.now().strftime(RUN_ID_FORMAT))

    @property
    def run_dir(self) -> str:
        return f"{self.root}/mode={self.mode}/run_id={self.run_id}"

    @property
    def models_dir(self) -> str:
        return f"{self.root}/shared/models"

    def table(self, name: str) -> str:
        return f"{self.run_dir}/{name}"

    def model(self, name: str) -> str:
        return f"{self.models_dir}/{name}"

    def audit_copy(self, name: str) -> str:
        return f"{self.run_dir}/models/{name}"

    def write(self, df: DataFrame, name: str, fmt: str = "parquet") -> DataFrame:
        """Write a table of this run and return a scan of it."""
        path = self.table(name)
        if fmt == "csv":
            write_csv(df, path)
            return df
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; nested columns are written as JSON text."""
    nested = {
        f.name: F.to_json(F.col(f"`{f.name}`"))
        for f in df.schema.fields
        if f.dataType.typeName() in ("array", "struct", "map")
    }
    flat = df.withColumns(nested) if nested else df
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def require_models(spark: SparkSession, ctx: RunContext, names: list[str]) -> None:
    """Raise unless every named model is registered."""
    missing = [n for n in names if not path_exists(spark, ctx.model(n))]
    if missing:
        raise FileNotFoundError(f"no registered model for {missing}; run the train workflow first")


def cached_vectors(
    spark: SparkSession, texts: DataFrame, cache: str, encode, id_col: str, text_col: str
) -> DataFrame:
    """Vectors of all texts, encoding only those the cache does not hold.

    The cache is a Parquet table keyed by id and a hash of the text.
    """
    keyed = texts.select(id_col, text_col, F.xxhash64(text_col).alias("text_hash"))
    if path_exists(spark, cache):
        known = spark.read.parquet(cache)
        missing = keyed.join(
            known.select(F.col("id").alias(id_col), "text_hash"), [id_col, "text_hash"], "left_anti"
        )
    else:
        missing = keyed
    fresh = encode(missing.select(id_col, text_col)).join(
        missing.select(F.col(id_col).alias("id"), "text_hash"), "id"
    )
    fresh.write.mode("append").parquet(cache)
    return (
        spark.read.parquet(cache)
        .join(keyed.select(F.col(id_col).alias("id"), "text_hash"), ["id", "text_hash"])
        .drop("text_hash")
    )
