"""Reading the raw tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave import schemas
from riskweave.session import path_exists

# Cell texts that mean "missing" in the CSV inputs.
NULL_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

SOURCE_RESULTS_FILE = "entity_source_results.csv"
EVIDENCE_FILE = "evidence_items.csv"
MATCH_SUMMARY_FILE = "entity_match_summary.csv"
FOCUS_FILE = "test.csv"


def resolve_input_dir(spark: SparkSession, root: str, mode: str | None = None) -> str:
    """``root/mode`` when that folder exists, else ``root``."""
    if mode:
        candidate = f"{root.rstrip('/')}/{mode}"
        if path_exists(spark, candidate):
            return candidate
    return root.rstrip("/")


def normalise_nulls(df: DataFrame) -> DataFrame:
    """Turn the missing-value tokens of string columns into nulls."""
    cols = {
        f.name: F.when(~F.col(f"`{f.name}`").isin(*NULL_TOKENS), F.col(f"`{f.name}`"))
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType)
    }
    return df.withColumns(cols) if cols else df


def nulls_to_blank(df: DataFrame) -> DataFrame:
    """The opposite rule, for the full-outer consolidation: null text is ""."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.na.fill("", names) if names else df


def with_row_order(df: DataFrame, order_column: str | None = None) -> DataFrame:
    """Add ``ord``: an explicit order column, else the scan position.

    The scan position is only meaningful for a single input file; larger inputs
    should name a column.
    """
    if "ord" in df.columns:
        return df
    if order_column:
        return df.withColumn("ord", F.col(order_column).cast("long"))
    return df.withColumn("ord", F.monotonically_increasing_id())


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, order_column: str | None = None
) -> DataFrame:
    """Header CSV with quoted JSON; columns are matched by name.

    The header decides which of the schema's columns are present, so optional
    columns may be absent and extra ones are ignored.
    """
    options = {"header": True, "multiLine": True, "escape": '"', "quote": '"'}
    present = spark.read.options(**options).csv(path)
    wanted = [f for f in schema.fields if f.name in present.columns]
    selected = present.select([F.col(f"`{f.name}`") for f in wanted])
    clean = normalise_nulls(with_row_order(selected, order_column))
    return clean.withColumns({f.name: F.col(f.name).try_cast(f.dataType) for f in wanted})


def read_table(spark: SparkSession, path: str, schema: T.StructType, **kw) -> DataFrame:
    """CSV by extension, else Parquet."""
    if path.endswith(".csv"):
        return read_csv(spark, path, schema, **kw)
    return with_row_order(spark.read.parquet(path), kw.get("order_column"))


def load_raw(
    spark: SparkSession, root: str, mode: str | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three raw tables; a missing one raises Spark's PATH_NOT_FOUND."""
    base = resolve_input_dir(spark, root, mode)
    return (
        read_csv(spark, f"{base}/{SOURCE_RESULTS_FILE}", schemas.SOURCE_RESULTS),
        read_csv(spark, f"{base}/{EVIDENCE_FILE}", schemas.EVIDENCE),
        read_csv(spark, f"{base}/{MATCH_SUMMARY_FILE}", schemas.MATCH_SUMMARY),
    )


def read_focus(spark: SparkSession, root: str, size: int = 5) -> DataFrame | None:
    """First ``size`` ids of the optional focus list, or None without the file."""
    path = f"{root.rstrip('/')}/{FOCUS_FILE}"
    if not path_exists(spark, path):
        return None
    rows = read_csv(spark, path, schemas.FOCUS)
    return (
        rows.orderBy("ord").limit(size).where(F.col("entity_id").isNotNull())
        .select("entity_id", "ord")
    )


def preview(df: DataFrame, rows: int = 5) -> None:
    """Print the schema and a few rows."""
    df.printSchema()
    df.show(rows)
