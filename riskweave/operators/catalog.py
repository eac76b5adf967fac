"""One row per entity, from the match summary, the lookups and the evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave import schemas
from riskweave.functions import literals, text
from riskweave.sources.tables import with_row_order


def country_map(match_summary: DataFrame) -> DataFrame:
    """``(country_key, code)`` learnt from the matches; the latest row wins."""
    code = F.upper(F.trim("input_country"))
    return (
        match_summary.select(
            code.alias("code"),
            F.explode(literals.json_objects(F.col("matches_json"), "struct<country:string>")).alias("m"),
            "ord",
        )
        .where(F.col("code").isNotNull() & ~F.col("code").isin("UNKNOWN", ""))
        .where(F.col("m.country").isNotNull() & (F.col("m.country") != ""))
        .groupBy(F.lower(F.trim("m.country")).alias("country_key"))
        .agg(F.max_by("code", "ord").alias("code"))
    )


def _match_rows(match_summary: DataFrame) -> DataFrame:
    return match_summary.where(F.col("entity_id").isNotNull()).select(
        "entity_id",
        F.col("entity_name").alias("name"),
        F.col("input_entity_type").alias("raw_type"),
        F.col("input_country").alias("country"),
        F.lit(0).alias("prio"),
        "ord",
    )


def _query_rows(source_results: DataFrame) -> DataFrame:
    first = F.get(literals.parse_list(F.col("query_used"), schemas.QUERY_USED), F.lit(0))
    return (
        source_results.where(F.col("query_used").isNotNull())
        .select(first.alias("q"), "ord")
        .where(F.col("q.entity_id").isNotNull() & (F.col("q.entity_id") != ""))
        .select(
            F.col("q.entity_id").alias("entity_id"),
            F.col("q.query_value").alias("name"),
            F.col("q.metadata.entity_type").alias("raw_type"),
            F.col("q.metadata.country_code").alias("country"),
            F.lit(1).alias("prio"),
            "ord",
        )
    )


def _orphan_rows(source_results: DataFrame) -> DataFrame:
    return source_results.where(F.col("entity_id").isNotNull()).select(
        "entity_id",
        F.concat(F.lit("Entidad Desconocida "), "entity_id").alias("name"),
        F.lit(None).cast("string").alias("raw_type"),
        F.lit(None).cast("string").alias("country"),
        F.lit(2).alias("prio"),
        "ord",
    )


def _evidence_rows(evidence: DataFrame) -> DataFrame:
    country = F.col("country") if "country" in evidence.columns else F.lit(None).cast("string")
    return evidence.where(F.col("entity_id").isNotNull()).select(
        "entity_id",
        F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("string").alias("raw_type"),
        country.alias("country"),
        F.lit(3).alias("prio"),
        "ord",
    )


def entity_catalog(
    source_results: DataFrame,
    evidence: DataFrame | None = None,
    match_summary: DataFrame | None = None,
) -> DataFrame:
    """Entity catalog ``(entity_id, entity_name, entity_type, country_code)``.

    Match rows beat lookup rows, lookup rows beat bare ids, and among equals the
    first row wins.  All candidates go through one aggregation with partial
    combining, so one exchange replaces dedup, anti join and union.  Evidence
    rows join the same exchange only to supply an orphan's first country.
    """
    source_results = with_row_order(source_results)
    rows = _query_rows(source_results).unionByName(_orphan_rows(source_results))
    if match_summary is not None:
        match_summary = with_row_order(match_summary)
        rows = rows.unionByName(_match_rows(match_summary))
    if evidence is not None:
        rows = rows.unionByName(_evidence_rows(with_row_order(evidence)))

    rank = F.when(F.col("prio") < 3, F.struct("prio", "ord"))
    picked = (
        rows.groupBy("entity_id")
        .agg(
            F.min_by(F.struct("name", "raw_type", "country", "prio"), rank).alias("pick"),
            F.min_by(F.struct("country"), F.when(F.col("prio") == 3, F.col("ord"))).alias("seen"),
        )
        .where(F.col("pick").isNotNull())
        .select(
            "entity_id",
            F.col("pick.name").alias("entity_name"),
            text.entity_type(F.col("pick.raw_type")).alias("entity_type"),
            F.when(F.col("pick.prio") == 2, F.col("seen.country"))
            .otherwise(F.col("pick.country"))
            .alias("raw_country"),
        )
    )
    if match_summary is None:
        code = text.country_code(F.col("raw_country"), F.lit(None).cast("string"))
        return picked.select("entity_id", "entity_name", "entity_type", code.alias("country_code"))
    mapping = country_map(match_summary)
    return picked.join(
        mapping, F.lower(F.trim("raw_country")) == F.col("country_key"), "left"
    ).select(
        "entity_id",
        "entity_name",
        "entity_type",
        text.country_code(F.col("raw_country"), F.col("code")).alias("country_code"),
    )
