"""Per-entity measures over the lookups and the evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions import text
from riskweave.sources.tables import nulls_to_blank, with_row_order

LABEL = "is_suspicious_analyst"


def source_measures(source_results: DataFrame) -> DataFrame:
    found = text.to_long(F.col("evidence_count").cast("string")) > 0
    return (
        source_results.where(F.col("entity_id").isNotNull())
        .groupBy("entity_id")
        .agg(
            F.count(F.lit(1)).alias("sources_evaluated"),
            F.count_if(found).alias("sources_with_hallazgo"),
        )
    )


def evidence_measures(evidence: DataFrame, review_mode: str = "strict") -> DataFrame:
    return (
        evidence.where(F.col("entity_id").isNotNull())
        .groupBy("entity_id")
        .agg(
            F.max(F.col("identity_score").cast("double")).alias("max_identity_score"),
            F.count(F.lit(1)).alias("evidence_items"),
            F.count_if(text.is_review(F.col("review_required"), review_mode)).alias("review_items"),
        )
    )


def match_measures(match_summary: DataFrame) -> DataFrame:
    """First match row per entity, so duplicates cannot multiply the result."""
    fields = [
        text.to_long(F.col("match_count").cast("string")).alias("match_count"),
        F.col("sources_hit"),
    ]
    if LABEL in match_summary.columns:
        fields.append(text.to_long(F.col(LABEL).cast("string")).cast("int").alias(LABEL))
    return (
        with_row_order(match_summary)
        .where(F.col("entity_id").isNotNull())
        .groupBy("entity_id")
        .agg(F.min_by(F.struct(*fields), "ord").alias("m"))
        .select("entity_id", "m.*")
    )


def processed_evidence(evidence: DataFrame) -> DataFrame:
    """Evidence with its review flag."""
    return evidence.withColumn("is_review", text.is_review(F.col("review_required")))


def duplicate_matches(match_summary: DataFrame) -> DataFrame:
    """Ids that occur more than once in the match summary."""
    return match_summary.groupBy("entity_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


# What a missing column counts as.
_FILL = {
    "sources_evaluated": 0,
    "sources_with_hallazgo": 0,
    "max_identity_score": 0.0,
    "evidence_items": 0,
    "review_items": 0,
    "match_count": 0,
    "sources_hit": "",
}


def consolidate_catalog(
    catalog: DataFrame,
    source_results: DataFrame,
    evidence: DataFrame,
    match_summary: DataFrame | None = None,
    review_mode: str = "strict",
) -> DataFrame:
    """Catalog with measures, decision and (when present) the analyst label.

    Every input is aggregated by ``entity_id`` with partial combining and the
    joins reuse that partitioning, so each table is exchanged once.
    """
    out = catalog.join(source_measures(source_results), "entity_id", "left").join(
        evidence_measures(evidence, review_mode), "entity_id", "left"
    )
    if match_summary is not None:
        out = out.join(match_measures(match_summary), "entity_id", "left")
    else:
        out = out.withColumns(
            {"match_count": F.lit(0).cast("long"), "sources_hit": F.lit("")}
        )
    fill = dict(_FILL)
    if LABEL in out.columns:
        fill[LABEL] = 0
    out = out.na.fill(fill)
    decision = text.overall_decision(F.col("review_items"), F.col("evidence_items"))
    cols = [
        *catalog.columns,
        *_FILL,
        decision.alias("overall_decision"),
        *([LABEL] if LABEL in out.columns else []),
    ]
    return out.select(*cols)


def consolidate_full_outer(
    source_results: DataFrame,
    evidence: DataFrame,
    match_summary: DataFrame,
    review_mode: str = "loose",
) -> DataFrame:
    """Measures for every id seen anywhere, null ids gathered under "".

    The full outer join of three aggregates is one aggregation over the three
    tables laid side by side: partial combining first, then a single exchange.
    """
    s, e, m = (nulls_to_blank(t) for t in (source_results, evidence, with_row_order(match_summary)))
    null_long, null_double, null_string = (
        F.lit(None).cast(t) for t in ("long", "double", "string")
    )
    found = text.to_long(F.col("evidence_count").cast("string")) > 0
    rows = (
        s.select(
            "entity_id",
            F.lit(1).cast("long").alias("src"),
            F.coalesce(found, F.lit(False)).cast("long").alias("hit"),
            null_double.alias("score"),
            null_long.alias("ev"),
            null_long.alias("rev"),
            null_long.alias("match_count"),
            null_string.alias("sources_hit"),
            null_long.alias("ord"),
        )
        .unionByName(
            e.select(
                "entity_id",
                null_long.alias("src"),
                null_long.alias("hit"),
                F.col("identity_score").cast("string").try_cast("double").alias("score"),
                F.lit(1).cast("long").alias("ev"),
                text.is_review(F.col("review_required"), review_mode).cast("long").alias("rev"),
                null_long.alias("match_count"),
                null_string.alias("sources_hit"),
                null_long.alias("ord"),
            )
        )
        .unionByName(
            m.select(
                "entity_id",
                null_long.alias("src"),
                null_long.alias("hit"),
                null_double.alias("score"),
                null_long.alias("ev"),
                null_long.alias("rev"),
                text.to_long(F.col("match_count").cast("string")).alias("match_count"),
                "sources_hit",
                F.col("ord"),
            )
        )
    )
    out = (
        rows.groupBy("entity_id")
        .agg(
            F.sum("src").alias("sources_evaluated"),
            F.sum("hit").alias("sources_with_hallazgo"),
            F.max("score").alias("max_identity_score"),
            F.sum("ev").alias("evidence_items"),
            F.sum("rev").alias("review_items"),
            F.min_by(F.struct("match_count", "sources_hit"), "ord").alias("m"),
        )
        .select(
            "entity_id",
            "sources_evaluated",
            "sources_with_hallazgo",
            "max_identity_score",
            "evidence_items",
            "review_items",
            "m.match_count",
            "m.sources_hit",
        )
        .na.fill(_FILL)
    )
    return out.withColumn(
        "overall_decision", text.overall_decision(F.col("review_items"), F.col("evidence_items"))
    )


def label_distribution(consolidated: DataFrame, label: str = LABEL) -> DataFrame:
    """Share of each label value, four decimals.

    The total is taken over the counts, whose number is the number of labels.
    """
    from pyspark.sql import Window

    counts = consolidated.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("rows"))
    total = F.sum("rows").over(Window.partitionBy(F.lit(1)))
    return counts.select("label", "rows", F.round(F.col("rows") / total, 4).alias("share"))
