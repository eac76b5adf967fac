"""Evidence details of an entity and the text pieces of its node label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave import schemas
from riskweave.functions import literals, text
from riskweave.operators.profiles import ordered_distinct
from riskweave.session import materialise
from riskweave.sources.tables import with_row_order


def _column(df: DataFrame, name: str):
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def _row_facts(evidence: DataFrame) -> DataFrame:
    """One row per evidence item with its reasons, status and plain fields."""
    fields = evidence.select(
        "entity_id",
        "ord",
        text.blank_to_null(_column(evidence, "source_id")).alias("list_name"),
        text.blank_to_null(_column(evidence, "country")).alias("country"),
        text.blank_to_null(_column(evidence, "snippet")).alias("snippet"),
        literals.parse_dict(_column(evidence, "extracted_fields"), schemas.EXTRACTED_FIELDS).alias("x"),
    )

    def filled(name: str):
        return F.nullif(F.col(f"x.{name}"), F.lit(""))

    reason = F.coalesce(
        filled("statement_of_reasons"), filled("csd_cancellation_reason"), filled("review_reason")
    )
    programs = filled("programs_json")
    is_json = F.startswith(programs, F.lit("[")) | F.startswith(programs, F.lit("{"))
    # A serialised list gives one reason per element; a serialised object none.
    listed = F.when(
        F.startswith(programs, F.lit("[")),
        F.from_json(F.replace(programs, F.lit("'"), F.lit('"')), "array<string>"),
    )
    program_list = F.when(is_json, listed).otherwise(F.when(programs.isNotNull(), F.array(programs)))
    reasons = F.concat(
        F.array(reason),
        F.array(F.concat(F.lit("Regime: "), filled("regime_name"))),
        F.transform(
            F.coalesce(program_list, F.array().cast("array<string>")),
            lambda p: F.concat(F.lit("Prog: "), p),
        ),
    )
    return fields.select(
        "entity_id",
        "ord",
        "list_name",
        "country",
        "snippet",
        F.coalesce(filled("status"), filled("supposition")).alias("status"),
        F.filter(reasons, lambda r: r.isNotNull()).alias("reasons"),
    )


def evidence_details(evidence: DataFrame) -> DataFrame:
    """``(entity_id, lists, reasons, status, country)`` per entity with evidence.

    Reasons are distinct in order of appearance.  A snippet stands in as a
    reason only while no row up to its own has given one.
    """
    # Parsed once, read by three aggregations.
    facts = materialise(
        _row_facts(with_row_order(evidence).where(F.col("entity_id").isNotNull())), "facts"
    )

    def first_of(name: str):
        return F.min_by(name, F.when(F.col(name).isNotNull(), F.col("ord"))).alias(name)

    has_reason = F.size("reasons") > 0
    singles = facts.groupBy("entity_id").agg(
        first_of("status"),
        first_of("country"),
        F.min(F.when(has_reason, F.col("ord"))).alias("reason_ord"),
        F.min(F.when(F.col("snippet").isNotNull(), F.struct("ord", "snippet"))).alias("first_snippet"),
    )
    lists = ordered_distinct(
        facts.where(F.col("list_name").isNotNull()), "entity_id", "list_name", "ord", "lists"
    )
    given = facts.select("entity_id", "ord", F.posexplode("reasons").alias("pos", "reason")).select(
        "entity_id", "reason", F.struct("ord", "pos").alias("at")
    )
    reasons = ordered_distinct(given, "entity_id", "reason", "at", "reasons")
    # The snippet comes first when its row precedes every row with a reason.
    opening = F.when(
        F.col("first_snippet").isNotNull()
        & (F.col("reason_ord").isNull() | (F.col("first_snippet.ord") < F.col("reason_ord"))),
        F.array("first_snippet.snippet"),
    )
    empty = F.array().cast("array<string>")
    return (
        singles.join(lists, "entity_id", "left")
        .join(reasons, "entity_id", "left")
        .select(
            "entity_id",
            F.coalesce("lists", empty).alias("lists"),
            F.array_distinct(
                F.concat(F.coalesce(opening, empty), F.coalesce("reasons", empty))
            ).alias("reasons"),
            "status",
            "country",
        )
    )


def node_labels(nodes: DataFrame, details: DataFrame, centre_ids: DataFrame | None = None) -> DataFrame:
    """Label text of each node.

    ``nodes`` holds entity_id, entity_name and the flags is_outlier and
    is_blacklist.  With ``centre_ids`` the ego-network form is used: only a
    centre node spells out all its reasons.
    """
    d = nodes.join(details.withColumn("_known", F.lit(True)), "entity_id", "left")
    known = F.coalesce("_known", F.lit(False))
    outlier = F.col("is_outlier") == 1
    head = F.concat(F.coalesce("entity_name", F.col("entity_id")), F.lit("\n("), F.col("entity_id"), F.lit(")"))
    lists = F.when(F.size("lists") > 0, F.concat(F.lit("Listas: "), F.array_join("lists", ",")))
    status = F.concat(F.lit("Estado: "), F.col("status"))
    every = F.when(
        F.size("reasons") > 0, F.concat(F.lit("Motivo:\n"), F.array_join("reasons", "; "))
    )
    if centre_ids is None:
        reason, ordinary = every, ~F.col("is_blacklist") & ~outlier
    else:
        d = d.join(
            centre_ids.select("entity_id").distinct().withColumn("_centre", F.lit(True)),
            "entity_id",
            "left",
        )
        centre = F.coalesce("_centre", F.lit(False))
        one = F.when(
            F.size("reasons") > 0,
            F.concat(F.lit("Motivo: "), text.shorten(F.get("reasons", F.lit(0)))),
        )
        reason, ordinary = F.when(centre, every).otherwise(one), ~centre & ~outlier
    label = F.concat_ws(
        "\n",
        head,
        F.when(outlier, "[ANÓMALO]"),
        F.when(known, lists),
        F.when(known, status),
        F.when(known, reason),
        F.when(~known & ordinary, "(Nodo Ordinario)"),
    )
    return d.select("entity_id", label.alias("label"))
