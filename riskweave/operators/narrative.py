"""Report text of an entity, from its consolidated and graph columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions.text import UNKNOWN_COUNTRY

PERSON_KIND = {"FISICA": "Persona Física", "MORAL": "Persona Moral"}


def narratives(nodes: DataFrame) -> DataFrame:
    """``(entity_id, narrative)``: profile, reasons for the alert, graph context.

    The graph sentence appears when community_id and pagerank are present.
    """
    kind = F.lit("Entidad de otro tipo")
    for code, text in PERSON_KIND.items():
        kind = F.when(F.col("entity_type") == code, text).otherwise(kind)
    place = F.when(F.col("country_code") == UNKNOWN_COUNTRY, "país no determinado").otherwise(
        F.concat(F.lit("país "), "country_code")
    )
    profile = F.concat(
        F.coalesce("entity_name", "entity_id"), F.lit(" ("), "entity_id", F.lit("): "), kind, F.lit(", "), place, F.lit(".")
    )
    reasons = F.format_string(
        "Evidencias: %d (en revisión: %d); coincidencia máxima de identidad: %.2f; fuentes con hallazgo: %d.",
        "evidence_items", "review_items", "max_identity_score", "sources_with_hallazgo",
    )
    sentences = [profile, reasons]
    if {"community_id", "pagerank"} <= set(nodes.columns):
        sentences.append(
            F.format_string("Comunidad relacional: %d; PageRank: %.6f.", "community_id", "pagerank")
        )
    return nodes.select("entity_id", F.concat_ws(" ", *sentences).alias("narrative"))
