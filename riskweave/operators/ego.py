"""Ego networks: the strongest neighbours of each entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.operators.edges import KEY_WEIGHTS, SEMANTIC, both_ways, counted_in

MAX_NEIGHBOURS = 30
MAX_ENTITIES = 10


def ego_network(edges: DataFrame, centres: DataFrame | None = None, top: int = MAX_NEIGHBOURS) -> DataFrame:
    """Top neighbours per entity, semantic links first, then by weight.

    The rank filter is a group limit: each task keeps ``top`` rows per entity
    before the exchange, so a hub never gathers its whole neighbourhood.
    """
    shared = counted_in(edges)
    links = both_ways(edges, "relation_type") if shared is None else shared.strongest(top, KEY_WEIGHTS)
    if centres is not None:
        links = links.join(
            centres.select(F.col("entity_id").alias("src")).distinct(), "src", "left_semi"
        )
    order = Window.partitionBy("src").orderBy(
        (F.col("relation_type") == SEMANTIC).desc(),
        F.desc("weight"),
        "dst",
        "relation_type",
    )
    return (
        links.withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= top)
        .select(
            F.col("src").alias("entity_id"),
            F.col("dst").alias("neighbour_id"),
            "relation_type",
            "weight",
            "position",
        )
    )


def priority_entities(
    nodes: DataFrame, connected: DataFrame, focus: DataFrame | None = None, top: int = MAX_ENTITIES
) -> DataFrame:
    """Entities to look at first, among the ``connected(entity_id)`` ones.

    With a focus list the caller's order rules and nothing is cut; without one
    the label and then PageRank rank the entities and the first ``top`` stay.
    """
    linked = nodes.where(F.col("entity_id").isNotNull()).join(connected, "entity_id", "left_semi")
    if focus is not None:
        wanted = focus.groupBy("entity_id").agg(F.min("ord").alias("_at"))
        return linked.join(wanted, "entity_id").orderBy("_at").drop("_at")
    keys = [F.desc(c) for c in ("is_suspicious_analyst", "pagerank") if c in nodes.columns]
    return linked.orderBy(*keys, "entity_id").limit(top)
