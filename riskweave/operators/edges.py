"""Links between entities: shared references, shared content, similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions import text
from riskweave.operators.pairs import BLOCK_ROWS, grouped_pairs, pairs_sharing_at_least
from riskweave.operators.shared import SharedKeys, shared_lists
from riskweave.session import materialise
from riskweave.sources.tables import with_row_order

SHARED_REFERENCE = "shared_reference"
SHARED_CONTENT = "shared_content"
SEMANTIC = "semantic_similarity"

# What one shared key adds to an edge.
KEY_WEIGHTS = {SHARED_REFERENCE: 1.0, SHARED_CONTENT: 1.5}
KEY_COLUMNS = {SHARED_REFERENCE: "url_or_reference", SHARED_CONTENT: "raw_content_hash"}
NOISE_WEIGHT = 2.0


def key_members(evidence: DataFrame, key: str) -> DataFrame:
    """Distinct ``(key, entity_id)`` with the first row that showed it."""
    return (
        evidence.where(F.col(key).isNotNull() & F.col("entity_id").isNotNull())
        .groupBy(F.col(key).alias("key"), "entity_id")
        .agg(F.min("ord").alias("first_ord"))
    )


def linked_entities(evidence: DataFrame) -> DataFrame:
    """Ids with any physical edge: those of a key with two members or more. No pair is made."""
    evidence = with_row_order(evidence)
    found = None
    for column in (KEY_COLUMNS[r] for r in _present_keys(evidence)):
        members = key_members(evidence, column).select("key", "entity_id")
        shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        ids = members.join(shared.select("key"), "key", "left_semi").select("entity_id")
        found = ids if found is None else found.unionByName(ids)
    return found.distinct()


def _present_keys(evidence: DataFrame) -> list[str]:
    return [r for r, c in KEY_COLUMNS.items() if c in evidence.columns]


def shared_key_pairs(evidence: DataFrame, relation: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every ``(key, source, target)`` sharing, one row per shared key."""
    members = key_members(evidence, KEY_COLUMNS[relation])
    return grouped_pairs(members, "key", "entity_id", ("first_ord",), block_rows)


def _shared(evidence: DataFrame) -> SharedKeys | None:
    """The evidence's shared keys, where counting them in cells sends less than joining pairs."""
    return shared_lists(
        {r: key_members(evidence, KEY_COLUMNS[r]).select("key", "entity_id") for r in _present_keys(evidence)}
    )


def counted_in(edges: DataFrame, evidence: DataFrame | None = None) -> SharedKeys | None:
    """What an edge table was made from, if nothing was done to it since; with ``evidence`` all edges of this very frame."""
    shared, of = edges.__dict__.get("_counted_in", (None, None))
    if evidence is not None and (of is not evidence or any(m > 1 for m in shared.minimum.values())):
        return None
    return shared


def _kinds(shared: SharedKeys) -> Column:
    """``(relation_type, weight)`` of a pair in each relation, 0 where it is not linked."""
    return F.array(
        *[
            F.struct(F.lit(r).alias("relation_type"), (F.col(r) * F.lit(KEY_WEIGHTS[r])).alias("weight"))
            for r in shared.relations
        ]
    )


def _edges_of(shared: SharedKeys, evidence: DataFrame) -> DataFrame:
    """One row per pair and relation; the frame remembers what it was made from."""
    out = shared.pairs().select("source", "target", F.inline(_kinds(shared))).where("weight > 0")
    out.__dict__["_counted_in"] = (shared, evidence)
    return out


def physical_edges(
    evidence: DataFrame,
    orientation: str = "canonical",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Edges ``(source, target, relation_type, weight)`` summed over shared keys.

    ``canonical`` puts the smaller id first.  ``first_seen`` follows the order in
    which a key met its entities, so one pair may appear in both directions.
    """
    given, evidence = evidence, with_row_order(evidence)
    shared = _shared(evidence) if orientation == "canonical" and _present_keys(evidence) else None
    if shared is not None:
        return _edges_of(shared, given)
    parts = []
    for relation in _present_keys(evidence):
        pairs = shared_key_pairs(evidence, relation, block_rows)
        if orientation == "first_seen":
            later = F.col("a_first_ord") > F.col("b_first_ord")
            source = F.when(later, F.col("b")).otherwise(F.col("a"))
            target = F.when(later, F.col("a")).otherwise(F.col("b"))
        elif orientation == "canonical":
            source, target = F.col("a"), F.col("b")
        else:
            raise ValueError(f"unknown orientation {orientation!r}")
        parts.append(
            pairs.groupBy(source.alias("source"), target.alias("target"))
            .agg((F.count(F.lit(1)) * F.lit(KEY_WEIGHTS[relation])).alias("weight"))
            .select("source", "target", F.lit(relation).alias("relation_type"), "weight")
        )
    if not parts:
        raise ValueError("evidence has neither a reference nor a content column")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def strong_edges(evidence: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Physical edges that pass the noise filter, without building the rest.

    Equal to ``drop_noise(physical_edges(evidence))``.  A reference edge needs
    two shared references, so its pairs come from the prefix-filtered join and a
    list that everybody shares produces nothing to throw away.
    """
    given, evidence = evidence, with_row_order(evidence)
    per_key = KEY_WEIGHTS[SHARED_REFERENCE]
    shared = _shared(evidence)
    if shared is not None:
        return _edges_of(shared.at_least(SHARED_REFERENCE, int(NOISE_WEIGHT / per_key)), given)
    refs = pairs_sharing_at_least(
        key_members(evidence, KEY_COLUMNS[SHARED_REFERENCE]).select("key", "entity_id"),
        "key",
        "entity_id",
        minimum=int(NOISE_WEIGHT / per_key),
        block_rows=block_rows,
    ).select(
        F.col("a").alias("source"),
        F.col("b").alias("target"),
        F.lit(SHARED_REFERENCE).alias("relation_type"),
        (F.col("shared") * F.lit(per_key)).alias("weight"),
    )
    if KEY_COLUMNS[SHARED_CONTENT] not in evidence.columns:
        return refs
    content = physical_edges(evidence.drop(KEY_COLUMNS[SHARED_REFERENCE]), block_rows=block_rows)
    return refs.unionByName(content)


def drop_noise(edges: DataFrame, minimum: float = NOISE_WEIGHT) -> DataFrame:
    """Keep an edge unless it is a weak shared reference."""
    return edges.where((F.col("relation_type") != SHARED_REFERENCE) | (F.col("weight") >= minimum))


def merge_semantic(edges: DataFrame, links: DataFrame) -> DataFrame:
    """Add similarity links; repeated edges keep their largest weight."""
    cols = ["source", "target", "relation_type", "weight"]
    shared = counted_in(edges)
    if shared is not None:
        found = links.groupBy("source", "target", "relation_type").agg(F.max("weight").alias("weight"))
        found = materialise(found, "links")
        if not found.where(F.col("relation_type").isin(shared.relations)).limit(1).count():
            return edges.select(cols).unionByName(found)  # these edges come once each
    return (
        edges.select(cols)
        .unionByName(links.select(cols))
        .groupBy("source", "target", "relation_type")
        .agg(F.max("weight").alias("weight"))
    )


def collapse(edges: DataFrame) -> DataFrame:
    """One undirected edge per pair; the last one in table order wins.

    Table order is by source, target and relation, as the edge table is sorted.
    """
    shared = counted_in(edges)
    if shared is not None:  # a pair's relations come together there, and no pair comes twice
        last = F.lit(None)
        for r in sorted(shared.relations):
            weight = (F.col(r) * F.lit(KEY_WEIGHTS[r])).alias("weight")
            last = F.when(F.col(r) > 0, F.struct(F.lit(r).alias("relation_type"), weight)).otherwise(last)
        return shared.pairs().select("source", "target", last.alias("e")).select("source", "target", "e.relation_type", "e.weight")
    a, b = F.least("source", "target"), F.greatest("source", "target")
    return (
        edges.where(F.col("source") != F.col("target"))
        .groupBy(a.alias("a"), b.alias("b"))
        .agg(
            F.max_by(
                F.struct("relation_type", "weight"), F.struct("source", "target", "relation_type")
            ).alias("e")
        )
        .select(
            F.col("a").alias("source"),
            F.col("b").alias("target"),
            F.col("e.relation_type").alias("relation_type"),
            F.col("e.weight").alias("weight"),
        )
    )


def both_ways(edges: DataFrame, *extra: str) -> DataFrame:
    """Symmetric view ``(src, dst, weight, …)`` holding each edge twice.

    The two directions come from one pass over the edges.
    """
    directions = F.array(
        F.struct(F.col("source").alias("src"), F.col("target").alias("dst")),
        F.struct(F.col("target").alias("src"), F.col("source").alias("dst")),
    )
    return edges.select(F.explode(directions).alias("d"), "weight", *extra).select(
        "d.src", "d.dst", "weight", *extra
    )


def inside_catalog(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are both catalogued."""
    ids = nodes.select(F.col("entity_id").alias("_id")).distinct()
    return edges.join(ids, F.col("source") == F.col("_id"), "left_semi").join(
        ids, F.col("target") == F.col("_id"), "left_semi"
    )


def edge_ends(edges: DataFrame) -> DataFrame:
    """Ids at either end of an edge."""
    return edges.select(F.explode(F.array("source", "target")).alias("entity_id")).distinct()


def graph_nodes(catalog: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids of all graph nodes: the catalog and every edge end."""
    return catalog.select("entity_id").unionByName(edge_ends(edges)).distinct()


def node_degree(catalog: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct neighbours per node, zero for isolated ones."""
    shared = counted_in(edges)
    if shared is not None:
        everyone = catalog.select("entity_id", F.lit(0).cast("long").alias("n")).unionByName(shared.degrees())
        return everyone.groupBy("entity_id").agg(F.sum("n").alias("degree"))
    linked = both_ways(collapse(edges)).select(F.col("src").alias("entity_id"), F.lit(1).alias("one"))
    everyone = catalog.select("entity_id", F.lit(0).alias("one")).unionByName(linked)
    return everyone.groupBy("entity_id").agg(F.sum("one").alias("degree"))


def relation_counts(edges: DataFrame) -> DataFrame:
    shared = counted_in(edges)
    if shared is not None:
        return shared.totals().groupBy("relation_type").agg(F.sum("n").alias("edges"))
    return edges.groupBy("relation_type").agg(F.count(F.lit(1)).alias("edges"))


# Row names of the topology table, in report order.
TOPOLOGY_ROWS = (
    "Total de Entidades (Nodos)",
    "Relaciones por Referencias Compartidas",
    "Relaciones por Contenido Compartido",
    "Vínculos Semánticos Ocultos Detectados (Embeddings)",
    "Total de Enlaces en el Grafo",
    "Comunidades Estructurales Identificadas (Louvain)",
)


def topology_stats(nodes: DataFrame, edges: DataFrame, communities: DataFrame | None = None) -> DataFrame:
    """Six counts as ``(Métrica, Valor)`` rows, counted in one aggregation."""

    def tag(df: DataFrame, kind: Column) -> DataFrame:
        return df.select(kind.alias("kind"), F.lit(1).cast("long").alias("n"))

    shared = counted_in(edges)
    told = shared.totals().toDF("kind", "n") if shared is not None else tag(edges, F.col("relation_type"))
    rows = tag(nodes, F.lit("node")).unionByName(told)
    if communities is not None:
        rows = rows.unionByName(tag(communities, F.lit("community")))
    kind = F.col("kind")
    total = lambda what, name: F.coalesce(F.sum(F.when(what, F.col("n"))), F.lit(0)).alias(name)
    counts = rows.agg(
        total(kind == "node", "c0"),
        total(kind == SHARED_REFERENCE, "c1"),
        total(kind == SHARED_CONTENT, "c2"),
        total(kind == SEMANTIC, "c3"),
        total(~kind.isin("node", "community"), "c4"),
        total(kind == "community", "c5"),
    )
    table = F.array(
        *[
            F.struct(F.lit(name).alias("Métrica"), F.col(f"c{i}").alias("Valor"))
            for i, name in enumerate(TOPOLOGY_ROWS)
        ]
    )
    return counts.select(F.inline(table))


def shared_keys_of(edges: DataFrame, evidence: DataFrame, relation: str) -> DataFrame:
    """Smallest shared key behind each given pair, ``(source, target, key)``.

    The lookup starts from the end that holds fewer keys, so an edge next to a
    hub costs what its small end costs.
    """
    shared = counted_in(edges, evidence)
    if shared is not None and relation in shared.relations:
        pairs = shared.pairs(least=True).where(F.col(relation) > 0)
        return shared.named(pairs, relation, "key").select("source", "target", "key")
    members = key_members(with_row_order(evidence), KEY_COLUMNS[relation]).select("key", "entity_id")
    counts = members.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    pairs = edges.select("source", "target").distinct()
    sized = pairs.join(
        counts.select(F.col("entity_id").alias("source"), F.col("n").alias("ns")), "source"
    ).join(counts.select(F.col("entity_id").alias("target"), F.col("n").alias("nt")), "target")
    small_first = F.col("ns") <= F.col("nt")
    probe = sized.select(
        "source",
        "target",
        F.when(small_first, F.col("source")).otherwise(F.col("target")).alias("lo"),
        F.when(small_first, F.col("target")).otherwise(F.col("source")).alias("hi"),
    )
    lo = members.select(F.col("entity_id").alias("lo"), "key")
    hi = members.select(F.col("entity_id").alias("hi"), "key")
    return (
        probe.join(lo, "lo")
        .join(hi, ["hi", "key"], "left_semi")
        .groupBy("source", "target")
        .agg(F.min("key").alias("key"))
    )


def _edges_with_keys(shared: SharedKeys) -> DataFrame:
    """Edges with the least shared key of either kind of their two ends."""
    pairs = shared.named(shared.pairs(least=True), SHARED_REFERENCE, "shared_url")
    pairs = shared.named(pairs, SHARED_CONTENT, "shared_hash")
    return pairs.select("source", "target", "shared_url", "shared_hash", F.inline(_kinds(shared))).where("weight > 0")


def explain_edges(edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """Edges with a long and a short text saying what they rest on."""
    shared = counted_in(edges, evidence)
    if shared is not None and set(shared.relations) == set(KEY_COLUMNS):
        joined = _edges_with_keys(shared)
    else:
        url = shared_keys_of(edges, evidence, SHARED_REFERENCE).withColumnRenamed("key", "shared_url")
        content = shared_keys_of(edges, evidence, SHARED_CONTENT).withColumnRenamed("key", "shared_hash")
        on = ["source", "target"]
        joined = edges.join(url, on, "left").join(content, on, "left")
    percent = text.percent_text(F.col("weight"))
    host = text.url_host(F.col("shared_url"))
    head = text.hash_prefix(F.col("shared_hash"))
    semantic = F.col("relation_type") == SEMANTIC
    long_text = (
        F.when(semantic, F.concat(F.lit("Vínculo Semántico\n(Simil: "), percent, F.lit(")")))
        .when(F.col("shared_url").isNotNull(), F.concat(F.lit("Ref. Compartida\n("), host, F.lit(")")))
        .when(
            F.col("shared_hash").isNotNull(),
            F.concat(F.lit("Contenido Compartido\n(Hash: "), head, F.lit(")")),
        )
        .otherwise(F.concat(F.lit("Enlace Físico ("), F.col("relation_type"), F.lit(")")))
    )
    short_text = (
        F.when(semantic, percent)
        .when(F.col("shared_url").isNotNull(), F.concat(F.lit("Ref: "), host))
        .when(F.col("shared_hash").isNotNull(), F.concat(F.lit("Hash: "), head))
        .otherwise("Físico")
    )
    return joined.select(
        *[c for c in edges.columns],
        long_text.alias("explanation"),
        short_text.alias("short_label"),
    )
