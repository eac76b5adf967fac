"""End-to-end workflows: one stage per function, tables in between.

A stage reads DataFrames and writes its result under the run folder, so a lost
executor or a restarted driver repeats one stage at most.  ``train`` fits and
registers models, ``use`` loads them and fails when one is missing.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml.clustering import KMeansModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions.vectors import feature_array
from riskweave.operators import (
    catalog,
    chains,
    clustering,
    communities,
    consolidate,
    cycles,
    density,
    detectors,
    edges,
    ego,
    evidence,
    metrics,
    narrative,
    profiles,
    similarity,
    supervised,
)
from riskweave.operators.scaling import DETECTOR_FEATURES, Scaler
from riskweave.session import materialise
from riskweave.sources import tables
from riskweave.sources.registry import RunContext, cached_vectors, require_models

KMEANS, PROJECTION, TEXT_FOREST, VOCABULARY = "kmeans", "pca", "iso_forest_embeddings", "vocabulary"
SCALER = "scaler"
DETECTOR_MODELS = {
    "IsolationForest": "isolation_forest",
    "OneClassSVM": "one_class_svm",
    "LocalOutlierFactor": "local_outlier_factor",
    "EllipticEnvelope": "elliptic_envelope",
    "KNNOutlierDetector": "knn_outlier_detector",
}
SUPERVISED = "supervised_classifier"


@dataclass
class Results:
    """Tables of a run by name."""

    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


def prepare(spark: SparkSession, ctx: RunContext, raw_root: str) -> Results:
    """Load, catalog, consolidate and link."""
    sources, ev, match = tables.load_raw(spark, raw_root, ctx.mode)
    # The raw CSV is parsed once; later steps read columns.
    sources, ev, match = (materialise(t, "raw") for t in (sources, ev, match))
    cat = catalog.entity_catalog(sources, ev, match)
    return Results(
        {
            "source_results": sources,
            "match_summary": match,
            "consolidated_entities": ctx.write(
                consolidate.consolidate_catalog(cat, sources, ev, match), "consolidated_entities"
            ),
            "entity_edges": ctx.write(edges.physical_edges(ev), "entity_edges"),
            "processed_evidence_items": ctx.write(
                consolidate.processed_evidence(ev), "processed_evidence_items"
            ),
        }
    )


def aggregate(ctx: RunContext, sources: DataFrame, ev: DataFrame, match: DataFrame) -> DataFrame:
    """Full-outer consolidation over every id, as Parquet."""
    return ctx.write(consolidate.consolidate_full_outer(sources, ev, match), "pyspark_entities")


def _vectors(spark, ctx: RunContext, texts: DataFrame, encoder) -> tuple[DataFrame, int | None]:
    """Unit vectors of the profile texts: the caller's encoder, else TF-IDF."""
    if encoder is not None:
        found = cached_vectors(
            spark,
            texts,
            ctx.table("entity_embeddings"),
            lambda missing: similarity.encode_texts(missing, encoder),
            "entity_id",
            "entity_profile_text",
        )
        return found, None
    if ctx.mode == "train":
        vectors, vocabulary = similarity.tfidf_vectors(texts, "entity_id", "entity_profile_text")
        vocabulary.write.mode("overwrite").parquet(ctx.model(VOCABULARY))
    else:
        require_models(spark, ctx, [VOCABULARY])
        vocabulary = spark.read.parquet(ctx.model(VOCABULARY))
        vectors, _ = similarity.tfidf_vectors(texts, "entity_id", "entity_profile_text", vocabulary)
    return vectors, vocabulary.count()


def cluster_entities(
    spark: SparkSession,
    ctx: RunContext,
    consolidated: DataFrame,
    ev: DataFrame,
    links: DataFrame,
    encoder: Callable | None = None,
    chosen: list[str] | None = None,
) -> Results:
    """Text profiles, clusters, text outliers, projection and semantic links."""
    profiled = materialise(profiles.profile_text(consolidated, ev), "profiles")
    vectors, width = _vectors(spark, ctx, profiled, encoder)
    vectors = materialise(vectors, "vectors")
    points = clustering.ml_points(vectors, width)
    n = points.count()
    if ctx.mode == "train":
        kmeans = clustering.best_kmeans(points, clustering.cluster_count(n))
        kmeans.write().overwrite().save(ctx.model(KMEANS))
        projection = clustering.Projection.fit(points, 2)
        projection.save(spark, ctx.model(PROJECTION))
        dense = materialise(clustering.dense_arrays(points), "dense")
        forest = detectors.IsolationForest.fit(dense, contamination="auto")
        forest.save(spark, ctx.model(TEXT_FOREST))
    else:
        require_models(spark, ctx, [KMEANS, PROJECTION, TEXT_FOREST])
        kmeans = KMeansModel.load(ctx.model(KMEANS))
        projection = clustering.Projection.load(spark, ctx.model(PROJECTION))
        forest = detectors.IsolationForest.load(spark, ctx.model(TEXT_FOREST))
        dense = materialise(clustering.dense_arrays(points), "dense")
    table, labels = clustering.compare_algorithms(points, chosen)
    smallest = min(10, max(2, n // 3))
    grouped = labels.get("HDBSCAN")
    if grouped is None:
        grouped = density.density_clusters(
            clustering.dense_arrays(points), smallest, min(5, max(1, smallest // 2))
        )
    outliers = forest.transform(dense).toDF("id", "anomaly_score_embedding", "is_embedding_outlier")
    near = clustering.with_centroid_distance(kmeans, points).toDF("id", "kmeans_cluster", "distance_to_centroid")
    flat = projection.transform(points).select(
        "id", F.get("coords", F.lit(0)).alias("pca_x"), F.get("coords", F.lit(1)).alias("pca_y")
    )
    out = profiled
    for part in (outliers, near, grouped.toDF("id", "hdbscan_cluster"), flat):
        out = out.join(part.withColumnRenamed("id", "entity_id"), "entity_id", "left")
    out = out.withColumns(
        {
            "predominant_cluster": F.col("kmeans_cluster"),
            "kmeans_cluster_theme": clustering.cluster_theme(F.col("kmeans_cluster")),
        }
    )
    semantic = ctx.write(similarity.semantic_links(vectors, profiled), "hidden_entity_links")
    return Results(
        {
            "clustered_entities": ctx.write(out, "clustered_entities"),
            "hidden_entity_links": semantic,
            "entity_edges": ctx.write(edges.merge_semantic(links, semantic), "merged_edges"),
            "clustering_metrics": ctx.write(table, "clustering_metrics"),
        }
    )


def detect_outliers(spark: SparkSession, ctx: RunContext, entities: DataFrame) -> Results:
    """Five detectors: flags, scores and one metrics row each."""
    if ctx.mode == "train":
        scaler = Scaler.fit(entities)
        scaler.save(spark, ctx.model(SCALER))
    else:
        require_models(spark, ctx, [SCALER, *DETECTOR_MODELS.values()])
        scaler = Scaler.load(spark, ctx.model(SCALER))
    points = materialise(scaler.transform(entities), "points")
    labelled = consolidate.LABEL in entities.columns
    out, rows = entities, []
    for name, kind in detectors.DETECTORS.items():
        t0 = time.time()
        if ctx.mode == "train":
            model, scored = kind.fit_transform(points)
            model.save(spark, ctx.model(DETECTOR_MODELS[name]))
            spent = time.time() - t0
        else:
            model = kind.load(spark, ctx.model(DETECTOR_MODELS[name]))
            scored, spent = model.transform(points), None
        found = materialise(scored, "found")
        spent = time.time() - t0 if spent is None else spent
        if name == "IsolationForest":
            model.save(spark, ctx.audit_copy("best_anomaly_model"))
        low = name.lower()
        out = out.join(
            found.select(
                F.col("id").alias("entity_id"),
                F.col("flag").alias(f"anomaly_{low}"),
                F.col("score").alias(f"anomaly_score_{low}"),
            ),
            "entity_id",
            "left",
        )
        flags = points.join(found.select("id", F.col("flag").alias("label")), "id")
        sil, far = metrics.separability(materialise(flags, "flags"))
        count = found.agg(F.sum("flag")).first()[0] or 0
        row = [name, count, float(sil or 0.0), float(far)]
        if labelled:
            judged = materialise(
                found.join(
                    entities.select(F.col("entity_id").alias("id"), F.col(consolidate.LABEL).alias("truth")), "id"
                ),
                "judged",
            )
            area = metrics.curve_areas(judged).first()
            f1 = metrics.f1_table(judged, guess="flag").first()["f1"]
            row += [area["pr_auc"], f1, area["roc_auc"]]
        rows.append(tuple([*row, spent]))
    schema = "Algoritmo string, Num_Anomalias_Detectadas long, Silhouette_Score double, Distancia_Media_Outliers double"
    if labelled:
        schema += ", `PR-AUC` double, `F1-Score` double, `ROC-AUC` double"
    table = spark.createDataFrame(rows, schema + ", Tiempo_Ejecucion_Segs double")
    return Results(
        {
            "scored_entities": ctx.write(out, "scored_entities"),
            "anomaly_metrics": ctx.write(table, "anomaly_metrics"),
        }
    )


def analyse_graph(ctx: RunContext, entities: DataFrame, links: DataFrame) -> Results:
    enriched, summary = communities.graph_analysis(entities, links)
    return Results(
        {
            "graph_enriched_entities": ctx.write(enriched, "graph_enriched_entities"),
            "graph_communities": ctx.write(summary, "graph_communities"),
        }
    )


def find_chains(
    ctx: RunContext, entities: DataFrame, links: DataFrame, focus: DataFrame | None = None
) -> Results:
    """Chains and loops over the noise-free graph.

    Loops are those of a cycle basis: with semantic links the graph is dense, and its
    simple cycles (``cycles.short_cycles``) grow with the fifth power of a clique.
    """
    nodes = chains.outlier_flag(entities)
    quiet = materialise(edges.drop_noise(links), "quiet")
    wanted = focus if focus is not None and focus.limit(1).count() else None
    found = chains.suspicious_chains(nodes, quiet, focus=wanted)
    if wanted is not None:
        found = chains.focus_chains(found, wanted)
    loops = cycles.describe_cycles(cycles.fundamental_cycles(quiet), nodes)
    return Results(
        {
            "suspicious_chains": ctx.write(found, "suspicious_chains"),
            "suspicious_loops": ctx.write(loops, "suspicious_loops"),
        }
    )


def report_tables(
    spark: SparkSession,
    ctx: RunContext,
    entities: DataFrame,
    links: DataFrame,
    summary: DataFrame,
    found: Results,
    ev: DataFrame,
    focus: DataFrame | None = None,
    classifiers: list[str] | None = None,
) -> Results:
    """Tables behind the report: models, topology, leading chains, egos, texts."""
    out: dict[str, DataFrame] = {}
    if consolidate.LABEL in entities.columns:
        points = entities.select(
            F.col("entity_id").alias("id"),
            feature_array(DETECTOR_FEATURES).alias("vec"),
            F.coalesce(F.col(consolidate.LABEL).cast("int"), F.lit(0)).alias("label"),
        )
        table, models = supervised.compare_models(materialise(points, "labelled"), classifiers)
        best = supervised.best_model(table)
        if best:
            models[best].save(spark, ctx.model(SUPERVISED))
        out["supervised_metrics"] = ctx.write(table, "supervised_metrics")
    out["topology"] = ctx.write(edges.topology_stats(entities, links, summary), "topology")
    out["top_communities"] = ctx.write(communities.ordered_communities(summary).limit(5), "top_communities")
    out["top_chains"] = ctx.write(chains.top_chains(found["suspicious_chains"]), "top_chains")
    out["top_loops"] = ctx.write(cycles.ordered_cycles(found["suspicious_loops"]).limit(5), "top_loops")
    centres = materialise(ego.priority_entities(entities, edges.edge_ends(links), focus), "centres")
    egos = materialise(ego.ego_network(links, centres), "egos")
    out["ego_networks"] = ctx.write(egos, "ego_networks")
    shown = edges.inside_catalog(links, entities).join(
        egos.select(F.least("entity_id", "neighbour_id").alias("source"), F.greatest("entity_id", "neighbour_id").alias("target")).distinct(),
        ["source", "target"],
        "left_semi",
    )
    out["edge_explanations"] = ctx.write(edges.explain_edges(shown, ev), "edge_explanations")
    nodes = chains.outlier_flag(entities).withColumn("is_blacklist", F.lit(False))
    drawn = egos.select(F.explode(F.array("entity_id", "neighbour_id")).alias("entity_id")).distinct()
    nodes = nodes.join(drawn, "entity_id", "left_semi")
    seen = ev.join(drawn, "entity_id", "left_semi")
    out["node_labels"] = ctx.write(
        evidence.node_labels(nodes, evidence.evidence_details(seen), centres), "node_labels"
    )
    out["narratives"] = ctx.write(narrative.narratives(entities), "narratives")
    return Results(out)


def run(
    spark: SparkSession,
    raw_root: str,
    out_root: str,
    mode: str = "use",
    run_id: str | None = None,
    encoder: Callable | None = None,
    algorithms: list[str] | None = None,
    classifiers: list[str] | None = None,
) -> tuple[RunContext, Results]:
    """Every stage in order, for ``train`` or ``use``."""
    ctx = RunContext.start(out_root, mode, run_id)
    focus = tables.read_focus(spark, raw_root)
    all_tables: dict[str, DataFrame] = {}
    base = prepare(spark, ctx, raw_root)
    ev = base["processed_evidence_items"]
    all_tables |= base.tables
    all_tables["pyspark_entities"] = aggregate(ctx, base["source_results"], ev, base["match_summary"])
    clustered = cluster_entities(
        spark, ctx, base["consolidated_entities"], ev, base["entity_edges"], encoder, algorithms
    )
    all_tables |= clustered.tables
    scored = detect_outliers(spark, ctx, clustered["clustered_entities"])
    all_tables |= scored.tables
    links = clustered["entity_edges"]
    graph = analyse_graph(ctx, scored["scored_entities"], links)
    all_tables |= graph.tables
    nodes = graph["graph_enriched_entities"]
    found = find_chains(ctx, nodes, links, focus)
    all_tables |= found.tables
    report = report_tables(
        spark, ctx, nodes, links, graph["graph_communities"], found, ev, focus, classifiers
    )
    all_tables |= report.tables
    return ctx, Results(all_tables)


def train(spark: SparkSession, raw_root: str, out_root: str, **kw) -> tuple[RunContext, Results]:
    return run(spark, raw_root, out_root, "train", **kw)


def use(spark: SparkSession, raw_root: str, out_root: str, **kw) -> tuple[RunContext, Results]:
    return run(spark, raw_root, out_root, "use", **kw)
