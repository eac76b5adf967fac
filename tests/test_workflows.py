from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from riskweave.plans import roles, workflows
from riskweave.sources.registry import RunContext, require_models

from conftest import SMALL

ALGORITHMS = ["K-Means", "HDBSCAN"]
CLASSIFIERS = ["baseline_0_dummy", "baseline_2_tree"]


@pytest.fixture(scope="module")
def raw_dir(spark, tmp_path_factory):
    """The three raw CSV files, written from the derived input tables."""
    root = tmp_path_factory.mktemp("raw")
    names = ("entity_source_results", "evidence_items", "entity_match_summary")
    for name, df in zip(names, roles.raw(spark, SMALL)):
        df.orderBy("ord").drop("ord").toPandas().to_csv(root / f"{name}.csv", index=False)
    return str(root)


@pytest.fixture(scope="module")
def trained(spark, raw_dir, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    ctx, found = workflows.train(spark, raw_dir, out, run_id="r1", algorithms=ALGORITHMS, classifiers=CLASSIFIERS)
    return out, ctx, found


def test_train_writes_every_table(spark, trained, raw_dir):
    _, ctx, found = trained
    n = found["consolidated_entities"].count()
    assert n > 40
    for name in ("clustered_entities", "scored_entities", "graph_enriched_entities", "narratives"):
        assert found[name].count() == n, name
    nodes = found["graph_enriched_entities"]
    assert {"pagerank", "degree", "community_id", "gnn_feature_3", "kmeans_cluster_theme", "pca_y", "hdbscan_cluster",
            "anomaly_score_ellipticenvelope", "is_embedding_outlier", "distance_to_centroid"} <= set(nodes.columns)
    assert nodes.where("pagerank IS NULL OR community_id < 0").count() == 0
    assert found["anomaly_metrics"].count() == 5
    assert found["clustering_metrics"].where("Num_Clusters > 0").count() == len(ALGORITHMS)
    assert found["topology"].count() == 6
    assert spark.read.parquet(ctx.table("pyspark_entities")).count() == found["pyspark_entities"].count()
    sources, evidence, match = roles.raw(spark, SMALL)
    from riskweave.operators import catalog

    assert n == catalog.entity_catalog(sources, evidence, match).count()


def test_merged_edges_hold_semantic_links(trained):
    _, _, found = trained
    kinds = {r[0] for r in found["entity_edges"].select("relation_type").distinct().collect()}
    assert "semantic_similarity" in kinds and "shared_reference" in kinds
    assert found["hidden_entity_links"].agg(F.min("weight")).first()[0] >= 0.70


def test_use_repeats_train_on_the_same_batch(spark, trained):
    out, _, first = trained
    ctx = RunContext.start(out, "use", "r2")
    assert ctx.run_dir.endswith("mode=use/run_id=r2")
    second = workflows.detect_outliers(spark, ctx, first["clustered_entities"])
    cols = ["entity_id", "anomaly_isolationforest", "anomaly_knnoutlierdetector", "anomaly_localoutlierfactor",
            "anomaly_oneclasssvm", "anomaly_ellipticenvelope"]
    a = first["scored_entities"].select(cols)
    assert a.exceptAll(second["scored_entities"].select(cols)).count() == 0


def test_use_without_models_fails(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        require_models(spark, RunContext.start(str(tmp_path), "use"), ["kmeans"])
    with pytest.raises(ValueError):
        RunContext.start(str(tmp_path), "other")
