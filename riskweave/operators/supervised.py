"""Supervised scoring from analyst labels: nine models, compared and registered."""

from __future__ import annotations

import json
import math
import time
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import (
    DecisionTreeClassificationModel,
    DecisionTreeClassifier,
    GBTClassificationModel,
    GBTClassifier,
    LinearSVC,
    LinearSVCModel,
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.functions.stats import value_at_rank
from riskweave.operators import metrics
from riskweave.operators.detectors import OneClassSVM, _fourier, scale_gamma, take_copies
from riskweave.operators.metric import nearest
from riskweave.session import materialise

SEED = 42
TRAIN_SHARE = 0.7
FOLDS = 5
NEIGHBOURS = 5
FOURIER_FEATURES = 256
ML_MODELS = {
    "lr": LogisticRegressionModel,
    "tree": DecisionTreeClassificationModel,
    "rf": RandomForestClassificationModel,
    "gb": GBTClassificationModel,
    "svc": LinearSVCModel,
    "final": LogisticRegressionModel,
}


def stratified_split(
    df: DataFrame, label: str, id_col: str, share: float = TRAIN_SHARE, order: Column | None = None
) -> DataFrame:
    """Add ``is_train``: the first ``share`` of each label by a hash of the id.

    The cut of each label is an order statistic of the hash, found by histogram,
    so no label's rows are sorted or gathered.  ``order`` replaces the hash and
    must be unique within a label.  Rows without a label get no mark: they are in neither part.
    """
    ticket = order if order is not None else F.pmod(F.xxhash64(F.col(id_col), F.lit(SEED)), F.lit(1 << 52))
    marked = df.withColumn("_t", ticket.cast("double"))
    counts = {r[label]: r["n"] for r in marked.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    inside = F.lit(False)
    for value, n in counts.items():
        if value is None:
            continue
        keep = int(math.floor(share * n + 1e-9))
        if keep:
            cut = value_at_rank(marked.where(F.col(label) == value), "_t", keep - 1)
            inside = inside | ((F.col(label) == value) & (F.col("_t") <= F.lit(cut)))
    return marked.withColumn("is_train", inside).drop("_t")


@dataclass
class Classifier:
    """A fitted model: Spark ML parts, optional tables, and plain parameters."""

    kind: str
    models: dict = field(default_factory=dict)
    tables: dict = field(default_factory=dict)
    state: dict = field(default_factory=dict)

    def score(self, points: DataFrame) -> DataFrame:
        """``(id, prob, guess)`` for ``points(id, vec)``."""
        prob = _SCORERS[self.kind](self, points)
        return prob.select("id", "prob", (F.col("prob") > 0.5).cast("int").alias("guess"))

    def save(self, spark: SparkSession, path: str) -> None:
        state = {"kind": self.kind, "models": list(self.models), "tables": list(self.tables), **self.state}
        spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode(
            "overwrite"
        ).parquet(f"{path}/state")
        for name, model in self.models.items():
            model.write().overwrite().save(f"{path}/{name}")
        for name, table in self.tables.items():
            table.write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Classifier:
        state = json.loads(spark.read.parquet(f"{path}/state").first()["state"])
        kind, names, tables = (state.pop(k) for k in ("kind", "models", "tables"))
        return cls(
            kind,
            {n: ML_MODELS[n].load(f"{path}/{n}") for n in names},
            {n: spark.read.parquet(f"{path}/{n}") for n in tables},
            state,
        )


def _features(points: DataFrame) -> DataFrame:
    keep = [c for c in ("label", "fold") if c in points.columns]
    return points.select("id", array_to_vector(F.col("vec").cast("array<double>")).alias("features"), *keep)


def _probability(model, featured: DataFrame) -> DataFrame:
    return model.transform(featured).select(
        "id", F.get(vector_to_array("probability"), F.lit(1)).alias("prob")
    )


def _single(name: str):
    return lambda c, points: _probability(c.models[name], _features(points))


def _dummy(c: Classifier, points: DataFrame) -> DataFrame:
    draw = F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1_000_000)) / 1_000_000.0
    return points.select("id", (draw < c.state["prior"]).cast("double").alias("prob"))


def _both(c: Classifier, points: DataFrame) -> DataFrame:
    featured = _features(points)
    rf = _probability(c.models["rf"], featured).withColumnRenamed("prob", "p_rf")
    return rf.join(_probability(c.models["gb"], featured).withColumnRenamed("prob", "p_gb"), "id")


def _stacked(c: Classifier, points: DataFrame) -> DataFrame:
    joint = _both(c, points).select("id", array_to_vector(F.array("p_rf", "p_gb")).alias("features"))
    return _probability(c.models["final"], joint)


def _voted(c: Classifier, points: DataFrame) -> DataFrame:
    lr = _probability(c.models["lr"], _features(points))
    return _both(c, points).join(lr, "id").select(
        "id", ((F.col("p_rf") + F.col("p_gb") + F.col("prob")) / 3.0).alias("prob")
    )


def _fourier_points(points: DataFrame, state: dict) -> DataFrame:
    directions, shifts = OneClassSVM.fourier_map(state["width"], FOURIER_FEATURES, state["gamma"], SEED)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def lift(vecs: pd.Series) -> pd.Series:
        if not len(vecs):
            return pd.Series([], dtype="object")
        return pd.Series(list(_fourier(np.stack(vecs.to_numpy()).astype(np.float64), directions, shifts)))

    keep = [c for c in ("label",) if c in points.columns]
    return points.select("id", array_to_vector(lift("vec")).alias("features"), *keep)


def _margin(model: LinearSVCModel, featured: DataFrame) -> DataFrame:
    margin = F.get(vector_to_array("rawPrediction"), F.lit(1))
    keep = [c for c in ("label",) if c in featured.columns]
    return model.transform(featured).select("id", array_to_vector(F.array(margin)).alias("features"), *keep)


def _kernel(c: Classifier, points: DataFrame) -> DataFrame:
    return _probability(c.models["final"], _margin(c.models["svc"], _fourier_points(points, c.state)))


def _neighbours(c: Classifier, points: DataFrame) -> DataFrame:
    """Share of positives among the nearest training rows."""
    train = c.tables["train"]
    places = points.groupBy("vec").agg(F.min("id").alias("id"))
    found = take_copies(nearest(places, train.select("id", "vec", "copies"), c.state["k"]), c.state["k"])
    votes = (
        found.join(train.select(F.col("id").alias("neighbour_id"), "share"), "neighbour_id")
        .groupBy("id")
        .agg((F.sum(F.col("share") * F.col("taken")) / F.sum("taken")).alias("prob"))
    )
    return points.join(places.join(votes, "id").select("vec", "prob"), "vec").select("id", "prob")


_SCORERS = {
    "dummy": _dummy,
    "lr": _single("lr"),
    "tree": _single("tree"),
    "rf": _single("rf"),
    "gb": _single("gb"),
    "svm": _kernel,
    "knn": _neighbours,
    "stacking": _stacked,
    "voting": _voted,
}


def _forest() -> RandomForestClassifier:
    # full-grown trees as far as Spark allows: 30 levels
    return RandomForestClassifier(numTrees=100, maxDepth=30, seed=SEED)


def _boosted() -> GBTClassifier:
    return GBTClassifier(maxIter=100, maxDepth=3, stepSize=0.1, seed=SEED)


def _logistic(n: int) -> LogisticRegression:
    return LogisticRegression(maxIter=1000, regParam=1.0 / max(n, 1), standardization=False)


def fit_all(train: DataFrame, chosen: list[str] | None = None) -> dict[str, tuple[Classifier, float]]:
    """Fit the nine models on ``train(id, vec, label)``; name -> (model, seconds).

    The ensembles reuse the forest, the boosted trees and the logistic model
    already fitted on the same rows; only the stacking folds are extra fits, and
    they run side by side.
    """
    data = materialise(
        train.withColumn("fold", F.pmod(F.xxhash64("id", F.lit(SEED + 1)), F.lit(FOLDS))), "labelled"
    )
    featured = _features(data).persist()
    n = featured.count()
    out: dict[str, tuple[Classifier, float]] = {}
    spent: dict[str, float] = {}
    parts: dict = {}

    def part(name: str, estimator):
        if name not in parts:
            t0 = time.time()
            parts[name] = estimator.fit(featured)
            spent[name] = time.time() - t0
        return parts[name]

    def add(name: str, build, *reused: str) -> None:
        if chosen and name not in chosen:
            return
        t0 = time.time()
        before = set(spent)
        model = build()
        # A reused part counts towards every model that contains it.
        out[name] = (model, time.time() - t0 + sum(spent[r] for r in reused if r in before))

    prior = data.agg(F.avg(F.col("label").cast("double"))).first()[0] or 0.0
    add("baseline_0_dummy", lambda: Classifier("dummy", state={"prior": prior}))
    add("baseline_1_logreg", lambda: Classifier("lr", {"lr": part("lr", _logistic(n))}))
    add(
        "baseline_2_tree",
        lambda: Classifier("tree", {"tree": part("tree", DecisionTreeClassifier(maxDepth=5, seed=SEED))}),
    )
    add("baseline_3_rf", lambda: Classifier("rf", {"rf": part("rf", _forest())}))
    add("baseline_4_gb", lambda: Classifier("gb", {"gb": part("gb", _boosted())}))

    def kernel() -> Classifier:
        state = {"gamma": scale_gamma(data), "width": len(data.first()["vec"])}
        lifted = _fourier_points(data, state).persist()
        svc = LinearSVC(regParam=1.0 / max(n, 1), standardization=False).fit(lifted)
        platt = LogisticRegression(maxIter=100).fit(_margin(svc, lifted))
        lifted.unpersist()
        return Classifier("svm", {"svc": svc, "final": platt}, state=state)

    add("baseline_5_svm", kernel)

    def neighbours() -> Classifier:
        places = data.groupBy("vec").agg(
            F.min("id").alias("id"),
            F.count(F.lit(1)).alias("copies"),
            F.avg(F.col("label").cast("double")).alias("share"),
        )
        return Classifier("knn", tables={"train": materialise(places, "knn")}, state={"k": NEIGHBOURS})

    add("baseline_6_knn", neighbours)

    def stacking() -> Classifier:
        rf, gb = part("rf", _forest()), part("gb", _boosted())

        def fold(i: int) -> DataFrame:
            rest, held = featured.where(F.col("fold") != i), featured.where(F.col("fold") == i)
            a = _probability(_forest().fit(rest), held).withColumnRenamed("prob", "p_rf")
            b = _probability(_boosted().fit(rest), held).withColumnRenamed("prob", "p_gb")
            return materialise(a.join(b, "id"), "fold")

        with ThreadPool(FOLDS) as pool:
            held = pool.map(inheritable_thread_target(fold), range(FOLDS))
        joint = held[0]
        for h in held[1:]:
            joint = joint.unionByName(h)
        level = joint.join(data.select("id", "label"), "id").select(
            "label", array_to_vector(F.array("p_rf", "p_gb")).alias("features")
        )
        return Classifier("stacking", {"rf": rf, "gb": gb, "final": _logistic(n).fit(level)})

    add("ensemble_stacking", stacking, "rf", "gb")
    add(
        "ensemble_voting",
        lambda: Classifier(
            "voting",
            {"rf": part("rf", _forest()), "gb": part("gb", _boosted()), "lr": part("lr", _logistic(n))},
        ),
        "rf", "gb", "lr",
    )
    featured.unpersist()
    return out


METRIC_SCHEMA = "Modelo string, `PR-AUC` double, `F1-Score` double, `ROC-AUC` double, Tiempo_Segs double"


def compare_models(
    points: DataFrame, chosen: list[str] | None = None
) -> tuple[DataFrame, dict[str, Classifier]]:
    """Metrics per model on the held-out rows of ``points(id, vec, label)``.

    With one class only there is nothing to learn: the table stays empty.
    """
    spark = points.sparkSession
    empty = spark.createDataFrame([], METRIC_SCHEMA)
    if not metrics.has_two_classes(points, "label"):
        return empty, {}
    split = materialise(stratified_split(points, "label", "id"), "split")
    train, test = split.where("is_train").drop("is_train"), split.where("NOT is_train").drop("is_train")
    if not metrics.has_two_classes(train, "label"):
        return empty, {}
    rows, models = [], {}
    for name, (model, seconds) in fit_all(train, chosen).items():
        t0 = time.time()
        scored = materialise(
            model.score(test.select("id", "vec")).join(test.select("id", F.col("label").alias("truth")), "id"), "scored"
        )
        seconds += time.time() - t0
        f1 = metrics.f1_table(scored).first()["f1"]
        area = metrics.curve_areas(scored, score="prob").first()
        rows.append((name, area["pr_auc"], f1, area["roc_auc"], seconds))
        models[name] = model
    return spark.createDataFrame(rows, METRIC_SCHEMA), models


def best_model(table: DataFrame) -> str | None:
    """Name of the model with the highest F1; the first listed wins a tie."""
    row = table.orderBy(F.desc("`F1-Score`"), "Modelo").first()
    return row["Modelo"] if row else None


def feature_importance(model: Classifier, names: list[str]) -> list[tuple[str, float]]:
    """Importances of a forest, largest first."""
    values = model.models["rf"].featureImportances.toArray()
    return sorted(zip(names, (float(v) for v in values)), key=lambda p: -p[1])
