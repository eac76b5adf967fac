"""Outlier detectors with a fit/score split.

A detector is fitted on ``points(id, vec)`` and scores other points in the same
form; higher scores are worse.  What a fitted model keeps is either bounded (a
forest, a projection, a covariance) or a table of training points on disk.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.functions.stats import exact_quantile, order_statistic
from riskweave.operators.metric import TIE_DIGITS, distinct_points, nearest
from riskweave.session import materialise

CONTAMINATION = 0.05
SEED = 42
# Relative duality gap at which the one-class machine is solved.
GAP = 1e-3


def _write_state(spark: SparkSession, path: str, state: dict) -> None:
    spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode(
        "overwrite"
    ).parquet(f"{path}/state")


def _read_state(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.parquet(f"{path}/state").first()["state"])


class Detector:
    """Common shape: ``scores`` plus a threshold gives flags."""

    name = "detector"
    strict = True
    threshold: float

    def scores(self, points: DataFrame) -> DataFrame:
        """``(id, score)``."""
        raise NotImplementedError

    def flag(self, score: Column) -> Column:
        hit = score > F.lit(self.threshold) if self.strict else score >= F.lit(self.threshold)
        return hit.cast("int")

    def transform(self, points: DataFrame) -> DataFrame:
        """``(id, score, flag)``."""
        return self._flagged(self.scores(points))

    def _flagged(self, scored: DataFrame) -> DataFrame:
        return scored.withColumn("flag", self.flag(F.col("score")))

    @classmethod
    def fit_transform(cls, points: DataFrame, **options) -> tuple[Detector, DataFrame]:
        """The fitted model and what it says of its own training points, scored once."""
        model, scored = cls._fitted(points, **options)
        return model, model._flagged(scored if scored is not None else model.scores(points))

    @classmethod
    def _fitted(cls, points: DataFrame, **options) -> tuple[Detector, DataFrame | None]:
        """The model and, where fitting computes them anyway, the scores of ``points``."""
        return cls.fit(points, **options), None


# --- isolation forest -----------------------------------------------------------


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of ``n`` rows."""
    n = np.asarray(n, dtype=np.float64)
    safe = np.maximum(n, 3.0)
    long = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, long))


_TREE = T.StructType(
    [
        T.StructField("tree", T.IntegerType()),
        T.StructField("feature", T.ArrayType(T.IntegerType())),
        T.StructField("cut", T.ArrayType(T.DoubleType())),
        T.StructField("left", T.ArrayType(T.IntegerType())),
        T.StructField("right", T.ArrayType(T.IntegerType())),
        T.StructField("depth", T.ArrayType(T.DoubleType())),
    ]
)


def _grow(tree: int, x: np.ndarray, limit: int, seed: int) -> dict:
    """Random axis cuts down to single rows or the depth limit."""
    rng = np.random.default_rng([seed, tree])
    feature, cut, left, right, depth = [], [], [], [], []

    def node(rows: np.ndarray, level: int) -> int:
        at = len(feature)
        feature.append(-1)
        cut.append(0.0)
        left.append(-1)
        right.append(-1)
        depth.append(level + float(average_path(len(rows))))
        if level >= limit or len(rows) <= 1:
            return at
        lo, hi = x[rows].min(0), x[rows].max(0)
        open_axes = np.flatnonzero(hi > lo)
        if not len(open_axes):
            return at
        axis = int(rng.choice(open_axes))
        where = float(rng.uniform(lo[axis], hi[axis]))
        below = x[rows, axis] <= where
        feature[at], cut[at] = axis, where
        left[at] = node(rows[below], level + 1)
        right[at] = node(rows[~below], level + 1)
        return at

    node(np.arange(len(x)), 0)
    return {"tree": tree, "feature": feature, "cut": cut, "left": left, "right": right, "depth": depth}


class IsolationForest(Detector):
    """Isolation forest; trees grow in parallel from small hash samples."""

    name = "isolationforest"

    def __init__(self, trees: list[dict], sample_rows: int, threshold: float):
        self.trees, self.sample_rows, self.threshold = trees, sample_rows, threshold

    @classmethod
    def fit(cls, points: DataFrame, **options) -> IsolationForest:
        return cls._fitted(points, **options)[0]

    @classmethod
    def _fitted(
        cls,
        points: DataFrame,
        contamination: float | str = CONTAMINATION,
        tree_count: int = 100,
        max_samples: int = 256,
        seed: int = SEED,
    ) -> tuple[IsolationForest, DataFrame | None]:
        n = points.count()
        psi = max(1, min(max_samples, n))
        limit = int(math.ceil(math.log2(max(psi, 2))))
        # Oversample by hash, then keep psi rows per tree: a tree's group never
        # exceeds a few hundred rows whatever the size of the table.
        share = min(1.0, 3.0 * psi / max(n, 1))
        span = 1 << 30
        ticket = lambda t: F.pmod(F.xxhash64(F.col("id"), t, F.lit(seed)), F.lit(span))
        picked = F.filter(
            F.sequence(F.lit(0), F.lit(tree_count - 1)), lambda t: ticket(t) < F.lit(int(share * span) if share < 1 else span)
        )
        drawn = points.select("id", "vec", F.explode(picked).alias("tree"))
        first = Window.partitionBy("tree").orderBy(
            F.xxhash64(F.col("id"), F.col("tree"), F.lit(seed)), "id"
        )
        sample = drawn.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= psi).drop("_r")

        def grow(pdf: pd.DataFrame) -> pd.DataFrame:
            x = np.stack(pdf.sort_values("id")["vec"].to_numpy()).astype(np.float64)
            return pd.DataFrame([_grow(int(pdf["tree"].iloc[0]), x, limit, seed)])

        rows = sample.groupBy("tree").applyInPandas(grow, _TREE).orderBy("tree").collect()
        model = cls([r.asDict() for r in rows], psi, 0.5)
        if contamination == "auto":
            return model, None
        scored = materialise(model.scores(points), "forest")
        model.threshold = exact_quantile(scored, "score", 1.0 - float(contamination))
        return model, scored

    def scores(self, points: DataFrame) -> DataFrame:
        forest = [
            tuple(np.asarray(t[c]) for c in ("feature", "cut", "left", "right", "depth"))
            for t in self.trees
        ]
        scale = max(float(average_path(self.sample_rows)), 1e-12)

        @F.pandas_udf(T.DoubleType())
        def score(vecs: pd.Series) -> pd.Series:
            if not len(vecs):
                return pd.Series([], dtype="float64")
            x = np.stack(vecs.to_numpy()).astype(np.float64)
            total, every = np.zeros(len(x)), np.arange(len(x))
            for feature, cut, left, right, depth in forest:
                at = np.zeros(len(x), dtype=np.int64)
                while True:
                    axis = feature[at]
                    inner = axis >= 0
                    if not inner.any():
                        break
                    below = x[every, np.where(inner, axis, 0)] <= cut[at]
                    at = np.where(inner, np.where(below, left[at], right[at]), at)
                total += depth[at]
            return pd.Series(np.power(2.0, -total / len(forest) / scale))

        return points.select("id", score("vec").alias("score"))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(self.trees, _TREE).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
        _write_state(spark, path, {"sample_rows": self.sample_rows, "threshold": self.threshold})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IsolationForest:
        state = _read_state(spark, path)
        trees = [r.asDict() for r in spark.read.parquet(f"{path}/trees").orderBy("tree").collect()]
        return cls(trees, state["sample_rows"], state["threshold"])


# --- one-class support vectors on random Fourier features -----------------------


class OneClassSVM(Detector):
    """RBF one-class SVM in a random Fourier feature space.

    The dual asks for the shortest mean over weights capped at 1/(nu n).  Each
    step finds the nu share of points with the least projection and
    the mean of their features: one quantile and one small sum over the data.
    The shortest point between all means found so far is then exact, on the driver, and the
    duality gap tells how far the whole problem still is from its end.
    ``gap`` is that gap over the squared length, ``kernel_error`` the mean
    difference between the feature products and the kernel, measured between all points and a few.
    """

    name = "oneclasssvm"
    gap = kernel_error = math.nan

    def __init__(self, directions, shifts, weights, threshold: float):
        self.directions = np.asarray(directions, dtype=np.float64)
        self.shifts = np.asarray(shifts, dtype=np.float64)
        self.weights = np.asarray(weights, dtype=np.float64)
        self.threshold = threshold

    @staticmethod
    def fourier_map(width: int, features: int, gamma: float, seed: int):
        rng = np.random.default_rng(seed)
        return rng.normal(0.0, math.sqrt(2.0 * gamma), (width, features)), rng.uniform(0, 2 * math.pi, features)

    @classmethod
    def fit(
        cls,
        points: DataFrame,
        nu: float = CONTAMINATION,
        features: int = 256,
        max_steps: int = 500,
        tolerance: float = GAP,
        seed: int = SEED,
    ) -> OneClassSVM:
        """Steps go on until the relative duality gap is below ``tolerance``; beyond ``max_steps`` is an error."""
        data = materialise(distinct_points(points, "id"), "svm")
        gamma = scale_gamma(data)
        width, rows = len(data.first()["vec"]), data.agg(F.sum("copies")).first()[0]
        directions, shifts = cls.fourier_map(width, features, gamma, seed)
        corners = [_mean_features(data, directions, shifts)]
        share = np.ones(1)
        model = cls(directions, shifts, corners[0], 0.0)
        mass = nu * rows
        for _ in range(max_steps):
            scored = model.scores(data.select("id", "vec", "copies"), "copies")
            cut = -_largest(scored, min(rows, max(1, math.ceil(mass - 1e-9))))
            corner = _least_corner(data, directions, shifts, model.weights, cut, mass)
            size = float(model.weights @ model.weights)
            model.gap = max(0.0, size - float(model.weights @ corner)) / max(size, 1e-300)
            if model.gap <= tolerance:
                break
            corners.append(corner)
            share = _shortest(np.array(corners), np.append(share, 0.0), tolerance * size / 10)
            corners, share = [c for c, s in zip(corners, share) if s > 0], share[share > 0]
            model.weights = share @ np.array(corners)
        else:
            raise RuntimeError(f"the duality gap is still {model.gap} after {max_steps} steps")
        model.kernel_error = _kernel_error(data, directions, shifts, gamma, seed)
        scored = model.scores(data.select("id", "vec", "copies"), "copies")
        model.threshold = exact_quantile(scored, "score", 1.0 - nu, "copies")
        return model

    def scores(self, points: DataFrame, *keep: str) -> DataFrame:
        directions, shifts, weights = self.directions, self.shifts, self.weights

        @F.pandas_udf(T.DoubleType())
        def score(vecs: pd.Series) -> pd.Series:
            if not len(vecs):
                return pd.Series([], dtype="float64")
            x = np.stack(vecs.to_numpy()).astype(np.float64)
            return pd.Series(-(_fourier(x, directions, shifts) @ weights))

        return points.select("id", score("vec").alias("score"), *keep)

    def save(self, spark: SparkSession, path: str) -> None:
        _write_state(
            spark,
            path,
            {
                "directions": self.directions.tolist(),
                "shifts": self.shifts.tolist(),
                "weights": self.weights.tolist(),
                "threshold": self.threshold,
                "gap": self.gap,
                "kernel_error": self.kernel_error,
            },
        )

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> OneClassSVM:
        s = _read_state(spark, path)
        model = cls(s["directions"], s["shifts"], s["weights"], s["threshold"])
        model.gap, model.kernel_error = s["gap"], s["kernel_error"]
        return model


def _fourier(x: np.ndarray, directions: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    return math.sqrt(2.0 / len(shifts)) * np.cos(x @ directions + shifts)


def scale_gamma(points: DataFrame) -> float:
    """1 / (width x variance over all cells)."""
    w = F.col("copies") if "copies" in points.columns else F.lit(1)
    cells = points.select(w.cast("double").alias("w"), F.size("vec").alias("d"), F.explode("vec").alias("x"))
    x = F.col("x").cast("double")
    m = cells.agg(
        (F.sum(x * F.col("w")) / F.sum("w")).alias("m"),
        (F.sum(x * x * F.col("w")) / F.sum("w")).alias("q"),
        F.max("d").alias("d"),
    ).first()
    variance = (m["q"] or 0.0) - (m["m"] or 0.0) ** 2
    return 1.0 / (m["d"] * variance) if variance > 0 else 1.0


def _largest(scored: DataFrame, rank: int) -> float:
    """The ``rank``-th largest score, copies counted."""
    rows = scored.select((-F.col("score")).alias("v"), F.col("copies").cast("long").alias("w"))
    head = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    return -order_statistic(rows, rank - 1, head["lo"], head["hi"])


def _least_corner(data, directions, shifts, weights, cut: float, mass: float) -> np.ndarray:
    """Mean feature of the ``mass`` points of least projection; those at the cut share what is left."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, len(shifts) + 1))
        for pdf in batches:
            if len(pdf):
                z = _fourier(np.stack(pdf["vec"].to_numpy()).astype(np.float64), directions, shifts)
                copies, at = pdf["copies"].to_numpy(dtype=np.float64), z @ weights
                for side, here in enumerate((at < cut - 1e-12, np.abs(at - cut) <= 1e-12)):
                    w = np.where(here, copies, 0.0)
                    total[side] += np.append(w @ z, w.sum())
        yield pd.DataFrame({"sums": [total.ravel()]})

    sums = (
        data.select("vec", "copies").mapInPandas(partial, "sums array<double>")
        .select(F.posexplode("sums").alias("at", "x"))
        .groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").collect()
    )
    below, level = np.array([r["x"] for r in sums]).reshape(2, -1)
    part = (mass - below[-1]) / level[-1] if level[-1] else 0.0
    return (below[:-1] + part * level[:-1]) / mass


def _shortest(corners: np.ndarray, share: np.ndarray, tolerance: float) -> np.ndarray:
    """Weights of the shortest point of the corners' hull, moving weight from the worst to the best corner."""
    gram = corners @ corners.T
    at = gram @ share
    for _ in range(200_000):
        best = int(at.argmin())
        worst = int(np.where(share > 0, at, -np.inf).argmax())
        if at[worst] - at[best] <= tolerance:
            break
        curve = gram[best, best] + gram[worst, worst] - 2 * gram[best, worst]
        move = min(share[worst], (at[worst] - at[best]) / max(curve, 1e-300))
        share[best] += move
        share[worst] = share[worst] - move if move < share[worst] else 0.0
        at += move * (gram[:, best] - gram[:, worst])
    return share / share.sum()


def _kernel_error(data, directions, shifts, gamma: float, seed: int, references: int = 32) -> float:
    """Mean absolute difference between feature products and the kernel, all points against a few."""
    few = np.array([r["vec"] for r in data.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(references).select("vec").collect()], dtype=np.float64)
    told = _fourier(few, directions, shifts)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
                exact = np.exp(-gamma * ((x[:, None] - few[None]) ** 2).sum(2))
                off = np.abs(_fourier(x, directions, shifts) @ told.T - exact)
                yield pd.DataFrame({"e": [off.sum()], "n": [float(off.size)]})

    r = data.select("vec").mapInPandas(partial, "e double, n double").agg((F.sum("e") / F.sum("n")).alias("e")).first()
    return float(r["e"])


def _mean_features(data, directions, shifts) -> np.ndarray:
    """Mean Fourier feature of all points, copies counted."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(shifts) + 1)
        for pdf in batches:
            if len(pdf):
                z = _fourier(np.stack(pdf["vec"].to_numpy()).astype(np.float64), directions, shifts)
                w = pdf["copies"].to_numpy(dtype=np.float64)
                total += np.append(w @ z, w.sum())
        yield pd.DataFrame({"sums": [total]})

    sums = (
        data.select("vec", "copies").mapInPandas(partial, "sums array<double>")
        .select(F.posexplode("sums").alias("at", "x"))
        .groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").collect()
    )
    values = np.array([r["x"] for r in sums])
    return values[:-1] / max(values[-1], 1e-12)


# --- neighbours ------------------------------------------------------------------


class KNNDistance(Detector):
    """Distance to the k-th nearest training point, itself included."""

    name = "knnoutlierdetector"
    strict = False

    def __init__(self, train: DataFrame, k: int, threshold: float):
        self.train, self.k, self.threshold = train, k, threshold

    @classmethod
    def fit(cls, points: DataFrame, **options) -> KNNDistance:
        return cls._fitted(points, **options)[0]

    @classmethod
    def _fitted(cls, points: DataFrame, contamination: float = CONTAMINATION, k: int = 5) -> tuple[KNNDistance, DataFrame]:
        train = materialise(distinct_points(points, "id"), "knn-train")
        model = cls(train, k, math.inf)
        scored = materialise(model._point_scores(train), "knn").join(train, "id")
        model.threshold = exact_quantile(scored, "score", 1.0 - contamination, "copies")
        return model, _to_rows(points, scored)

    def _point_scores(self, queries: DataFrame) -> DataFrame:
        found = nearest(queries.select("id", "vec"), self.train, self.k)
        return found.groupBy("id").agg(F.max("distance").alias("score"))

    def scores(self, points: DataFrame) -> DataFrame:
        return _spread(points, self._point_scores)

    def save(self, spark: SparkSession, path: str) -> None:
        self.train.write.mode("overwrite").parquet(f"{path}/train")
        _write_state(spark, path, {"k": self.k, "threshold": self.threshold})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> KNNDistance:
        s = _read_state(spark, path)
        return cls(spark.read.parquet(f"{path}/train"), s["k"], s["threshold"])


def _spread(points: DataFrame, score_points) -> DataFrame:
    """Score each distinct vector once and hand the score to all its rows."""
    places = materialise(distinct_points(points, "id"), "places")
    return _to_rows(points, materialise(score_points(places), "scored").join(places.select("id", "vec"), "id"))


def _to_rows(points: DataFrame, scored: DataFrame) -> DataFrame:
    return points.join(scored.select("vec", "score"), "vec").select("id", "score")


class LocalOutlierFactor(Detector):
    """Local outlier factor for new points.

    Training leaves a point out of its own neighbourhood, scoring does not.
    Identical points share one row with a count; ties in distance go to the
    smaller id, and the last neighbour contributes only the copies still needed.
    """

    name = "localoutlierfactor"

    def __init__(self, train: DataFrame, k: int, threshold: float):
        self.train, self.k, self.threshold = train, k, threshold

    @classmethod
    def fit(cls, points: DataFrame, **options) -> LocalOutlierFactor:
        return cls._fitted(points, **options)[0]

    @classmethod
    def _fitted(
        cls, points: DataFrame, contamination: float = CONTAMINATION, k: int = 20
    ) -> tuple[LocalOutlierFactor, DataFrame]:
        places = materialise(distinct_points(points, "id"), "lof-train")
        n = places.agg(F.sum("copies")).first()[0]
        k = max(1, min(k, n - 1))
        found = materialise(nearest(places.select("id", "vec"), places, k + 1), "lof")
        own = F.col("id") == F.col("neighbour_id")
        others = found.withColumn("copies", F.when(own, F.col("copies") - 1).otherwise(F.col("copies")))
        near = materialise(take_copies(others.where("copies > 0"), k), "lof-near")
        reach = near.groupBy("id").agg(F.max("distance").alias("k_distance"))
        density = local_density(near, reach)
        train = materialise(
            places.join(reach, "id").join(density, "id").select("id", "vec", "copies", "k_distance", "density"),
            "lof-model",
        )
        model = cls(train, k, math.inf)
        factors = model._ratio(near, density).join(places.select("id", "copies"), "id")
        model.threshold = exact_quantile(materialise(factors, "lof-f"), "score", 1.0 - contamination, "copies")
        # scored as if new: the same neighbours, the point itself among them
        again = take_copies(found, k)
        scored = model._ratio(again, local_density(again, train.select("id", "k_distance")))
        return model, _to_rows(points, scored.join(places.select("id", "vec"), "id"))

    def _ratio(self, near: DataFrame, density: DataFrame) -> DataFrame:
        other = self.train.select(F.col("id").alias("neighbour_id"), F.col("density").alias("other"))
        mean = near.join(other, "neighbour_id").groupBy("id").agg(
            (F.sum(F.col("other") * F.col("taken")) / F.sum("taken")).alias("mean")
        )
        return mean.join(density, "id").select("id", (F.col("mean") / F.col("density")).alias("score"))

    def _point_scores(self, queries: DataFrame) -> DataFrame:
        found = nearest(queries.select("id", "vec"), self.train.select("id", "vec", "copies"), self.k)
        near = materialise(take_copies(found, self.k), "lof-near")
        return self._ratio(near, local_density(near, self.train.select("id", "k_distance")))

    def scores(self, points: DataFrame) -> DataFrame:
        return _spread(points, self._point_scores)

    def save(self, spark: SparkSession, path: str) -> None:
        self.train.write.mode("overwrite").parquet(f"{path}/train")
        _write_state(spark, path, {"k": self.k, "threshold": self.threshold})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LocalOutlierFactor:
        s = _read_state(spark, path)
        return cls(spark.read.parquet(f"{path}/train"), s["k"], s["threshold"])


def take_copies(found: DataFrame, k: int) -> DataFrame:
    """Add ``taken``: the copies of each neighbour that count towards ``k``.

    A query has at most k + 1 neighbour rows, so the window is small.
    """
    before = (
        Window.partitionBy("id")
        .orderBy(F.round("distance", TIE_DIGITS), "neighbour_id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    used = F.coalesce(F.sum("copies").over(before), F.lit(0))
    return (
        found.withColumn("_used", used)
        .where(F.col("_used") < k)
        .withColumn("taken", F.least(F.col("copies"), F.lit(k) - F.col("_used")))
        .drop("_used")
    )


def local_density(near: DataFrame, reach: DataFrame) -> DataFrame:
    """Inverse mean reachability distance per point."""
    other = reach.select(F.col("id").alias("neighbour_id"), "k_distance")
    return near.join(other, "neighbour_id").groupBy("id").agg(
        (
            1.0
            / (
                F.sum(F.greatest("distance", "k_distance") * F.col("taken")) / F.sum("taken") + 1e-10
            )
        ).alias("density")
    )


# --- robust covariance -----------------------------------------------------------


def chi2_quantile(p: float, d: int) -> float:
    """Quantile of the chi-square distribution by bisection on its series."""

    def cdf(x: float) -> float:
        a, half = d / 2.0, x / 2.0
        term = total = 1.0 / a
        n = 0
        while term > total * 1e-15 and n < 5000:
            n += 1
            term *= half / (a + n)
            total += term
        return total * math.exp(-half + a * math.log(half) - math.lgamma(a)) if x > 0 else 0.0

    lo, hi = 0.0, 10.0 * d + 100.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


class RobustCovariance(Detector):
    """Minimum covariance determinant; the score is the squared Mahalanobis distance.

    Every start and every concentration step is judged on the whole table; see
    :func:`minimum_determinant`.
    """

    name = "ellipticenvelope"

    def __init__(self, centre, precision, threshold: float):
        self.centre = np.asarray(centre, dtype=np.float64)
        self.precision = np.asarray(precision, dtype=np.float64)
        self.threshold = threshold

    @classmethod
    def fit(cls, points: DataFrame, contamination: float = CONTAMINATION, seed: int = SEED) -> RobustCovariance:
        data = materialise(distinct_points(points, "id"), "mcd")
        d = len(data.first()["vec"])
        centre, cov, _ = minimum_determinant(data, d, seed=seed)
        # Consistency at the normal model, then one reweighting.
        model = cls(centre, np.linalg.pinv(cov), 0.0)
        middle = exact_quantile(model.scores(data, "copies"), "score", 0.5, "copies")
        scale = middle / chi2_quantile(0.5, d) if middle > 0 else 1.0
        model = cls(centre, np.linalg.pinv(cov * scale), 0.0)
        inside = model.scores(data, "vec", "copies").where(F.col("score") < chi2_quantile(0.975, d))
        centre, cov = _moments(inside, d)
        model = cls(centre, np.linalg.pinv(cov), 0.0)
        model.threshold = exact_quantile(model.scores(data, "copies"), "score", 1.0 - contamination, "copies")
        return model

    def scores(self, points: DataFrame, *keep: str) -> DataFrame:
        gap = F.transform(
            F.arrays_zip(F.col("vec").alias("x"), F.array(*[F.lit(float(c)) for c in self.centre]).alias("c")),
            lambda s: s["x"] - s["c"],
        )
        total = F.lit(0.0)
        for i in range(len(self.centre)):
            for j in range(len(self.centre)):
                total = total + F.get("_gap", F.lit(i)) * F.get("_gap", F.lit(j)) * F.lit(float(self.precision[i, j]))
        return points.withColumn("_gap", gap).select("id", total.alias("score"), *keep)

    def save(self, spark: SparkSession, path: str) -> None:
        _write_state(
            spark,
            path,
            {"centre": self.centre.tolist(), "precision": self.precision.tolist(), "threshold": self.threshold},
        )

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> RobustCovariance:
        s = _read_state(spark, path)
        return cls(s["centre"], s["precision"], s["threshold"])


def _moments(rows: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray]:
    w = F.col("copies").cast("double")
    x = [F.get("vec", F.lit(i)) for i in range(d)]
    first = rows.agg(F.sum(w).alias("n"), *[F.sum(x[i] * w).alias(f"m{i}") for i in range(d)]).first()
    mean = np.array([first[f"m{i}"] / first["n"] for i in range(d)])
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    second = rows.agg(
        *[
            F.sum((x[i] - F.lit(float(mean[i]))) * (x[j] - F.lit(float(mean[j]))) * w).alias(f"c{i}_{j}")
            for i, j in pairs
        ]
    ).first()
    cov = np.zeros((d, d))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = second[f"c{i}_{j}"] / first["n"]
    return mean, cov


def _mahalanobis(x: np.ndarray, centre: np.ndarray, precision: np.ndarray) -> np.ndarray:
    """Squared distances, entry by entry so that a row's value does not depend on its batch."""
    gap = x - centre
    total = np.zeros(len(x))
    for i in range(x.shape[1]):
        for j in range(x.shape[1]):
            total += gap[:, i] * gap[:, j] * precision[i, j]
    return total


def _drawn_starts(data: DataFrame, d: int, starts: int, seed: int) -> list[np.ndarray]:
    """For each start a few rows, those of least hash; ``starts`` times ``3 (d + 1)`` rows reach the driver."""
    most = 3 * (d + 1)
    keys = np.random.default_rng(seed).integers(1, 1 << 62, starts, dtype=np.uint64)

    def least(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            base = pdf["h"].to_numpy().astype(np.uint64)
            for s, key in enumerate(keys):
                mixed = (base ^ key) * np.uint64(0x9E3779B97F4A7C15)
                mixed = ((mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(1)
                at = np.argsort(mixed, kind="stable")[:most]
                yield pd.DataFrame({"start": s, "order": mixed[at].astype(np.int64), "vec": list(pdf["vec"].iloc[at])})

    drawn = data.select(F.xxhash64("id").alias("h"), "vec").mapInPandas(least, "start int, order long, vec array<double>")
    ranked = drawn.withColumn("_n", F.row_number().over(Window.partitionBy("start").orderBy("order", "vec"))).where(F.col("_n") <= most)
    rows: dict[int, list] = {}
    for r in ranked.orderBy("start", "_n").collect():
        rows.setdefault(r["start"], []).append(r["vec"])
    return [np.array(rows[s], dtype=np.float64) for s in sorted(rows)]


def _start_model(rows: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the first ``d + 1`` rows, or of as many more as give it full rank."""
    for n in range(d + 1, len(rows) + 1):
        cov = np.cov(rows[:n].T, bias=True).reshape(d, d)
        if np.linalg.matrix_rank(cov) == d:
            return rows[:n].mean(0), cov
    return rows.mean(0), np.cov(rows.T, bias=True).reshape(d, d)


def _per_start(data: DataFrame, models: list, emit, schema: str) -> DataFrame:
    """``emit(start, x, copies, scores)`` of every batch under every model."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
                copies = pdf["copies"].to_numpy(dtype=np.float64)
                for s, (centre, precision) in enumerate(models):
                    yield emit(s, x, copies, _mahalanobis(x, centre, precision))

    return data.select("vec", "copies").mapInPandas(run, schema)


def _support_cuts(data: DataFrame, models: list, support: int) -> list[float]:
    """For each model the least score up to which ``support`` rows lie, exact, all models at once.

    Each pass narrows every model's histogram to the bin that holds the answer, until
    that bin holds one value.
    """
    bins = 256
    ranges = [(-math.inf, math.inf)] * len(models)
    below = [0.0] * len(models)
    while any(lo < hi for lo, hi in ranges):
        now = list(ranges)

        def count(s: int, x: np.ndarray, copies: np.ndarray, scores: np.ndarray, now=now) -> pd.DataFrame:
            lo, hi = now[s]
            inside = (scores >= lo) & (scores <= hi)
            v, w = scores[inside], copies[inside]
            if lo == hi or not len(v):
                return pd.DataFrame({"start": [], "bin": [], "n": [], "lo": [], "hi": []})
            if math.isinf(lo):
                at = np.zeros(len(v), dtype=np.int64)
            else:
                at = np.minimum((v - lo) * (bins / (hi - lo)), bins - 1).astype(np.int64)
            table = pd.DataFrame({"bin": at, "n": w, "v": v}).groupby("bin").agg(n=("n", "sum"), lo=("v", "min"), hi=("v", "max")).reset_index()
            return table.assign(start=s)[["start", "bin", "n", "lo", "hi"]]

        parts = _per_start(data, models, count, "start int, bin int, n double, lo double, hi double")
        rows = parts.groupBy("start", "bin").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("start", "bin").collect()
        done = set()
        for r in rows:  # at most bins rows for each start
            s = r["start"]
            if s in done:
                continue
            if below[s] + r["n"] >= support:
                ranges[s] = (r["lo"], r["hi"])
                done.add(s)
            else:
                below[s] += r["n"]
    return [lo for lo, _ in ranges]


def _concentrate(data: DataFrame, models: list, support: int) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """One concentration step of every model: mean and covariance of its support, and the cut."""
    cuts = _support_cuts(data, models, support)

    def add(s: int, x: np.ndarray, copies: np.ndarray, scores: np.ndarray) -> pd.DataFrame:
        w = np.where(scores <= cuts[s], copies, 0.0)
        gap = x - models[s][0]
        sums = np.concatenate([[w.sum()], w @ gap, ((gap * w[:, None]).T @ gap).ravel()])
        return pd.DataFrame({"start": s, "at": np.arange(len(sums)), "x": sums})

    rows = _per_start(data, models, add, "start int, at int, x double").groupBy("start", "at").agg(F.sum("x").alias("x")).collect()
    d = len(models[0][0])
    sums = np.zeros((len(models), 1 + d + d * d))
    for r in rows:
        sums[r["start"], r["at"]] = r["x"]
    out = []
    for s, (centre, _) in enumerate(models):
        n = sums[s, 0]
        shift = sums[s, 1 : 1 + d] / n
        out.append((centre + shift, sums[s, 1 + d :].reshape(d, d) / n - np.outer(shift, shift), cuts[s]))
    return out


def minimum_determinant(
    data: DataFrame, d: int, starts: int = 30, kept: int = 10, first_steps: int = 2, max_steps: int = 200, seed: int = SEED
) -> tuple[np.ndarray, np.ndarray, float]:
    """Centre, covariance and cut of the support of least covariance determinant.

    ``data(id, vec, copies)``; the support is half of the rows (and ``d + 1``), or more where
    scores tie at the cut.  All starts concentrate side by side on the whole table; the ``kept``
    best go on until their determinants stand.  Not settling is an error.  Supports in a
    plane (determinant 0) only count when there is no other.
    """
    n = data.agg(F.sum("copies")).first()[0]
    support = min(n, math.ceil(0.5 * (n + d + 1)))
    models = [_start_model(rows, d) for rows in _drawn_starts(data, d, starts, seed)]
    mean, cov = _moments(data, d)
    models.append((mean, cov))
    tiny = 1e-15 * max(float(np.prod(np.diag(cov))), 1e-300)

    def rank(state: tuple) -> tuple[bool, float]:
        det = float(np.linalg.det(state[1]))
        return det <= tiny, det

    states = [(c, v, math.inf) for c, v in models]
    for _ in range(first_steps):
        states = _concentrate(data, [(c, np.linalg.pinv(v)) for c, v, _ in states], support)
    going = sorted(states, key=rank)[:kept]
    settled: list[tuple] = []
    for _ in range(max_steps):
        after = _concentrate(data, [(c, np.linalg.pinv(v)) for c, v, _ in going], support)
        still = []
        for old, new in zip(going, after):
            falls = rank(old)[1] > tiny and rank(new)[1] < rank(old)[1] * (1 - 1e-12)
            (still if falls else settled).append(new if falls else min(old, new, key=rank))
        going = still
        if not going:
            return min(settled, key=rank)
    raise RuntimeError(f"determinants still fall after {max_steps} steps")


DETECTORS = {
    "IsolationForest": IsolationForest,
    "OneClassSVM": OneClassSVM,
    "LocalOutlierFactor": LocalOutlierFactor,
    "EllipticEnvelope": RobustCovariance,
    "KNNOutlierDetector": KNNDistance,
}
