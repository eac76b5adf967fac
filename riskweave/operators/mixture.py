"""Gaussian mixtures with full covariances, fitted by expectation maximisation.

A round is one pass over the points: every task adds up the log likelihood and, per
component, responsibility, offsets and outer products around the present mean.
The model itself, ``k`` matrices of the points' width, is all that travels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEED = 42
RIDGE = 1e-6
TOLERANCE = 1e-3
MAX_ROUNDS = 1000
RESTARTS = 3
#: Numbers in all covariance matrices together; wider points need a projection first.
MAX_CELLS = 1 << 25
#: Rows of a matrix that travel together.
ROW_BLOCK = 32


@dataclass
class Mixture:
    """Weights, means and covariances, and the mean log likelihood after each round."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    history: list[float] = field(default_factory=list)

    def factors(self) -> tuple[np.ndarray, np.ndarray]:
        """Inverse Cholesky factors of the covariances and the constant of each log density."""
        width = self.means.shape[1]
        inverse = np.stack([np.linalg.inv(np.linalg.cholesky(c)) for c in self.covariances])
        half = np.array([np.log(np.diag(m)).sum() for m in inverse])
        with np.errstate(divide="ignore"):
            return inverse, np.log(self.weights) + half - 0.5 * width * math.log(2 * math.pi)

    def responsibilities(self, points: DataFrame) -> DataFrame:
        """``(id, label, parts)``: the likeliest component and the share of each."""
        means, (inverse, constant) = self.means, self.factors()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    x = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
                    parts, _ = _shares(x, means, inverse, constant)
                    yield pd.DataFrame({"id": pdf["id"], "label": parts.argmax(1).astype("int32"), "parts": list(parts)})

        schema = T.StructType(
            [points.schema["id"], T.StructField("label", T.IntegerType()), T.StructField("parts", T.ArrayType(T.DoubleType()))]
        )
        return points.select("id", "vec").mapInPandas(run, schema)

    def total_covariance(self, ridge: float = RIDGE) -> tuple[np.ndarray, np.ndarray]:
        """Mean and covariance of the mixture as a whole, without the ridge.

        After any round these are the points' own, since responsibilities sum to one.
        """
        mean = self.weights @ self.means
        inner = self.covariances - ridge * np.eye(len(mean))
        gap = self.means - mean
        return mean, np.einsum("k,kij->ij", self.weights, inner) + (gap.T * self.weights) @ gap


def _shares(x: np.ndarray, means: np.ndarray, inverse: np.ndarray, constant: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Responsibilities of the components for each row, and the row's log likelihood."""
    logs = np.empty((len(x), len(means)))
    for j, (mean, factor) in enumerate(zip(means, inverse)):
        logs[:, j] = constant[j] - 0.5 * (((x - mean) @ factor.T) ** 2).sum(1)
    top = logs.max(1, keepdims=True)
    likelihood = top[:, 0] + np.log(np.exp(logs - top).sum(1))
    return np.exp(logs - likelihood[:, None]), likelihood


def _round(points: DataFrame, model: Mixture, labelled: bool) -> tuple[Mixture, float]:
    """The model after one round, and the mean log likelihood before it.

    With ``labelled`` the responsibilities are the given labels.
    """
    k, width = model.means.shape
    means = model.means
    inverse, constant = (None, None) if labelled else model.factors()
    blocks = -(-width // ROW_BLOCK)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head = np.zeros((k, width + 1))
        outer = np.zeros((k, width, width))
        total = 0.0
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
            if labelled:
                parts = np.eye(k)[pdf["label"].to_numpy()]
            else:
                parts, likelihood = _shares(x, means, inverse, constant)
                total += likelihood.sum()
            for j in range(k):
                gap, r = x - means[j], parts[:, j]
                head[j, 0] += r.sum()
                head[j, 1:] += r @ gap
                outer[j] += (gap * r[:, None]).T @ gap
        keys, sums = [-1], [np.append(head.ravel(), total)]
        for j in range(k):
            for b in range(blocks):
                keys.append(j * blocks + b)
                sums.append(outer[j, b * ROW_BLOCK : (b + 1) * ROW_BLOCK].ravel())
        yield pd.DataFrame({"key": keys, "sums": sums})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "sums": [np.sum(np.stack(pdf["sums"].to_numpy()), axis=0)]})

    schema = "key int, sums array<double>"
    cols = ["vec", "label"] if labelled else ["vec"]
    rows = points.select(*cols).mapInPandas(partial, schema).groupBy("key").applyInPandas(add, schema).collect()
    got = {r["key"]: np.array(r["sums"]) for r in rows}
    head = got[-1][:-1].reshape(k, width + 1)
    mass = head[:, 0] + 10 * np.finfo(float).eps
    shift = head[:, 1:] / mass[:, None]
    covariances = np.empty((k, width, width))
    for j in range(k):
        outer = np.concatenate([got[j * blocks + b] for b in range(blocks)]).reshape(width, width)
        cov = outer / mass[j] - np.outer(shift[j], shift[j])
        covariances[j] = (cov + cov.T) / 2 + RIDGE * np.eye(width)
    after = Mixture(mass / mass.sum(), means + shift, covariances, list(model.history))
    return after, float(got[-1][-1]) / head[:, 0].sum()


def fit_mixture(
    points: DataFrame,
    k: int,
    seed: int = SEED,
    restarts: int = RESTARTS,
    tolerance: float = TOLERANCE,
    max_rounds: int = MAX_ROUNDS,
) -> Mixture:
    """The likeliest of several mixtures of ``points(id, vec)``, each started from a k-means.

    Rounds go on until the mean log likelihood grows by less than ``tolerance``;
    not settling within ``max_rounds`` is an error, and so are points too wide for
    full covariances.
    """
    from riskweave.operators.clustering import best_kmeans, ml_points

    points = points.select("id", "vec").persist()
    first = points.first()
    if first is None:
        raise ValueError("a mixture needs points")
    width = len(first["vec"])
    if k * width * width > MAX_CELLS:
        raise ValueError(f"{k} full covariances of width {width} are too large; project the points first")
    best: Mixture | None = None
    for start in range(restarts):
        kmeans = best_kmeans(ml_points(points), k, restarts=1, seed=seed + start)
        centres = np.asarray(kmeans.clusterCenters())
        labelled = kmeans.transform(ml_points(points)).select("id", F.col("prediction").alias("label")).join(points, "id")
        model = Mixture(np.full(len(centres), 1.0 / len(centres)), centres, np.empty((0, 0, 0)))
        model, _ = _round(labelled, model, labelled=True)
        before = -math.inf
        for _ in range(max_rounds):
            after, likelihood = _round(points, model, labelled=False)
            model.history.append(likelihood)
            if likelihood - before < tolerance:
                break
            before, after.history = likelihood, model.history
            model = after
        else:
            raise RuntimeError(f"the mixture did not settle within {max_rounds} rounds")
        if best is None or model.history[-1] > best.history[-1]:
            best = model
    points.unpersist()
    return best
