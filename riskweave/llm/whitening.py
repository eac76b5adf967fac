"""Whitening of embeddings through covariances found by polarisation.

Entries become whole numbers, so every sum is exact.  For each dimension and each
sum of two dimensions the tasks add up squares around a whole number near the mean; what
that centre is off is taken away exactly.  Then
``cov(i, j) = (var(i + j) - var(i) - var(j)) / 2``, an exact ratio of whole numbers
that is rounded once, and the matrix goes to ``eigh``.  The driver gets one number
per pair of dimensions, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.session import materialise

SCALE = 256
#: Rows that a task squares at a time.
CHUNK = 2_048
#: Largest absolute entry that is added up in machine words: CHUNK squares of a sum of two stay below 2^63.
WORD = 1 << 24
LONG_MAX = (1 << 63) - 1
#: Exact sums travel as text and are added as a high and a low part of this many digits.
SPLIT = 18
SUMS = "i int, s string, sign int"


@dataclass
class Whitening:
    """Everything a task needs to whiten a row; its size depends on the width alone."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float

    @property
    def explained(self) -> np.ndarray:
        total = float(np.trace(self.covariance))
        return self.values / total if total > 0 else np.zeros_like(self.values)


def whole_vector(vector: Column) -> Column:
    """``floor(256 c)`` of every entry as a long."""
    return F.transform(vector, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("long"))


def finite(vector: Column) -> Column:
    """True for a vector without null, NaN or infinite entries."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def whole_rows(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """``(vec_id, x)`` of the usable rows and their width.

    The width is the most frequent length above 0, of ties the largest; vectors of another length cannot
    share a covariance matrix and are dropped as damaged.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).where(finite(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("width")).count().where("width > 0")
    top = lengths.orderBy(F.desc("count"), F.desc("width")).first()
    width = top["width"] if top else 0
    return rows.where(F.size("v") == width).select("vec_id", whole_vector(F.col("v")).alias("x")), width


def _matrices(batches: Iterator[pa.RecordBatch], width: int, column: int) -> Iterator[np.ndarray]:
    for batch in batches:
        flat = batch.column(column).flatten().to_numpy(zero_copy_only=False)
        whole = flat.reshape(-1, width)
        for at in range(0, len(whole), CHUNK):
            yield whole[at : at + CHUNK]


def _exact_sums(parts: DataFrame) -> dict[int, int]:
    """Sum of the whole numbers ``s`` (as text) for each ``i``; two halves keep each sum within a decimal."""
    whole = F.col("s").cast("string")
    high = F.when(F.length(whole) > SPLIT, F.expr(f"substring(s, 1, length(s) - {SPLIT})")).otherwise(F.lit("0"))
    cut = parts.select("i", high.cast("decimal(38,0)").alias("high"), F.substring(whole, -SPLIT, SPLIT).cast("decimal(38,0)").alias("low"), "sign")
    sums = cut.groupBy("i").agg(F.sum(F.col("high") * F.col("sign")).alias("high"), F.sum(F.col("low") * F.col("sign")).alias("low"))
    return {r["i"]: int(r["high"]) * 10**SPLIT + int(r["low"]) for r in sums.collect()}


def _sum_batch(values: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(range(len(values)), pa.int32()), pa.array([str(abs(v)) for v in values]), pa.array([-1 if v < 0 else 1 for v in values], pa.int32())],
        ["i", "s", "sign"],
    )


def _partial_sums(rows: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of rows and exact sum of each dimension; every task sends one row per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = [0] * width, 0
        for x in _matrices(batches, width, 0):
            n += len(x)
            part = x.astype(object).sum(axis=0) if np.abs(x.astype(float)).max(initial=0) >= 2.0**50 else x.sum(axis=0)
            sums = [a + int(b) for a, b in zip(sums, part)]
        yield _sum_batch([*sums, n])

    got = _exact_sums(rows.select("x").mapInArrow(run, SUMS))
    return got.get(width, 0), [got.get(i, 0) for i in range(width)]


def _pair_squares(x: np.ndarray) -> np.ndarray:
    """For i <= j, in rows of i: the sum over rows of (x_i + x_j)^2, or of x_i^2 where i = j."""
    out = []
    for i in range(x.shape[1]):
        both = x[:, i:] + x[:, i : i + 1]
        both[:, 0] = x[:, i]
        out.append((both * both).sum(axis=0))
    return np.concatenate(out)


def covariance(rows: DataFrame, width: int) -> tuple[int, list[int], np.ndarray]:
    """``n``, the sums and the covariance matrix (divisor n) of the whole-number rows ``x``."""
    n, sums = _partial_sums(rows, width)
    if n == 0:
        return 0, sums, np.zeros((width, width))
    centre = [(2 * s + n) // (2 * n) for s in sums]  # the whole number next to the mean
    pairs = width * (width + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(pairs, dtype=object)
        mid = np.array(centre, dtype=object)
        small = all(abs(c) < WORD for c in centre)
        for x in _matrices(batches, width, 0):
            if small and np.abs(x.astype(float)).max(initial=0) < WORD:
                y = x - mid.astype(np.int64)
            else:
                y = x.astype(object) - mid
            total = total + _pair_squares(y).astype(object)
        yield _sum_batch([int(t) for t in total])

    got = _exact_sums(rows.select("x").mapInArrow(run, SUMS))
    off = [s - n * c for s, c in zip(sums, centre)]  # sums around the centre
    exact: dict[tuple[int, int], int] = {}
    p = 0
    for i in range(width):
        for j in range(i, width):
            t = off[i] if i == j else off[i] + off[j]
            exact[i, j] = n * got[p] - t * t  # n^2 times the variance
            p += 1
    out = np.zeros((width, width))
    for i in range(width):
        for j in range(i, width):
            own = 2 * exact[i, i] if i == j else exact[i, j] - exact[i, i] - exact[j, j]
            out[i, j] = out[j, i] = own / (2 * n * n)
    return n, sums, out


def _project(x: np.ndarray, model: Whitening, components: int) -> np.ndarray:
    """Rows on the leading components over the square root of the eigenvalue; NaN where that is not above 0."""
    mean = np.array([s // model.n for s in model.sums], dtype=np.int64)
    rest = np.array([(s % model.n) / model.n for s in model.sums])
    low = (x - mean) - rest if np.abs(x.astype(float)).max(initial=0) < 2.0**52 else x.astype(float) - (mean + rest)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(model.values[:components] > 0, low @ model.vectors[:, :components] / np.sqrt(model.values[:components]), np.nan)


def fit_whitening(rows: DataFrame, width: int, components: int) -> Whitening:
    """Fit on each distinct vector once; equal vectors fold before they are shuffled."""
    distinct = materialise(rows.select("x").distinct(), "distinct-vectors")
    n, sums, matrix = covariance(distinct, width)
    if n == 0:
        return Whitening(0, sums, matrix, np.zeros(0), np.zeros((width, 0)), 0.0)
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1].copy(), vectors[:, ::-1].copy()
    values[values <= values[0] * width * np.finfo(float).eps] = 0.0
    lead = vectors[np.abs(vectors).argmax(axis=0), np.arange(width)]
    vectors *= np.where(lead < 0, -1.0, 1.0)
    model = Whitening(n, sums, matrix, values, vectors, 0.0)
    model.identity_error = _identity_error(distinct, width, model, components)
    return model


def _identity_error(distinct: DataFrame, width: int, model: Whitening, components: int) -> float:
    """Largest difference between the covariance of the whitened fit rows and the identity, measured on all of them."""
    k = int((model.values[:components] > 0).sum())
    if k == 0:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for x in _matrices(batches, width, 0):
            w = np.column_stack([_project(x, model, k), np.ones(len(x))])
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], ["p", "s"])

    sums = distinct.mapInArrow(run, "p int, s double").groupBy("p").agg(F.sum("s").alias("s")).collect()
    total = np.zeros((k + 1) ** 2)
    for r in sums:
        total[r["p"]] = r["s"]
    total = total.reshape(k + 1, k + 1) / model.n
    mean = total[-1, :-1]
    return float(np.abs(total[:-1, :-1] - np.outer(mean, mean) - np.eye(k)).max())


def _deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Exact sums of (n x - S)^2; None beyond a long."""
    n = model.n
    top = max(abs(s) for s in model.sums) + n * float(np.abs(x.astype(float)).max(initial=0))
    if top * top * x.shape[1] < 2.0**62:
        y = n * x - np.array(model.sums, dtype=np.int64)
        return (y * y).sum(axis=1).tolist()
    y = n * x.astype(object) - np.array(model.sums, dtype=object)
    return [v if v <= LONG_MAX else None for v in (y * y).sum(axis=1).tolist()]


def whiten(vectors: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``: one row per usable row and component.

    Rows whose vector is null, empty or holds a null or non-finite entry are
    dropped, likewise vectors of an unusual length.  Repeated rows and null ids
    are returned as they come; equal vectors count once in the fit.  A
    component without variance has a null ``whitened``; a ``deviation`` beyond
    a long is null.  An empty table gives no rows.  Other columns are not read.
    """
    rows, width = whole_rows(vectors, id_col, vector_col)
    id_type = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if width == 0:
        return rows.sparkSession.createDataFrame([], schema)
    k = min(components, width)
    model = fit_whitening(rows, width, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        explained = model.explained[:k]
        for batch in batches:
            at = 0
            for x in _matrices(iter([batch]), width, 1):
                ids = batch.column(0).slice(at, len(x))
                at += len(x)
                take = pa.array(np.repeat(np.arange(len(x)), k))
                whitened = _project(x, model, k).ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(take),
                        pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                        pa.array(np.full(len(x) * k, model.n), pa.int64()),
                        pa.array([d for d in _deviations(x, model) for _ in range(k)], pa.int64()),
                        pa.array(whitened, mask=np.isnan(whitened)),
                        pa.array(np.tile(explained, len(x))),
                        pa.array(np.full(len(x) * k, model.identity_error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, schema)
