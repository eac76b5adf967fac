"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

The weights are learned by follow-the-regularised-leader (proximal, with an
elastic net), which leaves most of them at exactly zero; a temperature fitted
on held-back rows calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: n-gram buckets and lengths.
BITS = 15
ORDERS = (1, 2, 3)
#: Rows the classifier is fitted on, at most; document frequencies come from all learning rows.
TRAIN_ROWS = 4000
CALIBRATION_SHARE = 0.2
#: Characters of the short part that is also learned from each row.
SNIPPET = 30
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")


def gram_counts(text: str) -> np.ndarray:
    """How often each n-gram bucket occurs; what isn't a letter counts as a space."""
    x = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    x = np.where((x < 128) & ((x < 97) | (x > 122)), np.uint32(32), x)
    total = np.zeros(1 << BITS, dtype=np.int64)
    for n in ORDERS:
        if x.size < n:
            break
        h = np.full(x.size - n + 1, 0x9E3779B1 * n & 0xFFFFFFFF, dtype=np.uint32)
        for i in range(n):
            h = (h ^ x[i : x.size - n + 1 + i]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
        total += np.bincount(h >> np.uint32(32 - BITS), minlength=1 << BITS)
    return total


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their weights, of length 1 in all."""
    at = np.flatnonzero(counts)
    v = np.log1p(counts[at]) * idf[at]
    norm = np.sqrt((v * v).sum())
    return at, v / norm if norm > 0 else v


@dataclass
class LanguageModel:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x labels
    bias: np.ndarray
    temperature: float = 1.0

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.labels or not _LETTER.search(text):
            return UNKNOWN, 0.0
        at, v = tf_idf(gram_counts(text), self.idf)
        z = (v @ self.weights[at] + self.bias) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.labels[best], float(p[best] / p.sum())


def fit_ftrl(
    rows: list[tuple[np.ndarray, np.ndarray]],
    y: np.ndarray,
    labels: int,
    buckets: int,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.05,
    l2: float = 0.01,
    updates: int = 800,
    batch: int = 40,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases after ``updates`` batches; the bias is one more feature that no penalty shrinks."""
    z = np.zeros((buckets + 1, labels))
    n = np.zeros_like(z)
    penalty = np.full((buckets + 1, 1), l1)
    penalty[-1] = 0.0

    def weights(at: np.ndarray) -> np.ndarray:
        zz, nn = z[at], n[at]
        w = -(zz - np.sign(zz) * penalty[at]) / ((beta + np.sqrt(nn)) / alpha + l2)
        return np.where(np.abs(zz) > penalty[at], w, 0.0)

    rng = np.random.default_rng(7)
    order, lo = np.zeros(0, dtype=np.int64), 0
    for _ in range(updates):
        if lo >= order.size:
            order, lo = rng.permutation(len(rows)), 0
        part = order[lo : lo + batch]
        lo += batch
        at, local = np.unique(np.concatenate([*(rows[i][0] for i in part), [buckets]]), return_inverse=True)
        x = np.zeros((len(part), at.size))
        start = 0
        for k, i in enumerate(part):
            size = rows[i][0].size
            x[k, local[start : start + size]] = rows[i][1]
            start += size
        x[:, -1] = 1.0
        w = weights(at)
        p = np.exp((s := x @ w) - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(part)), y[part]] -= 1.0
        g = x.T @ p / len(part)
        n_new = n[at] + g * g
        z[at] += g - (np.sqrt(n_new) - np.sqrt(n[at])) / alpha * w
        n[at] = n_new
    w = weights(np.arange(buckets + 1))
    return w[:-1], w[-1]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm."""

    def loss(log_t: float) -> float:
        s = logits / np.exp(log_t)
        m = s.max(axis=1)
        return float((m + np.log(np.exp(s - m[:, None]).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    lo, hi, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def held_out(id_col: str) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text leaves 2 by 4. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """How many texts have each bucket, over all of ``texts``; each task adds up its own first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(1 << BITS, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                df += gram_counts(text.as_py()) > 0
                rows += 1
        at = np.append(np.flatnonzero(df), 1 << BITS)  # the last is the number of rows
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(np.append(df, rows)[at], pa.int64())], ["bucket", "n"])

    # at most one row per bucket reaches the driver
    found = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df = np.zeros((1 << BITS) + 1, dtype=np.int64)
    for r in found:
        df[r["bucket"]] = r["n"]
    return df[:-1], int(df[-1])


def train_language_model(
    docs: DataFrame,
    text_col: str = "text",
    label_col: str = "lang",
    id_col: str = "doc_id",
    train_rows: int = TRAIN_ROWS,
) -> LanguageModel:
    """Learn from ``docs`` rows with a label and a text.

    The classifier sees at most about ``train_rows`` rows, evenly over the labels
    and chosen by a hash of the id and text; document frequencies count every
    row.  Without any labelled row the model knows no label.
    """
    known = docs.select(
        F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label"),
        F.xxhash64(F.lit(11), F.col(id_col), F.col(text_col)).alias("order"),
    ).where(F.col("text").isNotNull() & F.col("label").isNotNull())
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().orderBy("label").collect()}
    labels = sorted(sizes)
    df, rows = document_frequencies(known.select("text"))
    idf = np.log((1 + rows) / (1 + df)) + 1.0
    if not labels:
        return LanguageModel([], idf, np.zeros((1 << BITS, 0)), np.zeros(0))
    quota = max(1, train_rows // len(labels))
    chosen = F.lit(False)
    for label in labels:
        share = min(1.0, quota / sizes[label])
        low = F.pmod("order", F.lit(1 << 30)) < int(share * (1 << 30))
        chosen = chosen | ((F.col("label") == label) & (low if share < 1 else F.lit(True)))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # each text twice: whole, and a few words of it, so that short texts are learned too
        for batch in batches:
            pairs: list[list[bytes]] = [[], []]
            for text, order in zip(batch.column(0), batch.column(2)):
                whole = text.as_py()
                start = order.as_py() % max(1, len(whole) - SNIPPET)
                for column, part in zip(pairs, (whole, whole[start : start + SNIPPET])):
                    counts = gram_counts(part)
                    nz = np.flatnonzero(counts)
                    column.append(np.stack([nz, np.minimum(counts[nz], 2**32 - 1)]).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), *(pa.array(c, pa.binary()) for c in pairs)], ["label", "order", "whole", "part"]
            )

    # bounded: train_rows rows of at most 1 << BITS buckets
    sample = known.where(chosen).select("text", "label", "order").mapInArrow(
        features, "label string, order long, whole binary, part binary"
    ).orderBy("order").limit(train_rows + train_rows // 4 + len(labels)).collect()
    xs, ys = [], []
    number = {label: i for i, label in enumerate(labels)}
    for r in sample:
        for packed in (r["whole"], r["part"]):
            at, n = np.frombuffer(packed, "<u4").reshape(2, -1)
            counts = np.zeros(1 << BITS, dtype=np.int64)
            counts[at] = n
            xs.append(tf_idf(counts, idf))
            ys.append(number[r["label"]])
    y = np.array(ys)
    held = int(len(xs) * CALIBRATION_SHARE)
    w, bias = fit_ftrl(xs[held:] or xs, y[held:] if held < len(xs) else y, len(labels), 1 << BITS)
    model = LanguageModel(labels, idf, w, bias)
    if held >= 10:
        logits = np.array([v @ w[at] + bias for at, v in xs[:held]])
        model.temperature = fit_temperature(logits, y[:held])
    return model


def predict_language(
    docs: DataFrame, model: LanguageModel, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """``docs`` with the predicted label and its calibrated probability.

    A text that is null or has no letter is ``und`` with score 0, as is every
    text of a model without labels.  Columns named like the new ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 1 << BITS buckets by labels
    carried = [c for c in docs.columns if c not in names]

    # Only the text goes to Python.  Without the last call a later filter would predict a second time.
    @F.pandas_udf("label string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        found = [shared.value.predict(t) for t in texts]
        return pd.DataFrame({"label": [a for a, _ in found], "score": [float(b) for _, b in found]}, columns=["label", "score"])

    told = predict.asNondeterministic()(F.col(text_col).cast("string"))
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), told.alias("told"))
    return given.select(
        *[F.col("row").getField(c).alias(c) for c in carried],
        F.col("told.label").alias(names[0]), F.col("told.score").alias(names[1]),
    )
