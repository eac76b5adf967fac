"""Reproducible shuffle into shards by a keyed permutation of row numbers.

Rows get global numbers 0..n-1 in a fixed order; a Feistel network permutes
them, walking the cycle until the value falls below n.  Place p of row r goes to
shard ``p mod shards`` at slot ``p div shards``, so counts differ by one at most
and anyone who knows a row number can compute its place, and the other way round.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.columns import text_of
from riskweave.session import drop_table, materialise, materialise_at

ROUNDS = 6
SEED = 20_240_611


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A well-spread 64-bit hash of each number under ``key``."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


class RowPermutation:
    """Bijection of 0..n-1, the same for the same ``n`` and ``seed`` everywhere."""

    def __init__(self, n: int, seed: int = SEED, rounds: int = ROUNDS):
        self.n = n
        self.half = np.uint64(max(1, ((max(n - 1, 1)).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = [int(k) for k in _mix(np.arange(1, rounds + 1, dtype=np.uint64), seed & (2**64 - 1))]

    def _once(self, x: np.ndarray, keys: list[int]) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in keys:
            left, right = right, left ^ (_mix(right, k) & self.mask)
        return (left << self.half) | right

    def _back(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in reversed(self.keys):
            left, right = right ^ (_mix(left, k) & self.mask), left
        return (left << self.half) | right

    def _walk(self, x: np.ndarray, step) -> np.ndarray:
        x = step(np.asarray(x, dtype=np.uint64))
        # the domain is at most four times n, so few values walk on
        while (out := x >= np.uint64(self.n)).any():
            x[out] = step(x[out])
        return x.astype(np.int64)

    def forward(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, lambda v: self._once(v, self.keys))

    def inverse(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, self._back)


def number_rows(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``rows`` with ``row_no`` 0..n-1 in the given order, and n.

    Range partitions are sorted apart and written once; each starts where the
    sizes of those before it end (one number per partition).  Rows equal in
    all of ``order`` are interchangeable and may be split between partitions.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed, path = materialise_at(
        rows.withColumn("_tie", F.rand(1))
        .repartitionByRange(parts, *order, "_tie")
        .sortWithinPartitions(*order, "_tie")
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_in", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_tie"),
        "row-order",
    )
    sizes = placed.groupBy("_part").count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition of the table
    starts = sizes.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    n = placed.count()
    numbered = placed.join(F.broadcast(starts), "_part").withColumn("row_no", F.col("_start") + F.col("_in"))
    out = materialise(numbered.drop("_part", "_in", "_start"), "row-numbers")
    drop_table(spark, path)
    return out, n


def shard_documents(
    docs: DataFrame,
    shards: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = SEED,
) -> DataFrame:
    """``(doc_id, size, text_crc32, row_no, shard, slot)``, one row per document.

    Rows are numbered by (doc_id, crc32, size), nulls first, so the shuffle does
    not depend on how the table is partitioned.  Null text counts as empty.
    Repeated rows each get a place of their own.  Groups of equal texts are not
    kept together: the law is on rows, so that a text with many copies can't fill
    a shard; copies have the same ``size`` and ``text_crc32``, which tell them.
    Other columns are not read.
    """
    text = text_of(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    numbered, n = number_rows(rows, ["doc_id", "text_crc32", "size"])

    @F.pandas_udf("long")
    def place(row_no: pd.Series) -> pd.Series:
        return pd.Series(RowPermutation(n, seed).forward(row_no.to_numpy()))

    placed = numbered.withColumn("_place", place("row_no"))
    return placed.select(
        "doc_id", "size", "text_crc32", "row_no",
        F.pmod("_place", F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"_place div {int(shards)}").alias("slot"),
    )
