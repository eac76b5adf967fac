"""Exact order statistics and running sums over whole tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.session import materialise

BINS = 2048


def order_statistic(df: DataFrame, rank: int, lo: float, hi: float) -> float:
    """Value at 0-based ``rank`` of ``df(v, w)`` by narrowing a histogram.

    Each round is one aggregation to at most ``BINS`` rows; the range shrinks by
    that factor or to the spread of a single bucket.
    """
    below = 0
    while lo < hi:
        width = (hi - lo) / BINS
        if width <= 0 or not math.isfinite(width):
            width = math.ulp(max(abs(lo), abs(hi)))
        inside = df.where((F.col("v") >= lo) & (F.col("v") <= hi))
        bucket = F.least(F.floor((F.col("v") - lo) / width), F.lit(BINS - 1))
        rows = (
            inside.groupBy(bucket.alias("b"))
            .agg(F.sum("w").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            .orderBy("b")
            .collect()
        )
        for row in rows:
            if rank < below + row["n"]:
                lo, hi = row["lo"], row["hi"]
                break
            below += row["n"]
        else:
            raise ValueError("rank beyond the table")
    return lo


def exact_quantile(
    df: DataFrame, col: str, q: float, weight: str | None = None
) -> float | None:
    """Quantile with linear interpolation between neighbouring ranks.

    ``weight`` counts how often a row occurs.  No more than a histogram is ever
    brought together.
    """
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    rows = df.select(F.col(col).cast("double").alias("v"), w.alias("w")).where(F.col("v").isNotNull())
    head = rows.agg(
        F.sum("w").alias("n"),
        F.min("v").alias("lo"),
        F.max("v").alias("hi"),
    ).first()
    if not head["n"]:
        return None
    position = q * (head["n"] - 1)
    rank = math.floor(position)
    low = order_statistic(rows, rank, head["lo"], head["hi"])
    if position == rank:
        return low
    high = order_statistic(rows, rank + 1, head["lo"], head["hi"])
    return low + (position - rank) * (high - low)


def value_at_rank(df: DataFrame, col: str, rank: int) -> float:
    """Value at a 0-based rank, without sorting the table."""
    rows = df.select(F.col(col).cast("double").alias("v"), F.lit(1).cast("long").alias("w")).where(
        F.col("v").isNotNull()
    )
    head = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    return order_statistic(rows, rank, head["lo"], head["hi"])


def running_sums(
    df: DataFrame, order: str, values: Sequence[str], descending: bool = True, parts: int | None = None
) -> DataFrame:
    """Add ``cum_<value>``: sums over the whole table in ``order``.

    Rows are range-partitioned and written once; each partition's totals (one
    row per partition) give the offset of the next, and the running sum itself
    stays inside a partition.  ``order`` must be unique.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.col(order).desc() if descending else F.col(order).asc()
    placed = materialise(
        df.repartitionByRange(parts, key).withColumn("_part", F.spark_partition_id()), "runs"
    )
    totals = (
        placed.groupBy("_part").agg(*[F.sum(v).alias(v) for v in values]).orderBy("_part").collect()
    )
    offsets, carried = [], [0.0] * len(values)
    for row in totals:
        offsets.append((row["_part"], *carried))
        carried = [c + float(row[v]) for c, v in zip(carried, values)]
    names = ["_part", *[f"_o{i}" for i in range(len(values))]]
    schema = ", ".join(["_part int", *[f"{n} double" for n in names[1:]]])
    table = spark.createDataFrame(offsets, schema)
    window = Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(F.broadcast(table), "_part")
    return out.withColumns(
        {
            f"cum_{v}": F.sum(F.col(v).cast("double")).over(window) + F.col(f"_o{i}")
            for i, v in enumerate(values)
        }
    ).drop(*names)


def column_moments(df: DataFrame, names: Sequence[str], weight: str | None = None) -> list[tuple[float, float]]:
    """Mean and population deviation of each column, in one aggregation."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    aggs = []
    for i, n in enumerate(names):
        x = F.coalesce(F.col(n).cast("double"), F.lit(0.0))
        aggs.append((F.sum(x * w) / F.sum(w)).alias(f"m{i}"))
    means = df.agg(*aggs).first()
    aggs = []
    for i, n in enumerate(names):
        x = F.coalesce(F.col(n).cast("double"), F.lit(0.0)) - F.lit(means[f"m{i}"])
        aggs.append(F.sqrt(F.sum(x * x * w) / F.sum(w)).alias(f"s{i}"))
    devs = df.agg(*aggs).first() if means["m0"] is not None else None
    return [
        (means[f"m{i}"] or 0.0, (devs[f"s{i}"] if devs else 0.0) or 0.0) for i in range(len(names))
    ]
