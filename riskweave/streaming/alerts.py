"""Transaction alerts, the same plan for tables and for streams.

Transactions hold ``tx_id, entity_id, ts, amount, currency, kind``.  On a stream
the windowed rules take a watermark and run in append mode: a window is emitted
once, after the watermark has passed it, and rows later than that are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Reporting thresholds.
CASH_LIMIT_MXN = 50_000.0
TRANSFER_LIMIT_USD = 10_000.0

CASH, TRANSFER = "cash", "international"


def converted(amount: Column, currency: Column, rates: dict[str, float]) -> Column:
    """Amount times the rate of its currency; null for an unknown currency.

    Rates are given by the caller, one per currency.
    """
    rate = F.lit(None).cast("double")
    for code, value in rates.items():
        rate = F.when(currency == code, F.lit(float(value))).otherwise(rate)
    return amount * rate


def threshold_alerts(
    transactions: DataFrame,
    to_mxn: dict[str, float],
    to_usd: dict[str, float],
    cash_limit: float = CASH_LIMIT_MXN,
    transfer_limit: float = TRANSFER_LIMIT_USD,
) -> DataFrame:
    """Single operations at or above a reporting threshold."""
    cash = converted(F.col("amount"), F.col("currency"), to_mxn)
    transfer = converted(F.col("amount"), F.col("currency"), to_usd)
    is_cash = (F.col("kind") == CASH) & (cash >= cash_limit)
    is_transfer = (F.col("kind") == TRANSFER) & (transfer >= transfer_limit)
    return (
        transactions.withColumn(
            "rule", F.when(is_cash, "cash_limit").when(is_transfer, "transfer_limit")
        )
        .withColumn("converted", F.when(is_cash, cash).when(is_transfer, transfer))
        .where(F.col("rule").isNotNull())
        .select("tx_id", "entity_id", "ts", "rule", "converted")
    )


def monthly_limits(transactions: DataFrame, limits: dict[str, float], watermark: str | None = None) -> DataFrame:
    """Entities whose total of a calendar month exceeds their level's limit.

    Needs a ``level`` column.  On a stream the month itself is the event time;
    with a watermark of d days a month closes once one that starts d days later
    has been seen.
    """
    monthly = transactions.withColumn("month", F.date_trunc("month", "ts").cast("timestamp"))
    if watermark:
        monthly = monthly.withWatermark("month", watermark)
    totals = monthly.groupBy("month", "entity_id", "level").agg(
        F.sum("amount").alias("total"), F.count(F.lit(1)).alias("operations")
    )
    limit = converted(F.lit(1.0), F.col("level"), limits)
    return totals.withColumn("limit", limit).where(F.col("total") > F.col("limit"))


def structuring_windows(
    transactions: DataFrame,
    limit: float,
    length: str = "7 days",
    slide: str = "1 day",
    least: int = 2,
    watermark: str | None = None,
) -> DataFrame:
    """Windows in which small operations of one entity add up to the limit.

    Only operations below the limit count.  Sums combine before the exchange,
    so a busy entity costs one row per window and task.
    """
    small = transactions.where(F.col("amount") < limit)
    if watermark:
        small = small.withWatermark("ts", watermark)
    return (
        small.groupBy(F.window("ts", length, slide).alias("w"), "entity_id")
        .agg(F.count(F.lit(1)).alias("operations"), F.sum("amount").alias("total"))
        .where((F.col("operations") >= least) & (F.col("total") >= limit))
        .select(
            "entity_id",
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "operations",
            "total",
        )
    )


def start_alert_stream(alerts: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Append alerts of a stream to a Parquet table; restarts resume exactly."""
    writer = (
        alerts.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
