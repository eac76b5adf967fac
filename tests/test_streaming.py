from __future__ import annotations

import datetime as dt
import os
from pathlib import Path

from pyspark.sql import functions as F

from riskweave.plans import alert_queries, roles
from riskweave.streaming import alerts

from conftest import SMALL

TX = "tx_id long, entity_id string, ts timestamp, amount double, currency string, kind string, level string"


def _stream(spark, df, folder, parts=4):
    """The rows as a file stream: one file per time range, one file per batch."""
    df.repartitionByRange(parts, "ts").write.parquet(folder)
    # File streams read oldest files first: date them in the order of their rows.
    for i, path in enumerate(sorted(Path(folder).glob("part-*.parquet"))):
        os.utime(path, (1_700_000_000 + 60 * i,) * 2)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _run(stream, tmp_path):
    q = alerts.start_alert_stream(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    assert q.exception() is None
    return stream.sparkSession.read.schema(stream.schema).parquet(str(tmp_path / "out"))


def _payments(spark):
    return alert_queries.small_payments(spark, SMALL).withColumn("ts", F.col("ts").cast("timestamp"))


def test_structuring_stream_emits_closed_windows(spark, tmp_path):
    df = _payments(spark)
    stream = alerts.structuring_windows(
        _stream(spark, df, str(tmp_path / "in")), 150.0, "24 hours", "12 hours", watermark="1 hour")
    got = {(r["entity_id"], r["window_start"]): (r["operations"], round(r["total"], 6)) for r in _run(stream, tmp_path).collect()}
    batch = alerts.structuring_windows(df, 150.0, "24 hours", "12 hours")
    want = {(r["entity_id"], r["window_start"]): (r["operations"], round(r["total"], 6)) for r in batch.collect()}
    assert got and all(want[k] == v for k, v in got.items())
    last = df.agg(F.max("ts")).first()[0]
    open_ = [k for k in want if k not in got]
    assert all(k[1] + dt.timedelta(hours=24) >= last - dt.timedelta(hours=1) for k in open_)


def test_threshold_stream_equals_batch(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, "A", t, 50_000.0, "MXN", "cash", "L"), (2, "A", t, 49_999.99, "MXN", "cash", "L"),
            (3, "B", t + dt.timedelta(1), 170_068.1, "MXN", "international", "L"),
            (4, "B", t + dt.timedelta(2), 9_999.0, "USD", "international", "L"), (5, "C", t, 1e9, "XXX", "cash", "L")]
    df = spark.createDataFrame(rows, TX)
    rates = ({"MXN": 1.0, "USD": 17.0}, {"MXN": 1 / 17.0, "USD": 1.0})
    batch = {r["tx_id"]: r["rule"] for r in alerts.threshold_alerts(df, *rates).collect()}
    assert batch == {1: "cash_limit", 3: "transfer_limit"}
    stream = alerts.threshold_alerts(_stream(spark, df, str(tmp_path / "in"), 2), *rates)
    assert {r["tx_id"]: r["rule"] for r in _run(stream, tmp_path).collect()} == batch


def test_monthly_stream_emits_finished_months(spark, tmp_path):
    rows = [(i, "A", dt.datetime(2024, m, d), 60.0, "MXN", "cash", "L") for i, (m, d) in
            enumerate([(1, 3), (1, 20), (2, 1), (3, 5), (3, 9), (5, 1)])]
    df = spark.createDataFrame(rows, TX)
    batch = {(r["month"].month, r["total"]) for r in alerts.monthly_limits(df, {"L": 100.0}).collect()}
    assert batch == {(1, 120.0), (3, 120.0)}
    stream = alerts.monthly_limits(_stream(spark, df, str(tmp_path / "in")), {"L": 100.0}, watermark="32 days")
    assert {(r["month"].month, r["total"]) for r in _run(stream, tmp_path).collect()} <= batch


def test_role_tables_have_hot_and_null_keys(spark):
    ev = roles.evidence(spark, SMALL)
    assert ev.where("url_or_reference LIKE '%exports/SDN.XML'").count() > 1
    assert ev.where("entity_id IS NULL OR url_or_reference IS NULL").count() > 1
