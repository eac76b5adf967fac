"""Session helpers: the shared work folder and tables that cut lineage.

Iterative operators write their state as Parquet tables below the folder the
cluster names in ``spark.checkpoint.dir``.  Such a table survives the loss of
any executor, carries real size statistics for the adaptive planner, and is
computed once (an eager ``checkpoint()`` runs its last stage twice).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}


def work_root(spark: SparkSession) -> str:
    """Folder for intermediate tables, shared by every executor."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: iterative operators need a folder "
            "that every executor can reach"
        )
    app = sc.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="riskweave-")
        sc.setCheckpointDir(_LOCAL_ROOTS[app])
    return _LOCAL_ROOTS[app]


def materialise(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` once to the work folder and return a scan of that table."""
    return materialise_at(df, label)[0]


def materialise_at(df: DataFrame, label: str = "t") -> tuple[DataFrame, str]:
    """As :func:`materialise`, also returning the path so it can be dropped."""
    spark = df.sparkSession
    path = f"{work_root(spark)}/tables/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, path: str | None) -> None:
    """Remove a superseded iteration table from the work folder."""
    if path is None or not path.startswith(work_root(spark) + "/tables/"):
        return
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(hadoop, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence test on whatever file system the path names."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hadoop))
