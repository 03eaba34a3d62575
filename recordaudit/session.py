"""Session helpers: the settings the jobs rely on, and lineage cuts that survive executor loss."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app_name: str = "recordaudit", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session with the settings the jobs assume."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share, as the cluster names it in `spark.checkpoint.dir`.

    Only a session on one machine (tests) may go without the setting and gets a private folder; on a cluster a missing setting is
    an error, since each executor would write to its own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` as a table on shared storage and continue from that table: a lost executor costs no recomputation."""
    path = shared_path(df.sparkSession, "recordaudit")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
