"""Spark session settings and the shared scratch folder.

All jobs run on whatever session the caller hands in; ``get_spark`` is only
a convenience for tests, the bench and local use.  The scratch folder for
written intermediate tables is always taken from ``spark.checkpoint.dir``
(the shared folder a cluster names); a local default is set only when the
session has none, as in tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the jobs are designed around.  AQE re-plans joins from runtime
# sizes (broadcast only below the size threshold Spark checks), coalesces
# small shuffle partitions and splits skewed ones.
SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}

# Runtime SQL settings the library applies to any session it is handed.
# HotSpot does not JIT-compile methods over 8000 bytes of bytecode; with this
# limit a stage whose fused method would be larger falls back to per-operator
# code, whose expression code is split into small JIT-able methods.
RUNTIME_CONF = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def apply_runtime_conf(spark: SparkSession) -> None:
    for k, v in RUNTIME_CONF.items():
        spark.conf.set(k, v)


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app_name: str = "roadlens") -> SparkSession:
    master = master or os.environ.get("ROADLENS_MASTER", "local[*]")
    builder = SparkSession.builder.master(master).appName(app_name)
    for k, v in SESSION_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("ROADLENS_DRIVER_MEM", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_runtime_conf(spark)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder.

    Where none is configured, a local session gets a temporary one; on a
    cluster that folder would not be shared, so it is an error there."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="roadlens-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def materialize(df, name: str):
    """Write ``df`` once as Parquet under the shared checkpoint folder and read
    it back: cuts the lineage (a lost executor does not restart upstream
    work) and computes the input once (an RDD checkpoint computes it twice)."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/roadlens/{name}-{uuid.uuid4().hex[:12]}"
