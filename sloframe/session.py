"""Session defaults. Operators never build a session; callers pass DataFrames."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
}


def get_session(app: str = "sloframe", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session; ``conf`` uses ``__`` for dots in option names."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark, local_only=True)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, local_only: bool = False) -> str | None:
    """Keep the folder the cluster names in ``spark.checkpoint.dir``.

    A temporary folder is chosen only for a local master without that setting
    (tests); a cluster must name a shared folder itself.
    """
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if spark.sparkContext.master.startswith("local"):
        current = tempfile.mkdtemp(prefix="sloframe-ckpt-")
        spark.sparkContext.setCheckpointDir(current)
        return current
    if local_only:
        return None
    raise ValueError("set spark.checkpoint.dir to a folder all executors share")
