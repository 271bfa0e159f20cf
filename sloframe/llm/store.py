"""Tables of a run in the shared folder that the session names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sloframe.session import ensure_checkpoint_dir


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; nothing is created yet."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/sloframe-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later reads survive lost
    executors without running the plan above again."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(path: str):
    """File system and path within it, for tasks that write or read byte ranges."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose result is stored: it does so once
    the driver has collected the garbage that refers to them."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
