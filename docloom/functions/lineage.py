"""Cutting lineage in the shared folder that the session names."""

from __future__ import annotations

import gc
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint into spark.checkpoint.dir; without one a folder of this machine serves, which only a
    local master can share with its executors."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="docloom-"))
    return df.checkpoint()


def swept(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files that no live plan refers to, which it does when the driver's JVM collects garbage."""
    for _ in range(2):  # the first lets go of Python's handles, the second of what these held
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)
