"""Shared scratch tables: lineage is cut by writing Parquet where all executors see it."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Without one a folder of this machine serves, which only a
    local master can share with its executors."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back; removed by ``released`` or when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docloom-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    where, system = _folder(spark, path)
    system.deleteOnExit(where)
    out = spark.read.parquet(path)
    out._scratch = path
    return out


def released(*tables: DataFrame) -> None:
    """Delete stored tables; every result that reads them must have been stored itself."""
    for df in tables:
        where, system = _folder(df.sparkSession, df._scratch)
        system.delete(where, True)


def swept(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files that no live plan refers to; it acts on garbage that the
    driver's JVM has collected, which a driver with memory to spare may put off until disks are full."""
    for _ in range(2):  # the first lets go of Python's handles, the second of what these held
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
