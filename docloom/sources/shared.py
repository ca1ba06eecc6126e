"""Folders of tables in a store that the driver and all executors share, through Spark's own file systems."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under spark.checkpoint.dir, removed when the driver's JVM ends; without that setting a folder of
    this machine serves, which only a local master can share with its executors."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    path = f"{found.rstrip('/')}/docloom-{name}-{uuid.uuid4().hex}"
    where, system = at(spark, path)
    system.deleteOnExit(where)
    return path


def at(spark: SparkSession, path: str):
    """Hadoop path and file system of a name."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, system = at(spark, path)
    return system.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    where, system = at(spark, path)
    system.delete(where, True)


def renamed(spark: SparkSession, path: str, to: str) -> bool:
    """Whether ``path`` got the name ``to``; a name in use is not taken."""
    where, system = at(spark, path)
    target = at(spark, to)[0]
    if system.exists(target):
        return False
    system.mkdirs(target.getParent())
    return system.rename(where, target)


def names(spark: SparkSession, path: str) -> list[str]:
    where, system = at(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(where)) if system.exists(where) else []


def write_json(spark: SparkSession, path: str, value) -> bool:
    """Write under another name first, so that nobody reads a half; False if ``path`` is there already."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    where, system = at(spark, part)
    out = system.create(where, True)
    out.write(json.dumps(value).encode())
    out.close()
    if renamed(spark, part, path):
        return True
    system.delete(where, False)
    return False


def read_json(spark: SparkSession, path: str):
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
