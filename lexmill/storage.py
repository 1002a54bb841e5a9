"""What the cluster shares: the folder for intermediate tables, and this package on the Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of the local machine only where that is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lexmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again."""
    path = f"{scratch_dir(spark)}/lexmill-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexmill_path = path
    return out


def once(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """df if it is a table made by written(), else df written."""
    return df if getattr(df, "_lexmill_path", None) else written(spark, df, label)


def discard(spark: SparkSession, *tables: DataFrame | None) -> None:
    """Delete tables made by written() that no later plan reads; other frames are left alone."""
    for df in tables:
        name = getattr(df, "_lexmill_path", None)
        if name:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session, wherever the driver imported it from."""
    context = spark.sparkContext
    if getattr(context, "_lexmill_sent", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="lexmill-"), "lexmill.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("lexmill", os.path.relpath(full, top)))
    context.addPyFile(path)
    context._lexmill_sent = True
