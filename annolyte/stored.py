"""Tables written to a folder that driver and executors share, and read again."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or else the context's checkpoint folder, which driver and executors share.

    Where a session has neither, a folder below /tmp/checkpoints in local mode; on a cluster that is an error, as executors
    can't see each other's disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = set_dir.get() if set_dir.isDefined() else None
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = f"file:///tmp/checkpoints/{os.getpid()}"
    return named.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again.

    This cuts the lineage as checkpoint() does, but computes df once and survives lost executors.
    The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)
