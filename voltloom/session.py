"""Session helpers: the settings the operators rely on, and stage outputs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, which every executor can reach.

    A folder of our own is made only in local mode when the session names none; a cluster
    without one is an error, as each executor would write to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    master = spark.sparkContext.master
    if not named and not (master == "local" or master.startswith("local[")):
        raise ValueError("name a folder that all executors reach in spark.checkpoint.dir")
    if not named:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="voltloom-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a stage output to the shared folder and read it back.

    A table that several later branches read is computed once, survives the loss of
    executors, and is read back with column pruning and filter pushdown.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/voltloom/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)
