"""Writers for stage tables, result tables and quality counters."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_stage(df: DataFrame, path: str, partition_by=("building",)) -> None:
    """Parquet per building; a re-build replaces only the partitions it produces."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_by).parquet(path))


def write_result(df: DataFrame, path: str, order_by=()) -> None:
    """A result table as CSV, sorted over its files; adaptive execution makes one file of a small one."""
    out = df.orderBy(*order_by) if order_by else df
    out.write.mode("overwrite").option("header", True).csv(path)


def write_counters(df: DataFrame, path: str) -> None:
    """One JSON line per meter with its quality counters, in as many files as the counters have parts."""
    df.write.mode("overwrite").json(path)
