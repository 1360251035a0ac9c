"""Difference of two result tables, column by column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table_diff(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float = 1e-6) -> DataFrame:
    """One row per shared column: rows on one side only, NULL pattern, largest numeric
    difference or number of unequal texts, and a verdict. Rows are matched on `keys`."""
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    kinds = dict(left.dtypes)
    a = left.select(*keys, F.lit(True).alias("_l"), *[F.col(c).alias(f"l_{c}") for c in shared])
    b = right.select(*keys, F.lit(True).alias("_r"), *[F.col(c).alias(f"r_{c}") for c in shared])
    j = a.join(b, keys, "full_outer")
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    aggs = [F.count_if(F.col("_r").isNull()).alias("_only_l"), F.count_if(F.col("_l").isNull()).alias("_only_r")]
    for c in shared:
        x, y = F.col(f"l_{c}"), F.col(f"r_{c}")
        number = kinds[c] in ("double", "float", "int", "bigint", "smallint", "tinyint")
        aggs += [F.count_if(both & (x.isNull() != y.isNull())).alias(f"_n_{c}"),
                 (F.max(F.abs(x.cast("double") - y.cast("double"))) if number
                  else F.lit(None).cast("double")).alias(f"_d_{c}"),
                 (F.lit(0).cast("bigint") if number else F.count_if(both & ~x.eqNullSafe(y))).alias(f"_t_{c}")]
    s = j.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"_n_{c}").alias("null_mismatches"),
                     F.col(f"_d_{c}").alias("max_abs_diff"), F.col(f"_t_{c}").alias("text_mismatches"))
            for c in shared]
    out = s.select("_only_l", "_only_r", F.explode(F.array(*rows)).alias("_c")).select(
        F.col("_only_l").alias("only_left"), F.col("_only_r").alias("only_right"), "_c.*")
    same = ((F.col("only_left") == 0) & (F.col("only_right") == 0) & (F.col("null_mismatches") == 0)
            & (F.col("text_mismatches") == 0) & (F.coalesce(F.col("max_abs_diff"), F.lit(0.0)) <= tolerance))
    return out.withColumn("same", same)


def rows_only_in(left: DataFrame, right: DataFrame) -> DataFrame:
    """The exact case: rows of `left`, counted with repetition, that `right` lacks."""
    return left.exceptAll(right.select(*left.columns))
