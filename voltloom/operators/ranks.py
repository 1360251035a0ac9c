"""Exact quantiles, ranks and cumulative counts without sorting a group in one task.

Values are put in about 0.1 % wide bins by a fixed monotone rule, so counting per
(key, bin) is a map-side combined aggregate and gives every bin's rank offset. Only the
bins that matter are then looked into, each one on its own. A key with a third of all
rows is spread over thousands of bins; equal values are one counted row. A bin is sorted
whole unless it holds more than 65,536 values; such a bin, as of a steady voltage, is cut
into 1,024 parts that are sorted on their own, and only its parts are counted once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltloom.operators.ordered import up_to_here

BIN, PART, COUNT, SIZE = "_bin", "_part", "_count", "_size"
BINS_PER_OCTAVE, PARTS_PER_OCTAVE = 1 << 10, 1 << 20
LARGE_BIN = 1 << 16
_ONE_KEY = "_all"


def value_bin(v: Column, per_octave: int = BINS_PER_OCTAVE) -> Column:
    """Monotone in v: negative values below 0, zero at 0, positive values above."""
    size = F.floor(F.log2(F.abs(v)) * per_octave).cast("bigint") + 2_000 * per_octave
    return F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0).cast("bigint"))


def _counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct values per key with their counts, and the bin each lies in."""
    return (df.filter(F.col(value).isNotNull())
            .groupBy(*keys, F.col(value).cast("double").alias("_v"))
            .agg(F.count(F.lit(1)).alias(COUNT))
            .withColumn(BIN, value_bin(F.col("_v"))))


def _lower(values: DataFrame, by: list[str], totals: dict[str, str]) -> DataFrame:
    """Distinct values `_v` of bins `by`, with the totals of columns at lower values of the
    same bin: `totals` maps a column to the name of its total. `_size` bounds a bin's values.

    Where no bin is large the totals of parts are an empty table, and the join to it goes
    when the plan is adapted."""
    large = F.col(SIZE) > LARGE_BIN
    d = values.withColumn(PART, F.when(large, value_bin(F.col("_v"), PARTS_PER_OCTAVE)).otherwise(F.lit(0).cast("bigint")))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    over = before(Window.partitionBy(*by).orderBy(PART))  # a bin has 1,024 parts at most
    offsets = d.filter(large).groupBy(*by, PART).agg(*[F.sum(c).alias(f"_s_{c}") for c in totals]).select(*by, PART, *[
        F.sum(f"_s_{c}").over(over).alias(f"_p_{c}") for c in totals])
    inside = before(Window.partitionBy(*by, PART).orderBy("_v"))
    d = d.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_i_{c}") for c in totals])
    return d.join(offsets, [*by, PART], "left").select(*values.columns, *[
        (F.coalesce(F.col(f"_p_{c}"), F.lit(0)) + F.col(f"_i_{c}")).alias(n) for c, n in totals.items()])


def _bin_offsets(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    v = F.col(value).cast("double")
    per_bin = (df.filter(v.isNotNull()).groupBy(*keys, value_bin(v).alias(BIN))
               .agg(F.count(F.lit(1)).alias("_n")))
    by_key = Window.partitionBy(*keys)
    upto = F.sum("_n").over(up_to_here(by_key.orderBy(BIN)))
    return per_bin.select(*keys, BIN, (upto - F.col("_n")).alias("_before"),
                          upto.alias("_upto"), F.sum("_n").over(by_key).alias("_total"))


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles: one row per key, one column per name.

    Two column-pruned passes over `df`; the second keeps only the few bins that hold a
    wanted rank. NULL values are ignored, keys without any value are absent.
    """
    if not keys:
        return quantiles(df.withColumn(_ONE_KEY, F.lit(1)), [_ONE_KEY], value, probs).drop(_ONE_KEY)
    offsets = _bin_offsets(df, keys, value)
    wanted = F.explode(F.array(*[
        F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("p")) for n, p in probs.items()]))
    targets = (offsets.withColumn("_w", wanted)
               .withColumn("_h", (F.col("_total") - 1) * F.col("_w.p"))
               .filter((F.floor("_h") < F.col("_upto")) & (F.ceil("_h") >= F.col("_before"))))
    bins = targets.groupBy(*keys, BIN).agg(
        F.first("_before").alias("_before"), F.first(F.col("_upto") - F.col("_before")).alias(SIZE),
        F.collect_list(F.struct(F.col("_w.name").alias("name"), F.col("_h").alias("h")))
        .alias("_wanted"))  # at most one entry per requested quantile
    inside = (df.filter(F.col(value).isNotNull())
              .select(*keys, F.col(value).cast("double").alias("_v"))
              .withColumn(BIN, value_bin(F.col("_v")))
              .join(bins.select(*keys, BIN), [*keys, BIN], "left_semi")
              .groupBy(*keys, BIN, "_v").agg(F.count(F.lit(1)).alias(COUNT)))
    ranked = (_lower(inside.join(bins, [*keys, BIN]), [*keys, BIN], {COUNT: "_below"})
              .withColumn("_lo", F.col("_before") + F.col("_below"))
              .withColumn("_hi", F.col("_lo") + F.col(COUNT))
              .withColumn("_w", F.explode("_wanted")))
    at = lambda r: (r >= F.col("_lo")) & (r < F.col("_hi"))
    h = F.col("_w.h")
    aggs = []
    for n in probs:
        mine = F.col("_w.name") == n
        aggs += [F.max(F.when(mine & at(F.floor(h)), F.col("_v"))).alias(f"_{n}_lo"),
                 F.max(F.when(mine & at(F.ceil(h)), F.col("_v"))).alias(f"_{n}_hi"),
                 F.max(F.when(mine, h - F.floor(h))).alias(f"_{n}_f")]
    out = ranked.groupBy(*keys).agg(*aggs)
    return out.select(*keys, *[
        (F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_f")).alias(n)
        for n in probs])


def counted_quantiles(df: DataFrame, keys: list[str], value: str,
                      probs: dict[str, float]) -> DataFrame:
    """Exact quantiles of a column with few distinct values, such as head counts.

    One pass: what reaches the final aggregate is one row per distinct value.
    """
    v = (df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v"))
         .agg(F.count(F.lit(1)).alias(COUNT)))
    return v.groupBy(*keys).agg(*[
        F.percentile(F.col("_v"), F.lit(p), F.col(COUNT)).alias(n) for n, p in probs.items()])


def ranked_values(df: DataFrame, keys: list[str], value: str,
                  sums: dict[str, Column] | None = None) -> DataFrame:
    """Distinct values per key in order: `_v`, `_count`, `before` (rows below), and for
    each entry of `sums` its total at the value and its total at all lower values."""
    sums = sums or {}
    v = F.col(value).cast("double")
    at_value = (df.filter(v.isNotNull()).groupBy(*keys, v.alias("_v"))
                .agg(F.count(F.lit(1)).alias(COUNT),
                     *[F.sum(c).alias(n) for n, c in sums.items()])
                .withColumn(BIN, value_bin(F.col("_v"))))
    cols = {COUNT: "before", **{n: f"{n}_before" for n in sums}}
    per_bin = at_value.groupBy(*keys, BIN).agg(F.count(F.lit(1)).alias(SIZE), *[F.sum(c).alias(f"_b_{c}") for c in cols])
    below = (Window.partitionBy(*keys).orderBy(BIN) if keys else Window.orderBy(BIN))
    below = below.rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bin.select(*keys, BIN, SIZE, *[
        F.coalesce(F.sum(f"_b_{c}").over(below), F.lit(0)).alias(f"_o_{c}") for c in cols])
    out = _lower(at_value.join(offsets, [*keys, BIN]), [*keys, BIN], {c: f"_l_{c}" for c in cols})
    return out.select(*keys, "_v", *cols, *[
        (F.col(f"_o_{c}") + F.col(f"_l_{c}")).alias(b) for c, b in cols.items()])


def average_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct values with their 1-based average rank over ties: keys, _v, _count, rank."""
    r = ranked_values(df, keys, value)
    return r.select(*keys, "_v", COUNT,
                    (F.col("before") + (F.col(COUNT) + 1) / 2).alias("rank"))
