"""Raw readings to ten-minute blocks on a gap-free grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltloom.config import DEFAULT_RULES, READINGS_PER_BLOCK, Rules
from voltloom.functions.columns import block_start, day_start, ratio

OPTIONAL = ("voltage", "current", "frequency", "power_factor")


def invalidate(readings: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Impossible power and voltage become NULL; the power factor loses its sign.

    The raw power stays as `power_raw`, so that what the source lacks and what the range
    rule rejects can be counted apart.
    """
    have = set(readings.columns)
    p = F.col("power")
    out = (readings.withColumn("power_raw", p)
           .withColumn("power", F.when((p >= 0) & (p <= rules.power_max_w), p)))
    if "voltage" in have:
        v = F.col("voltage")
        out = (out.withColumn("voltage_bad", F.coalesce(
                   (v < rules.voltage_min) | (v > rules.voltage_max), F.lit(False)))
               .withColumn("voltage", F.when(~F.col("voltage_bad"), v)))
    if "power_factor" in have:
        pf = F.col("power_factor")
        out = (out.withColumn("pf_negative", F.coalesce(pf < 0, F.lit(False)))
               .withColumn("power_factor", F.abs(pf)))
    return out


def reading_counters(invalidated: DataFrame, keys=("meter",)) -> DataFrame:
    """Quality counters of the raw readings, one row per meter."""
    have = set(invalidated.columns)
    raw, p = F.col("power_raw"), F.col("power")
    n = lambda c: F.count_if(c).cast("bigint")
    return invalidated.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows_read"),
        n(raw.isNull()).alias("power_missing_in_source"),
        n(raw.isNotNull() & p.isNull()).alias("power_invalid"),
        n(p.isNull()).alias("power_missing"),
        n(p == 0).alias("power_zero"),
        (n(F.col("voltage_bad")) if "voltage" in have else F.lit(0)).alias("voltage_invalid"),
        (n(F.col("pf_negative")) if "power_factor" in have else F.lit(0)).alias("pf_negative"),
        (n(F.col("current").isNull()) if "current" in have else F.lit(0)).alias("current_missing"),
    )


def aggregate_blocks(invalidated: DataFrame, keys=("meter",), ts: str = "ts") -> DataFrame:
    """Mean, min, max and count per block; a block without a valid reading is NULL.

    Partial aggregates are merged by the engine, so a block that is split over input
    files comes out exact.
    """
    have = [c for c in OPTIONAL if c in invalidated.columns]
    aggs = [F.avg("power").alias("power_w"), F.min("power").alias("power_min_w"),
            F.max("power").alias("power_max_w"), F.count("power").cast("int").alias("n_readings")]
    aggs += [F.avg(c).alias(c) for c in have]
    if "power_factor" in have:
        aggs.append(ratio(F.count_if("pf_negative").cast("double"), F.count("power_factor"))
                    .alias("pf_neg_frac"))
    return invalidated.groupBy(*keys, block_start(ts).alias("ts")).agg(*aggs)


def grid(extent: DataFrame, keys) -> DataFrame:
    """Every block from `first` to `last` of each key.

    Days are exploded and spread first, blocks after, so a long series is not made by
    one task.
    """
    step = F.make_dt_interval(mins=F.lit(10))
    day = F.explode(F.sequence(day_start("first"),
                               day_start("last"),
                               F.make_dt_interval(days=F.lit(1)))).alias("_day")
    days = extent.select(*keys, "first", "last", day).repartition(*keys, "_day")
    return (days.select(*keys, F.explode(F.sequence(
                F.greatest(F.col("_day"), F.col("first")),
                F.least(F.col("_day") + F.make_dt_interval(hours=F.lit(23), mins=F.lit(50)),
                        F.col("last")), step)).alias("ts")))


def complete_grid(blocks: DataFrame, keys=("meter",), zero_counts=("n_readings",)) -> DataFrame:
    """Missing blocks between a key's first and last become explicit NULL rows."""
    keys = list(keys)
    extent = blocks.groupBy(*keys).agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    out = grid(extent, keys).join(blocks, [*keys, "ts"], "left")
    for c in zero_counts:
        if c in blocks.columns:
            out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0)))
    return out.select(*blocks.columns)


def block_counters(blocks: DataFrame, keys=("meter",)) -> DataFrame:
    n = F.col("n_readings")
    return blocks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("blocks_10min"),
        F.count_if(n == 0).alias("blocks_missing"),
        F.count_if((n > 0) & (n < READINGS_PER_BLOCK)).alias("blocks_partial"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def meter_blocks(readings: DataFrame, keys=("meter",), rules: Rules = DEFAULT_RULES) -> DataFrame:
    """All meters at once: clean, aggregate, complete."""
    return complete_grid(aggregate_blocks(invalidate(readings, rules), keys), keys)


def occupancy_blocks(counts: DataFrame, keys=("building",), tie: str | None = None) -> DataFrame:
    """Occupancy on the grid: floor each stamp, keep the earliest row of a block.

    `moved` rows are counted by `moved_rows`, not dropped silently.
    """
    keys = list(keys)
    order = F.struct("ts", tie) if tie else F.col("ts")
    snapped = (counts.groupBy(*keys, block_start("ts").alias("_block"))
               .agg(F.min_by(F.col("occupancy").cast("double"), order).alias("occupancy"))
               .withColumnRenamed("_block", "ts"))
    return complete_grid(snapped, keys, ())


def moved_rows(counts: DataFrame, keys=("building",)) -> DataFrame:
    return counts.groupBy(*keys).agg(
        F.count_if(F.col("ts") != block_start("ts")).alias("moved"),
        F.count(F.lit(1)).alias("rows_read"))
