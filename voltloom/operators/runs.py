"""Run-length rules on the grid: gaps, dead meters, short fills, outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltloom.config import BLOCK_SECONDS, BLOCKS_PER_HOUR, DEFAULT_RULES, Rules
from voltloom.functions.columns import right_closed_bucket
from voltloom.config import ZERO_RUN_BUCKETS
from voltloom.operators import ordered
from voltloom.operators.ordered import SEC, back_to_here, slice_window, sliced, unsliced, up_to_here
from voltloom.operators.ranks import quantiles


def gap_runs(df: DataFrame, keys, value: str, ts: str = "ts", name: str = "run_rows",
             rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Length in rows of the run (missing or present) that each row belongs to."""
    return ordered.run_lengths(df, list(keys), ts, F.col(value).isNull(), rules.segment_days, name)


def _fill_reach(limit: int) -> int:
    return (limit + 1) * BLOCK_SECONDS


def _fill(d: DataFrame, keys, source: Column, filled: str, was_filled: str, limit: int) -> DataFrame:
    """The fill rule on sliced rows; `d` must reach `_fill_reach` around its own rows."""
    w, x = slice_window(keys), F.col("_x")
    d = d.withColumns({"_x": source, "_pos": F.row_number().over(w).cast("bigint")})
    mark = F.when(x.isNotNull(), F.struct("_pos", SEC, "_x"))
    d = d.withColumns({"_prev": F.last(mark, True).over(up_to_here(w)),
                       "_next": F.last(mark, True).over(back_to_here(keys))})
    rows = F.col("_next._pos") - F.col("_prev._pos") - 1
    share = ((F.col(SEC) - F.col(f"_prev.{SEC}"))
             / (F.col(f"_next.{SEC}") - F.col(f"_prev.{SEC}")))
    line = F.col("_prev._x") + (F.col("_next._x") - F.col("_prev._x")) * share
    short = F.coalesce(x.isNull() & (rows <= limit), F.lit(False))
    # a row without a reading on both sides has no line, and `short` is false for it
    return (d.withColumns({"_new": F.when(short, line).otherwise(x), "_was": short}).drop(filled, was_filled)
            .withColumnsRenamed({"_new": filled, "_was": was_filled}).drop("_pos", "_prev", "_next", "_x"))


def fill_short_gaps(df: DataFrame, keys, value: str, filled: str, was_filled: str,
                    limit: int | None = None, ts: str = "ts", source: Column | None = None,
                    rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Fill a gap linearly in time only if the **whole** gap is at most `limit` rows.

    Longer gaps stay NULL throughout and nothing is extrapolated. The two readings around
    a short gap lie at most limit + 1 rows away, so a bounded look-around is exact; rows
    off the grid (raw weather stamps) only make the gap span less time.
    """
    keys = list(keys)
    limit = rules.fill_limit if limit is None else limit
    reach = _fill_reach(limit)
    d = sliced(df, ts, rules.segment_days, reach, reach)
    return unsliced(_fill(d, keys, F.col(value) if source is None else source, filled, was_filled, limit))


def _off_reach(need: int, bridge: int) -> int:
    return (need + 2 * (bridge + 1)) * BLOCK_SECONDS


def _off(d: DataFrame, keys, power_max: str, flag: str, need: int, bridge: int) -> DataFrame:
    """The dead-meter rule on sliced rows; `d` must reach `_off_reach` around its own rows."""
    w = slice_window(keys)
    before, after = up_to_here(w), back_to_here(keys)
    p = F.col(power_max)
    d = d.withColumns({"_pos": F.row_number().over(w).cast("bigint"), "_zero": F.coalesce(p == 0, F.lit(False))})
    mark = F.when(p.isNotNull(), F.struct("_pos", "_zero"))
    d = d.withColumns({"_prev": F.last(mark, True).over(before), "_next": F.last(mark, True).over(after)})
    bridged = (p.isNull() & F.col("_prev._zero") & F.col("_next._zero")
               & (F.col("_next._pos") - F.col("_prev._pos") - 1 <= bridge))
    d = d.withColumn("_in", F.col("_zero") | F.coalesce(bridged, F.lit(False)))
    stop = F.when(~F.col("_in"), F.col("_pos"))
    d = d.withColumns({
        "_from": F.coalesce(F.last(stop, True).over(before), F.first("_pos").over(before) - 1),
        "_to": F.coalesce(F.last(stop, True).over(after), F.first("_pos").over(after) + 1)})
    d = d.withColumn("_flag", F.col("_zero") & (F.col("_to") - F.col("_from") - 1 >= need)).drop(flag)
    return d.withColumnRenamed("_flag", flag).drop("_pos", "_zero", "_prev", "_next", "_in", "_from", "_to")


def flag_meter_off(df: DataFrame, keys, power_max: str = "power_max_w", flag: str = "meter_off",
                   min_blocks: int | None = None, bridge: int | None = None, ts: str = "ts",
                   rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Flag blocks in a run of at least `min_blocks` exact zeros.

    A gap of at most `bridge` blocks with zeros on both sides counts to the run's length;
    a missing block is never flagged itself. Whether a run reaches `min_blocks` is decided
    within that distance, so the look-around is bounded although runs are not.
    """
    keys = list(keys)
    need = rules.dead_blocks if min_blocks is None else min_blocks
    bridge = rules.fill_limit if bridge is None else bridge
    reach = _off_reach(need, bridge)
    return unsliced(_off(sliced(df, ts, rules.segment_days, reach, reach), keys, power_max, flag, need, bridge))


def zero_runs(df: DataFrame, keys, power_max: str = "power_max_w", ts: str = "ts",
              rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Every unbroken run of exact zeros with its length in hours; gaps break a run."""
    state = F.coalesce(F.col(power_max) == 0, F.lit(False))
    runs = ordered.run_table(df, list(keys), ts, state, rules.segment_days)
    return (runs.filter("state").drop("state")
            .withColumn("hours", F.col("rows") / BLOCKS_PER_HOUR))


def zero_run_buckets(runs: DataFrame, keys) -> DataFrame:
    """Runs per length bucket: count, total hours, share of all zero hours. Runs beyond the
    last bucket are a bucket of their own, so the shares are of all zero hours."""
    by = list(keys)
    beyond = F.when(F.col("hours") > ZERO_RUN_BUCKETS[-1][0], "beyond")
    out = (runs.withColumn("bucket", F.coalesce(right_closed_bucket("hours", ZERO_RUN_BUCKETS), beyond))
           .filter(F.col("bucket").isNotNull())
           .groupBy(*by, "bucket")
           .agg(F.count(F.lit(1)).alias("runs"), F.sum("hours").alias("total_hours")))
    total = out.groupBy(*by).agg(F.sum("total_hours").alias("_all"))
    return (out.join(total, by)
            .withColumn("share_pct", 100 * F.col("total_hours") / F.col("_all")).drop("_all"))


def zero_hours_split(runs: DataFrame, keys, hours: float = 24.0) -> DataFrame:
    return runs.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("hours") <= hours, F.col("hours"))), F.lit(0.0))
        .alias("short_hours"),
        F.coalesce(F.sum(F.when(F.col("hours") > hours, F.col("hours"))), F.lit(0.0))
        .alias("long_hours"))


def fences(df: DataFrame, keys, value: str, k: float = 1.5) -> DataFrame:
    """Tukey fences per key: q1, q3, low_fence, high_fence."""
    q = quantiles(df, list(keys), value, {"q1": 0.25, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    return (q.withColumn("low_fence", F.col("q1") - k * iqr)
            .withColumn("high_fence", F.col("q3") + k * iqr))


def outlier_limits(live: DataFrame, keys, value: str, rules: Rules = DEFAULT_RULES) -> DataFrame:
    keys = list(keys)
    m = live.groupBy(*keys).agg(F.count(value).alias("live_n"), F.avg(value).alias("live_mean"),
                                F.stddev_samp(value).alias("live_sd"))
    return m.join(fences(live, keys, value, rules.outlier_iqr_k), keys)


def flag_outliers(df: DataFrame, keys, value: str, live: Column,
                  rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Tukey and z-score flags over live rows; never deletes a row.

    `df` is read several times: pass a staged table.
    """
    keys = list(keys)
    lim = outlier_limits(df.filter(live).select(*keys, value), keys, value, rules)
    x = F.col(value)
    enough = live & (F.col("live_n") > rules.outlier_min_rows)
    out = (df.join(lim, keys, "left")
           .withColumn("outlier_iqr", F.coalesce(
               enough & ((x < F.col("low_fence")) | (x > F.col("high_fence"))), F.lit(False)))
           .withColumn("outlier_zscore", F.coalesce(
               enough & (F.col("live_sd") > 0)
               & (F.abs(x - F.col("live_mean")) / F.col("live_sd") > rules.outlier_z),
               F.lit(False))))
    return out.select(*df.columns, "outlier_iqr", "outlier_zscore")


def clean_rules(blocks: DataFrame, keys=("meter",), ts: str = "ts", rules: Rules = DEFAULT_RULES) -> DataFrame:
    """The grid rules before outliers: is_missing, meter_off, filled power, fill mark.

    Both rules share one slicing and hence one shuffle: the slices reach far enough for the
    dead-meter flags to be right wherever the fill rule looks.
    """
    keys = list(keys)
    need, limit = rules.dead_blocks, rules.fill_limit
    reach = _off_reach(need, limit) + _fill_reach(limit)
    d = _off(sliced(blocks, ts, rules.segment_days, reach, reach), keys, "power_max_w", "meter_off", need, limit)
    d = d.withColumn("is_missing", F.col("n_readings") == 0)
    return unsliced(_fill(d, keys, F.when(~F.col("meter_off"), F.col("power_w")),
                          "power_filled_w", "was_interpolated", limit))


def live_rows() -> Column:
    return ~F.col("meter_off") & F.col("power_w").isNotNull()


def clean_meters(blocks: DataFrame, keys=("meter",), rules: Rules = DEFAULT_RULES) -> DataFrame:
    return flag_outliers(clean_rules(blocks, keys, rules), keys, "power_w", live_rows(), rules)


def cleaning_stats(cleaned: DataFrame, keys=("meter",), rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Blocks, off hours, fills, outliers, fences and usable share per meter."""
    keys = list(keys)
    counts = cleaned.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("blocks"),
        F.count_if("is_missing").alias("blocks_missing"),
        F.count_if("meter_off").alias("blocks_meter_off"),
        (F.count_if("meter_off") / BLOCKS_PER_HOUR).alias("hours_meter_off"),
        F.count_if("was_interpolated").alias("blocks_interpolated"),
        F.count_if("outlier_iqr").alias("outliers_iqr"),
        F.count_if("outlier_zscore").alias("outliers_zscore"),
        (100 * F.avg((~F.col("is_missing") & ~F.col("meter_off")).cast("double")))
        .alias("pct_usable"))
    lim = outlier_limits(cleaned.filter(live_rows()).select(*keys, "power_w"), keys, "power_w", rules)
    enough = F.col("live_n") > rules.outlier_min_rows
    return counts.join(lim.select(
        *keys, F.when(enough, F.col("low_fence")).alias("iqr_low_fence_w"),
        F.when(enough, F.col("high_fence")).alias("iqr_high_fence_w")), keys, "left")
