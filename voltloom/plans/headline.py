"""The answer tables: one row per building, joined from the share, fit and night results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltloom.config import DEFAULT_RULES, Rules
from voltloom.functions.columns import corrected_occupancy, ratio
from voltloom.operators import waste


def headline_table(table: DataFrame, coefs: DataFrame, fraction: float | None = None,
                   rules: Rules = DEFAULT_RULES) -> DataFrame:
    """`coefs` is model A fitted on the training stretch; buildings without one keep NULLs."""
    share = waste.intensity_ratio(waste.low_occupancy_share(table, fraction=fraction, rules=rules))
    size = table.groupBy("building", "building_kind").agg(F.count(F.lit(1)).alias("_rows"))
    fit = coefs.select("building", "a_base_load_w", "b_watts_per_occupant")
    d = size.join(share, "building", "left").join(fit, "building", "left")
    return d.select(
        "building", "building_kind", "threshold",
        ratio(100.0 * F.col("intervals_total"), F.col("_rows")).alias("coverage_pct"),
        "total_kwh", "low_occ_kwh", "share_pct", "pct_intervals_low",
        (F.col("mean_power_all_w") / 1000).alias("mean_power_kw"),
        (F.col("mean_power_low_w") / 1000).alias("mean_power_low_kw"), "intensity_ratio",
        (F.col("a_base_load_w") / 1000).alias("base_load_kw"),
        F.col("b_watts_per_occupant").alias("watts_per_occupant"))


def base_load_table(table: DataFrame, coefs: DataFrame) -> DataFrame:
    """The fitted base load beside the measured night-time median and mean of the record."""
    mean = table.filter("usable").groupBy("building").agg((F.avg("power_w") / 1000).alias("mean_power_kw"))
    d = (coefs.select("building", (F.col("a_base_load_w") / 1000).alias("base_load_kw"))
         .join(waste.night_minimum(table), "building").join(mean, "building")
         .withColumn("night_kw", F.col("night_median_w") / 1000).drop("night_median_w"))
    gap = F.col("base_load_kw") - F.col("night_kw")
    return d.withColumns({
        "difference_kw": gap, "difference_pct": 100 * ratio(gap, F.col("night_kw")),
        "base_load_pct_of_mean": 100 * ratio(F.col("base_load_kw"), F.col("mean_power_kw"))})


def responsiveness_table(table: DataFrame, coefs: DataFrame, fraction: float | None = None,
                         rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Modelled and measured ranks side by side, with the extrapolation warning."""
    base = base_load_table(table, coefs)
    share = waste.intensity_ratio(waste.low_occupancy_share(table, fraction=fraction, rules=rules))
    d = waste.measured_rank(waste.responsiveness_rank(base).join(share.select("building", "intensity_ratio"), "building"))
    return d.select("building", "variable_share_pct", "responsiveness_rank", "intensity_ratio", "measured_rank",
                    waste.reliability_label(F.col("difference_pct")).alias("model_a_reliable"))


def kind_summary(headline: DataFrame) -> DataFrame:
    return headline.groupBy("building_kind").agg(
        F.count("building").alias("buildings"), F.avg("share_pct").alias("mean_share_pct"),
        F.avg("intensity_ratio").alias("mean_intensity_ratio"), F.avg("base_load_kw").alias("mean_base_load_kw"),
        F.sum("total_kwh").alias("total_kwh"))


def clock_against_occupancy(table: DataFrame, fraction: float | None = None,
                            rules: Rules = DEFAULT_RULES) -> DataFrame:
    clock = waste.out_of_hours_share(table).select(
        "building", F.col("share_pct").alias("clock_share_pct"), "pct_intervals_out_of_hours")
    occ = waste.low_occupancy_share(table, fraction=fraction, rules=rules).select(
        "building", F.col("share_pct").alias("occupancy_share_pct"), "pct_intervals_low")
    return clock.join(occ, "building")


def corrected_comparison(table: DataFrame, baseline: Column, fraction: float | None = None,
                         rules: Rules = DEFAULT_RULES) -> DataFrame:
    """The share on raw counts against the share on counts less the idle devices."""
    t = table.withColumn("occupancy_corrected", corrected_occupancy("occupancy", baseline))
    keep = lambda p, o: waste.low_occupancy_share(t, fraction=fraction, occupancy=o, rules=rules).select(
        "building", F.col("threshold").alias(f"{p}_threshold"), F.col("share_pct").alias(f"{p}_share_pct"))
    return keep("raw", "occupancy").join(keep("corrected", "occupancy_corrected"), "building").withColumn(
        "change_pp", F.coalesce("corrected_share_pct", F.lit(0.0)) - F.coalesce("raw_share_pct", F.lit(0.0)))


def dead_meter_comparison(tables: dict[str, DataFrame], fraction: float | None = None,
                          rules: Rules = DEFAULT_RULES) -> DataFrame:
    """The share under each named version of the table, all in one plan."""
    cols = ["building", "usable", "occupancy", "kwh", "power_w"]
    both = None
    for name, t in tables.items():
        part = t.select(*cols, F.lit(name).alias("rule"))
        both = part if both is None else both.unionByName(part)
    s = waste.low_occupancy_share(both, ["building", "rule"], fraction, rules=rules)
    return s.select("building", "rule", F.col("intervals_total").alias("usable_intervals"), "total_kwh", "share_pct")
