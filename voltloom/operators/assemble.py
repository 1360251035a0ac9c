"""Meters to buildings: the joins that make the hub table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltloom.config import BLOCKS_PER_HOUR, DEFAULT_RULES, METER_REGISTRY, Rules
from voltloom.functions.columns import cooling_degree_hours, kwh, ratio
from voltloom.operators import runs

FLAGS = ("meter_off", "is_missing", "was_interpolated", "outlier_iqr", "outlier_zscore")
PER_METER = ("power_w", "power_filled_w", "power_min_w", "power_max_w", *FLAGS, "n_readings")
MAINS_ONLY = ("voltage", "power_factor", "pf_neg_frac")
LONG_COLUMNS = (
    "building", "building_kind", "power_w", "occupancy", "kwh", "date", "hour", "weekday",
    "month", "year", "is_weekend", "is_vacation", "is_semester", "period", "is_working_day",
    "calendar_source", "meter_off", "is_missing", "usable", "outlier_iqr", "outlier_zscore",
    "power_lag_1h", "power_lag_1d", "power_roll24h_mean", "power_roll24h_std", "voltage",
    "power_factor", "temp_c", "relh", "cdh",
)


def meter_registry(spark) -> DataFrame:
    rows = [(m, b, role, kind) for m, b, role, kind, _ in METER_REGISTRY]
    return spark.createDataFrame(rows, "meter string, building string, role string, kind string")


def with_building(meters: DataFrame, registry: DataFrame) -> DataFrame:
    """Look up each meter's building, role and kind, and how many meters the building has."""
    size = registry.groupBy("building").agg(F.count(F.lit(1)).alias("n_meters"))
    return meters.join(registry.join(size, "building"), "meter")


def combine_meters(cleaned: DataFrame, registry: DataFrame, roles=("mains", "ups"),
                   mains: str = "mains") -> DataFrame:
    """One row per building and block from the union of its meters' blocks.

    A grouped aggregate does the full outer join of the meters: partial sums meet on
    (building, ts). The total is NULL unless every meter of the building has a filled
    value; flags are OR-ed, a missing row counting as false.
    """
    d = with_building(cleaned, registry)
    p = F.col("power_filled_w")
    aggs = [F.when(F.count(p) == F.max("n_meters"), F.sum(p)).alias("power_w"),
            F.when(F.count("power_w") == F.max("n_meters"), F.sum("power_w")).alias("power_raw_w")]
    aggs += [F.bool_or(F.coalesce(F.col(f), F.lit(False))).alias(f) for f in FLAGS]
    aggs += [F.max(F.when(F.col("role") == mains, F.col(c))).alias(c)
             for c in MAINS_ONLY if c in cleaned.columns]
    for role in roles:
        mine = F.col("role") == role
        aggs += [(F.bool_or if c in FLAGS else F.max)(F.when(mine, F.col(c))).alias(f"{c}_{role}")
                 for c in PER_METER if c in cleaned.columns]
    # Grouped by (building, ts) only, so the occupancy join finds its partitioning ready. The
    # kind is looked up afterwards: a text in the aggregate would force a sort-based one.
    kinds = registry.select("building", F.col("kind").alias("building_kind")).distinct()
    return d.drop("kind").groupBy("building", "ts").agg(*aggs).join(kinds, "building")


def supplies(cleaned: DataFrame, registry: DataFrame) -> DataFrame:
    """The long form: one row per building, supply role and block."""
    return with_building(cleaned, registry).select(
        "building", "role", "n_meters", "ts", "power_w", "power_filled_w")


def join_occupancy(combined: DataFrame, occupancy: DataFrame) -> DataFrame:
    return combined.join(occupancy.select("building", "ts", "occupancy"), ["building", "ts"])


def join_weather(merged: DataFrame, weather: DataFrame | None,
                 rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Left join: missing weather never drops a row; no weather at all gives NULL columns."""
    if weather is None:
        none = F.lit(None).cast("double")
        return merged.withColumns({"temp_c": none, "relh": none, "cdh": none})
    return (merged.join(weather.select("ts", "temp_c", "relh"), "ts", "left")
            .withColumn("cdh", cooling_degree_hours("temp_c", rules.cdh_base)))


def with_usable(df: DataFrame) -> DataFrame:
    return df.withColumn("usable", F.col("power_w").isNotNull() & ~F.col("meter_off")
                         & F.col("occupancy").isNotNull())


def building_stats(table: DataFrame) -> DataFrame:
    """Coverage and totals per building."""
    pct = lambda c: 100 * F.avg(c.cast("double"))
    use = F.col("usable")
    return table.groupBy("building").agg(
        F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first"), F.max("ts").alias("last"),
        F.count_if(use).alias("usable_rows"), pct(use).alias("pct_usable"),
        pct(F.col("power_w").isNull()).alias("pct_power_missing"),
        pct(F.col("occupancy").isNull()).alias("pct_occupancy_missing"),
        (F.count_if("meter_off") / BLOCKS_PER_HOUR).alias("hours_meter_off"),
        F.count_if("was_interpolated").alias("blocks_interpolated"),
        F.count_if("outlier_iqr").alias("outliers_iqr"),
        F.count_if("outlier_zscore").alias("outliers_zscore"),
        F.sum(F.when(use, F.col("kwh"))).alias("total_kwh"),
        F.avg(F.when(use, F.col("power_w"))).alias("mean_power_w"))


def data_quality(table: DataFrame, counters: DataFrame, registry: DataFrame) -> DataFrame:
    """Building statistics beside the summed raw-reading counters of its meters."""
    per_building = (counters.join(registry, "meter").groupBy("building").agg(
        F.count(F.lit(1)).alias("meters"), F.sum("voltage_invalid").alias("voltage_invalid"),
        F.sum("pf_negative").alias("pf_negative")))
    return building_stats(table).join(per_building, "building")


def cross_check(wide: DataFrame, columns: dict[str, list[str]], blocks: DataFrame,
                registry: DataFrame, tolerance_pct: float = 1.0) -> DataFrame:
    """Mean power per building from a wide file against our own blocks.

    The wide scan reads the named columns only; `a + b` is NULL unless both are there.
    """
    totals = []
    for building, cols in columns.items():
        total = sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
        totals.append(F.struct(F.lit(building).alias("building"), total.alias("w")))
    theirs = (wide.select(F.explode(F.array(*totals)).alias("t"))
              .groupBy(F.col("t.building").alias("building"))
              .agg(F.avg("t.w").alias("wide_mean_w")))
    ours = (with_building(blocks, registry).groupBy("building", "ts")
            .agg(F.when(F.count("power_w") == F.max("n_meters"), F.sum("power_w")).alias("w"))
            .groupBy("building").agg(F.avg("w").alias("our_mean_w")))
    diff = ratio(100 * F.abs(F.col("our_mean_w") - F.col("wide_mean_w")), F.col("wide_mean_w"))
    return (theirs.join(ours, "building").withColumn("difference_pct", diff)
            .withColumn("agrees", F.coalesce(F.col("difference_pct") < tolerance_pct, F.lit(False))))


def with_dead_meter_rule(blocks: DataFrame, registry: DataFrame, occupancy: DataFrame,
                         hours: float, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """What if the dead-meter rule asked for `hours` of zeros? Sums raw, unfilled power."""
    d = runs.flag_meter_off(blocks, ["meter"], min_blocks=int(round(hours * BLOCKS_PER_HOUR)),
                            rules=rules)
    combined = (with_building(d, registry).groupBy("building", "ts").agg(
        F.when(F.count("power_w") == F.max("n_meters"), F.sum("power_w")).alias("power_w"),
        F.bool_or("meter_off").alias("meter_off")))
    merged = join_occupancy(combined, occupancy).withColumn("kwh", kwh("power_w"))
    return with_usable(merged).withColumn("hour", F.hour("ts"))


def require_columns(df: DataFrame, required=LONG_COLUMNS) -> DataFrame:
    """The column contract of a stored stage: fail here, not far downstream."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"stored table lacks {missing}: rebuild it")
    return df
