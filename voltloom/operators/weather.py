"""Outdoor conditions on the grid, and how much power they explain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltloom.config import DEFAULT_RULES, Rules, TEMPERATURE_BANDS
from voltloom.functions.columns import block_start, cooling_degree_hours, left_closed_band, ratio
from voltloom.operators.blocks import grid
from voltloom.operators.runs import fill_short_gaps


def parse_station(rows: DataFrame) -> DataFrame:
    """Station text to ts, temp_c, relh; 'M', 'T', '' and other bad text become NULL.

    Rows without a stamp are dropped. Of rows with one stamp the one with most readings stays,
    then the one with a temperature, then the lowest values; scans have no file order to go by.
    """
    holes = F.col("temp_c").isNull().cast("int") + F.col("relh").isNull().cast("int")
    number = lambda c: F.expr(f"try_cast({c} AS double)")
    return (rows.select(F.expr("try_cast(valid AS timestamp_ntz)").alias("ts"),
                        number("tmpc").alias("temp_c"), number("relh").alias("relh"))
            .filter(F.col("ts").isNotNull())
            .groupBy("ts").agg(F.min(F.struct(holes.alias("holes"), F.col("temp_c").isNull().alias("no_temp"), "temp_c", "relh")).alias("_r"))
            .select("ts", "_r.temp_c", "_r.relh"))


def weather_grid(stamps: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Raw stamps to the ten-minute grid; a gap is filled if it is short in **rows** of
    the union of stamps and grid."""
    step = F.make_dt_interval(mins=F.lit(10))
    top = F.when(block_start("last") == F.col("last"), F.col("last")).otherwise(block_start("last") + step)
    extent = (stamps.agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
              .select(block_start("first").alias("first"), top.alias("last")))
    every = grid(extent, []).select("ts").unionByName(stamps.select("ts")).distinct()
    d = every.join(stamps, "ts", "left")
    for c in ("temp_c", "relh"):
        d = fill_short_gaps(d, [], c, c, "_was", rules.weather_fill_limit, rules=rules).drop("_was")
    return d.filter(F.col("ts") == block_start("ts"))


def coverage(weather: DataFrame, intervals: DataFrame) -> DataFrame:
    """Share of the analysis intervals that have a temperature, and its range."""
    seen = intervals.select("ts").distinct().join(weather.select("ts", "temp_c"), "ts", "left")
    return seen.agg(F.count(F.lit(1)).alias("intervals"), F.count("temp_c").alias("with_temperature"),
                    ratio(100.0 * F.count("temp_c"), F.count(F.lit(1))).alias("pct_covered"),
                    F.min("temp_c").alias("min_temp_c"), F.max("temp_c").alias("max_temp_c"))


def monthly_temperature(weather: DataFrame) -> DataFrame:
    return weather.groupBy(F.month("ts").alias("month")).agg(
        F.avg("temp_c").alias("mean_c"), F.min("temp_c").alias("min_c"), F.max("temp_c").alias("max_c"))


def temperature_response(df: DataFrame, keys, power: str = "power_w", temp: str = "temp_c",
                         bands=TEMPERATURE_BANDS, min_rows: int = 200) -> DataFrame:
    """Mean power per temperature band, hot against mild, and the correlation. A band with
    `min_rows` rows or fewer is NULL; `n_outside` counts rows outside all bands, which take
    part in the other columns."""
    p, t = F.col(power), F.col(temp)
    d = df.filter(p.isNotNull() & t.isNotNull())
    aggs = []
    for lo, hi in bands:
        inside = (t >= lo) & (t < hi)
        aggs.append(F.when(F.count_if(inside) > min_rows, F.avg(F.when(inside, p)))
                    .alias(f"band_{lo}_{hi}"))
    hot, mild = F.avg(F.when(t >= 30, p)), F.avg(F.when(t.between(15, 25), p))
    outside = F.count_if((t < bands[0][0]) | (t >= bands[-1][1])).alias("n_outside")
    return d.groupBy(*keys).agg(*aggs, outside, (100 * (ratio(hot, mild) - 1)).alias("hot_vs_mild_pct"),
                                F.corr(p, t).alias("r_power_temp"))


def band_means(df: DataFrame, keys, power: str = "power_w", temp: str = "temp_c",
               bands=TEMPERATURE_BANDS) -> DataFrame:
    """Long form: one row per key and band, with an open band at either end. The bands do not
    overlap, so the range join to them is a CASE."""
    lo, hi = bands[0][0], bands[-1][1]
    ends = F.when(F.col(temp) < lo, f"below {lo}C").when(F.col(temp) >= hi, f"from {hi}C")
    return (df.withColumn("band", F.coalesce(left_closed_band(temp, bands), ends)).filter(F.col("band").isNotNull())
            .groupBy(*keys, "band").agg(F.count(power).alias("n"), F.avg(power).alias("mean_power_w")))


def period_at_matched_temperature(df: DataFrame, keys, lo: float = 28, hi: float = 34) -> DataFrame:
    d = df.filter(F.col("temp_c").isNotNull())
    inside = F.col("temp_c").between(lo, hi)
    return d.groupBy(*keys, "period").agg(
        F.count("power_w").alias("n"), F.avg("power_w").alias("mean_power_w"),
        F.avg("temp_c").alias("mean_temp_c"),
        F.count(F.when(inside, F.col("power_w"))).alias("n_matched"),
        F.avg(F.when(inside, F.col("power_w"))).alias("mean_power_matched_w"))


def period_gap(summary: DataFrame, keys) -> DataFrame:
    at = lambda p, c: F.max(F.when(F.col("period") == p, F.col(c)))
    gap = lambda c: 100 * (ratio(at("vacation", c), at("semester", c)) - 1)
    return summary.groupBy(*keys).agg(gap("mean_power_w").alias("raw_gap_pct"),
                                      gap("mean_power_matched_w").alias("matched_gap_pct"))


def _per_base(bases, build) -> Column:
    return F.array(*[F.struct(F.lit(float(b)).alias("base_c"), *build(b)) for b in bases])


def fit_base_temperature(df: DataFrame, keys, power: str = "power_w", temp: str = "temp_c",
                         rules: Rules = DEFAULT_RULES, min_rows: int = 100) -> DataFrame:
    """Changepoint fit: the base temperature whose cooling-degree regression fits best.

    One pass: every candidate base is a handful of aggregates over the same rows, and the
    candidates are laid out as rows only after aggregation.
    """
    keys = list(keys)
    p = F.col(power)
    d = df.filter(p.isNotNull() & F.col(temp).isNotNull())
    x = {b: cooling_degree_hours(temp, float(b)) for b in rules.cdh_scan}
    aggs = [F.count(F.lit(1)).alias("n")]
    for b, c in x.items():
        aggs += [F.max(c).alias(f"_max{b}"), F.regr_slope(p, c).alias(f"_s{b}"),
                 F.regr_intercept(p, c).alias(f"_i{b}"), F.regr_r2(p, c).alias(f"_r{b}")]
    fits = (d.groupBy(*keys).agg(*aggs).withColumn("_f", F.explode(_per_base(x, lambda b: [
        F.col(f"_max{b}").alias("top"), F.col(f"_s{b}").alias("slope"),
        F.col(f"_i{b}").alias("intercept"), F.col(f"_r{b}").alias("r2")])))
            .select(*keys, "n", "_f.*"))
    ok = (F.col("top") > 0) & (F.col("n") >= min_rows) & F.col("r2").isNotNull()
    pick = [F.when(ok, F.col(c)).alias(c) for c in ("base_c", "r2", "slope", "intercept")]
    fits = fits.withColumn("r2", F.when(ok, F.col("r2")))
    best = (fits.groupBy(*keys).agg(
        F.max_by(F.struct(*pick), F.when(ok, F.struct("r2", -F.col("base_c")))).alias("_best"),
        F.max("n").alias("n")))
    return best.select(*keys, "n", "_best.base_c", "_best.r2",
                       F.col("_best.slope").alias("slope_w_per_degree_hour"),
                       F.col("_best.intercept").alias("intercept_w"))


TOO_FEW = "too few low-occupancy intervals"
NEVER_WARM = "no warm intervals to fit against"
CONFOUNDED = "cooling response not identifiable: fitted slope is not positive"


def decompose_low_occupancy(df: DataFrame, low: Column, keys, power: str = "power_w",
                            temp: str = "temp_c", rules: Rules = DEFAULT_RULES,
                            min_rows: int = 500) -> DataFrame:
    """Split low-occupancy power into a weather part and a schedule part.

    The model is power ~ cooling degree hours + hour dummies. Its slope is the ratio of
    the within-hour cross products and squares, so one aggregate per (key, hour) is all
    the fit needs, for all candidate bases at once. A key without rows under the mask
    `low` still gets its (blank) row.
    """
    keys = list(keys)
    ok = (low & F.col(power).isNotNull() & F.col(temp).isNotNull() & F.col("hour").isNotNull())
    d = df.select(*keys, F.when(ok, F.col("hour")).alias("hour"),
                  F.when(ok, F.col(power)).alias("_p"), F.when(ok, F.col(temp)).alias("_t"))
    p = F.col("_p")
    x = {b: cooling_degree_hours("_t", float(b)) for b in rules.cdh_scan}
    aggs = [F.count(p).alias("n"), F.sum(p).alias("sy"), F.regr_syy(p, p).alias("wyy")]
    for b, c in x.items():
        aggs += [F.max(c).alias(f"_max{b}"), F.sum(c).alias(f"_sx{b}"),
                 F.regr_sxx(p, c).alias(f"_xx{b}"), F.regr_sxy(p, c).alias(f"_xy{b}")]
    hours = d.groupBy(*keys, "hour").agg(*aggs)
    bases = hours.withColumn("_f", F.explode(_per_base(x, lambda b: [
        F.col(f"_max{b}").alias("top"), F.col(f"_sx{b}").alias("sx"),
        F.col(f"_xx{b}").alias("xx"), F.col(f"_xy{b}").alias("xy")])))
    f = bases.groupBy(*keys, F.col("_f.base_c").alias("base_c")).agg(
        F.sum("n").alias("n"), F.sum("sy").alias("sy"), F.sum("wyy").alias("wyy"),
        F.sum(ratio(F.col("sy") * F.col("sy"), F.col("n"))).alias("between"),
        F.max("_f.top").alias("top"), F.sum("_f.sx").alias("sx"),
        F.sum("_f.xx").alias("xx"), F.sum("_f.xy").alias("xy"))
    slope = F.coalesce(F.when(F.col("xx") > 0, ratio(F.col("xy"), F.col("xx"))), F.lit(0.0))
    sst = F.col("wyy") + F.col("between") - ratio(F.col("sy") * F.col("sy"), F.col("n"))
    f = (f.withColumn("slope", slope)
         .withColumn("r2", F.when(sst > 0, 1 - ratio(F.col("wyy") - F.col("slope") * F.col("xy"), sst))
                     .otherwise(1.0))
         .withColumn("mean_cdh", ratio(F.col("sx"), F.col("n"))))
    ok = (F.col("top") > 0) & (F.col("n") >= min_rows)
    best = f.groupBy(*keys).agg(
        F.max("n").alias("n"), ratio(F.max("sy"), F.max("n")).alias("mean_power_w"),
        F.max_by(F.when(ok, F.struct("base_c", "r2", "slope", "mean_cdh")),
                 F.when(ok, F.struct("r2", -F.col("base_c")))).alias("_b"))
    fitted, good = F.col("_b").isNotNull(), F.coalesce(F.col("_b.slope") > 0, F.lit(False))
    w = F.when(good, F.col("_b.slope") * F.col("_b.mean_cdh"))
    return best.select(
        *keys, "n", F.col("_b.base_c").alias("base_c"), F.col("_b.r2").alias("r2"),
        F.when(fitted, F.col("mean_power_w") / 1000).alias("mean_power_kw"),
        ((F.col("mean_power_w") - w) / 1000).alias("schedule_kw"),
        (w / 1000).alias("weather_kw"), ratio(100 * w, F.col("mean_power_w")).alias("weather_share_pct"),
        F.col("_b.slope").alias("slope_w_per_degree_hour"),
        F.when(good, F.col("_b.mean_cdh")).alias("mean_cdh"), good.alias("identifiable"),
        F.when(F.col("n") < min_rows, TOO_FEW).when(~fitted, NEVER_WARM)
        .when(~good, CONFOUNDED).otherwise("").alias("reason"))
