"""Energy used while a building is nearly empty.

Head counts take few distinct values, so the rows are first summed per (building, count).
Thresholds, shares and whole sweeps are then computed on that small profile: one scan and
one shuffle of partial sums, however many thresholds are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltloom.config import DEFAULT_RULES, Rules
from voltloom.functions.columns import half_even, kwh, ratio
from voltloom.operators.ranks import quantiles


def occupancy_profile(df: DataFrame, keys, extra=(), occupancy: str = "occupancy",
                      usable: str = "usable") -> DataFrame:
    """Counts, energy and power per (keys, extra, head count) over measured rows.

    Rows that do not qualify are kept as a NULL head count with n = 0, so a key where
    nothing qualifies still has a row.
    """
    o = F.col(occupancy)
    ok = F.col(usable) & o.isNotNull() & F.col("kwh").isNotNull()
    return (df.withColumn("_o", F.when(ok, o)).groupBy(*keys, *extra, F.col("_o").alias("occ"))
            .agg(F.count(F.when(ok, F.lit(1))).alias("n"),
                 F.sum(F.when(ok, F.col("kwh"))).alias("kwh"),
                 F.sum(F.when(ok, F.col("power_w"))).alias("power")))


def thresholds(profile: DataFrame, keys, fraction: float, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """p95 of the head count per key and the low-occupancy threshold."""
    have = profile.filter(F.col("occ").isNotNull())
    p = have.groupBy(*keys).agg(
        F.percentile("occ", F.lit(rules.low_percentile), F.col("n")).alias("p95_occupancy"))
    return p.withColumn("threshold", F.lit(fraction) * F.col("p95_occupancy"))


def _shares(profile: DataFrame, keys) -> DataFrame:
    """Aggregate a profile that carries a `threshold` column."""
    low = F.col("occ") <= F.col("threshold")
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = profile.groupBy(*keys).agg(
        F.first("threshold", True).alias("threshold"), F.first("p95_occupancy", True).alias("p95_occupancy"),
        zero(F.sum("n")).alias("intervals_total"),
        zero(F.sum(F.when(low, F.col("n")))).alias("intervals_low"),
        F.sum("kwh").alias("total_kwh"), F.sum(F.when(low, F.col("kwh"))).alias("_lk"),
        F.sum("power").alias("_p"), F.sum(F.when(low, F.col("power"))).alias("_lp"))
    some = F.col("intervals_total") > 0
    low_kwh = F.when(some, F.coalesce(F.col("_lk"), F.lit(0.0)))
    return out.select(
        *keys, "threshold", "p95_occupancy", "intervals_total", "intervals_low",
        ratio(100.0 * F.col("intervals_low"), F.col("intervals_total")).alias("pct_intervals_low"),
        "total_kwh", low_kwh.alias("low_occ_kwh"),
        ratio(100 * low_kwh, F.col("total_kwh")).alias("share_pct"),
        ratio(F.col("_lp"), F.col("intervals_low")).alias("mean_power_low_w"),
        ratio(F.col("_p"), F.col("intervals_total")).alias("mean_power_all_w"),
        (F.col("intervals_low") > 0).alias("reachable"))


def low_occupancy_share(df: DataFrame, keys=("building",), fraction: float | None = None,
                        occupancy: str = "occupancy", usable: str = "usable",
                        rules: Rules = DEFAULT_RULES) -> DataFrame:
    """The headline: share of measured energy used at or below fraction x p95 head count."""
    keys = list(keys)
    fraction = rules.low_fraction if fraction is None else fraction
    profile = occupancy_profile(df, keys, (), occupancy, usable)
    return _shares(profile.join(thresholds(profile, keys, fraction, rules), keys, "left"), keys)


def published_threshold(share: DataFrame) -> DataFrame:
    """The threshold other steps take over: rounded to two places, half to even."""
    return share.withColumn("threshold", half_even(F.col("threshold"), 2))


def sensitivity_curve(df: DataFrame, keys=("building",), fractions=None,
                      occupancy: str = "occupancy", rules: Rules = DEFAULT_RULES) -> DataFrame:
    """The share at every fraction of the sweep, from one profile."""
    keys = list(keys)
    fractions = rules.sweep if fractions is None else fractions
    profile = occupancy_profile(df, keys, (), occupancy)
    sweep = F.explode(F.array(*[F.lit(float(f)) for f in fractions]))
    at = (thresholds(profile, keys, 1.0, rules).withColumn("fraction_of_p95", sweep)
          .withColumn("threshold", F.col("fraction_of_p95") * F.col("p95_occupancy")))
    return _shares(profile.join(at, keys), [*keys, "fraction_of_p95"]).select(
        *keys, "fraction_of_p95", "threshold", "pct_intervals_low", "share_pct", "reachable")


def first_reachable_fraction(curve: DataFrame, keys=("building",)) -> DataFrame:
    return curve.groupBy(*keys).agg(
        F.min(F.when(F.col("reachable"), F.col("fraction_of_p95"))).alias("first_reachable"))


def intensity_ratio(share: DataFrame) -> DataFrame:
    """Mean power when nearly empty over mean power overall; NULL when unreachable."""
    return share.withColumn("intensity_ratio", F.when(
        F.col("reachable"), ratio(F.col("mean_power_low_w"), F.col("mean_power_all_w"))))


def out_of_hours_share(df: DataFrame, keys=("building",), open_hour: int = 8, close_hour: int = 18,
                       weekdays_only: bool = True) -> DataFrame:
    """Share of energy used outside working hours by the clock."""
    inside = (F.col("hour") >= open_hour) & (F.col("hour") < close_hour)
    if weekdays_only:
        inside = inside & ~F.col("is_weekend")
    ok = F.col("usable") & F.col("kwh").isNotNull()
    out = df.groupBy(*keys).agg(
        F.count_if(ok).alias("_n"), F.count_if(ok & ~inside).alias("_out"),
        F.sum(F.when(ok, F.col("kwh"))).alias("total_kwh"),
        F.sum(F.when(ok & ~inside, F.col("kwh"))).alias("_ok"))
    out_kwh = F.when(F.col("_n") > 0, F.coalesce(F.col("_ok"), F.lit(0.0)))
    return out.select(*keys, ratio(100.0 * F.col("_out"), F.col("_n")).alias("pct_intervals_out_of_hours"),
                      "total_kwh", out_kwh.alias("out_of_hours_kwh"),
                      ratio(100 * out_kwh, F.col("total_kwh")).alias("share_pct"))


def by_period(df: DataFrame, keys=("building",), fraction: float | None = None,
              rules: Rules = DEFAULT_RULES) -> DataFrame:
    """The share per period, with the threshold of the whole record."""
    keys = list(keys)
    fraction = rules.low_fraction if fraction is None else fraction
    profile = occupancy_profile(df, keys, ["period"]).filter(F.col("occ").isNotNull())
    return _shares(profile.join(thresholds(profile, keys, fraction, rules), keys), [*keys, "period"])


def supply_shares(table: DataFrame, supplies: DataFrame, fraction: float | None = None,
                  rules: Rules = DEFAULT_RULES) -> DataFrame:
    """The share of each supply of a building with at least two of them."""
    fraction = rules.low_fraction if fraction is None else fraction
    thr = thresholds(occupancy_profile(table, ["building"]), ["building"], fraction, rules)
    d = (supplies.filter("n_meters >= 2")
         .join(table.filter("usable").select("building", "ts", "occupancy"), ["building", "ts"]))
    per_count = d.groupBy("building", "role", "occupancy").agg(
        F.sum(kwh("power_w")).alias("kwh"), F.sum("power_w").alias("p"), F.count("power_w").alias("n"))
    low = F.col("occupancy") <= F.col("threshold")
    out = per_count.join(thr, "building").groupBy("building", "role").agg(
        F.sum("kwh").alias("total_kwh"),
        F.coalesce(F.sum(F.when(low, F.col("kwh"))), F.lit(0.0)).alias("low_occ_kwh"),
        ratio(F.sum("p"), F.sum("n")).alias("mean_power_w"),
        ratio(F.sum(F.when(low, F.col("p"))), F.sum(F.when(low, F.col("n")))).alias("mean_power_low_occ_w"))
    return out.withColumn("share_pct", ratio(100 * F.col("low_occ_kwh"), F.col("total_kwh")))


def night_minimum(df: DataFrame, keys=("building",), start_hour: int = 2, end_hour: int = 5) -> DataFrame:
    night = df.filter(F.col("usable") & F.col("hour").between(start_hour, end_hour))
    return quantiles(night, list(keys), "power_w", {"night_median_w": 0.5})


def occupancy_summary(df: DataFrame, keys=("building",), occupancy: str = "occupancy",
                      rules: Rules = DEFAULT_RULES) -> DataFrame:
    """The distribution facts behind the threshold, from one row per head count."""
    keys = list(keys)
    o = (df.filter(F.col(occupancy).isNotNull()).groupBy(*keys, F.col(occupancy).alias("occ"))
         .agg(F.count(F.lit(1)).alias("n")))
    q = o.groupBy(*keys).agg(
        F.percentile("occ", F.lit(0.5), F.col("n")).alias("median"),
        F.percentile("occ", F.lit(rules.low_percentile), F.col("n")).alias("p95"))
    q = q.withColumn("threshold", F.lit(rules.low_fraction) * F.col("p95"))
    low = F.sum(F.when(F.col("occ") <= F.col("threshold"), F.col("n")).otherwise(0))
    return o.join(q, keys).groupBy(*keys).agg(
        F.sum("n").alias("n"), F.min("occ").alias("min"), F.first("median").alias("median"),
        F.first("p95").alias("p95"), F.max("occ").alias("max"), F.first("threshold").alias("threshold"),
        low.alias("intervals_low_occ"), (100 * low / F.sum("n")).alias("pct_intervals_low_occ"),
        (low > 0).alias("threshold_reachable"))


def responsiveness_rank(table: DataFrame) -> DataFrame:
    """Rank buildings by the share of mean power above the base load; best first.

    The input is one row per building, so a global window is fine here.
    """
    share = ratio(100 * (F.col("mean_power_kw") - F.col("base_load_kw")), F.col("mean_power_kw"))
    return (table.withColumn("variable_share_pct", half_even(share, 1))
            .withColumn("responsiveness_rank", F.rank().over(
                Window.orderBy(F.col("variable_share_pct").desc_nulls_last()))))


def measured_rank(table: DataFrame, value: str = "intensity_ratio") -> DataFrame:
    """Ascending rank of the measured ratio; a missing one has no rank."""
    r = F.rank().over(Window.orderBy(F.col(value).asc_nulls_last()))
    return table.withColumn("measured_rank", F.when(F.col(value).isNotNull(), r))


def reliability_label(c: Column) -> Column:
    return F.when(F.abs(c) > 25, "NO -- extrapolated").otherwise("yes")
