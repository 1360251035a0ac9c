"""Calendar, energy, lag and rolling features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltloom.config import BLOCKS_PER_DAY, BLOCKS_PER_HOUR, DEFAULT_RULES, Rules
from voltloom.functions.columns import (
    in_vacation_window, kwh, period_name, ratio, weekday_name,
)
from voltloom.operators.ordered import DAY, SLICE, slice_window, sliced, unsliced


def add_calendar_features(df: DataFrame, calendar: DataFrame | None, ts: str = "ts") -> DataFrame:
    """Clock and calendar columns; a day the calendar lacks falls back to the windows.

    `calendar` holds one row per date (date, working_day, activity).
    """
    t = F.col(ts)
    d = df.withColumns({
        "hour": F.hour(t), "minute_of_day": F.hour(t) * 60 + F.minute(t),
        "month": F.month(t), "year": F.year(t), "date": F.to_date(t),
        "weekday": weekday_name(t), "day_of_week": F.weekday(F.to_date(t)),
        "is_weekend": F.weekday(F.to_date(t)) >= 5,
    })
    approx, weekend = in_vacation_window("date"), F.col("is_weekend")
    if calendar is None:
        d = d.withColumns({"is_vacation": approx, "is_working_day": ~weekend,
                           "calendar_source": F.lit("approximated")})
    else:
        cal = calendar.select("date", F.col("working_day").alias("_wd"), F.col("activity").alias("_act"))
        d = (d.join(cal, "date", "left").withColumns({
            "is_vacation": F.coalesce(F.col("_act") == "L", approx),
            "is_working_day": F.coalesce(F.col("_wd") == 1, ~weekend),
            "calendar_source": F.lit("official"),
        }).drop("_wd", "_act"))
    return d.withColumns({"is_semester": ~F.col("is_vacation"),
                          "period": period_name(F.col("is_vacation"))})


def add_history_features(df: DataFrame, keys=("building",), power: str = "power_w",
                         ts: str = "ts", rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Lags of 6 and 144 rows and the mean / sd of the 24 hours before each row.

    The grid is complete, so 144 rows are one day and a day of history is enough. A frame
    that slides is summed anew for every row; two frames that only grow, everything before
    the row less everything older than a day, give the same sums in one sweep. The values
    are centred on the slice's mean first, which keeps the difference of squares accurate.
    """
    keys = list(keys)
    w = slice_window(keys)
    p, x = F.col(power), F.col("_x")
    before = w.rangeBetween(Window.unboundedPreceding, -1)
    older = w.rangeBetween(Window.unboundedPreceding, -DAY - 1)
    day = lambda c: (F.coalesce(F.sum(c).over(before), F.lit(0.0)) - F.coalesce(F.sum(c).over(older), F.lit(0.0)))
    d = sliced(df, ts, rules.segment_days, back=DAY)
    d = d.withColumn("_c", F.avg(p).over(Window.partitionBy(*keys, SLICE))).withColumn("_x", p - F.col("_c"))
    d = d.withColumns({
        "power_lag_1h": F.lag(p, BLOCKS_PER_HOUR).over(w), "power_lag_1d": F.lag(p, BLOCKS_PER_DAY).over(w),
        "_n": F.count(p).over(before) - F.count(p).over(older), "_s": day(x), "_q": day(x * x)})
    n = F.col("_n")
    spread = ratio(F.col("_q") - ratio(F.col("_s") * F.col("_s"), n), n - 1)
    enough = n >= BLOCKS_PER_HOUR
    return unsliced(d.withColumns({
        "power_roll24h_mean": F.when(enough, F.col("_c") + ratio(F.col("_s"), n)),
        "power_roll24h_std": F.when(enough, F.sqrt(F.greatest(spread, F.lit(0.0)))),
    }).drop("_c", "_x", "_n", "_s", "_q"))


def add_all_features(df: DataFrame, calendar: DataFrame | None, power: str = "power_w",
                     rules: Rules = DEFAULT_RULES) -> DataFrame:
    d = add_history_features(df, power=power, rules=rules)
    return add_calendar_features(d, calendar).withColumn("kwh", kwh(power))


def calendar_agreement(stamps: DataFrame, calendar: DataFrame, ts: str = "ts") -> DataFrame:
    """How often the approximate windows agree with the calendar, over distinct days."""
    days = stamps.select(F.to_date(ts).alias("date")).distinct().join(calendar, "date")
    low, approx = F.col("activity") == "L", in_vacation_window("date")
    pct = lambda c: 100 * F.avg(c.cast("double"))
    return days.filter(F.col("activity").isNotNull()).agg(
        F.count(F.lit(1)).alias("days_compared"), pct(low == approx).alias("agreement_pct"),
        pct(low).alias("official_low_activity_pct"), pct(approx).alias("approximated_vacation_pct"))


def semester_check(occupancy: DataFrame, keys=("building",), ts: str = "ts") -> DataFrame:
    """Median occupancy in and out of the approximate vacation, and their ratio."""
    keys = list(keys)
    vac = in_vacation_window(ts)
    o = (occupancy.filter(F.col("occupancy").isNotNull()).withColumn("_vac", vac)
         .groupBy(*keys, "_vac", "occupancy").agg(F.count(F.lit(1)).alias("_n")))
    med = lambda c: F.percentile(F.when(c, F.col("occupancy")), F.lit(0.5), F.col("_n"))
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("_n"))), F.lit(0))
    out = o.groupBy(*keys).agg(
        med(~F.col("_vac")).alias("median_semester"), med(F.col("_vac")).alias("median_vacation"),
        n(~F.col("_vac")).alias("n_semester"), n(F.col("_vac")).alias("n_vacation"))
    return out.withColumn("ratio", F.when(F.col("median_semester") != 0,
                                          F.col("median_vacation") / F.col("median_semester")))


def monthly_occupancy(occupancy: DataFrame, keys=("building",), ts: str = "ts") -> DataFrame:
    o = (occupancy.filter(F.col("occupancy").isNotNull())
         .groupBy(*keys, F.month(ts).alias("month"), "occupancy").agg(F.count(F.lit(1)).alias("_n")))
    return o.groupBy(*keys, "month").agg(
        F.percentile("occupancy", F.lit(0.5), F.col("_n")).alias("median_occupancy"))
