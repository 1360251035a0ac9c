"""Coverage, load profiles and drift: what the data look like over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltloom.config import BLOCK_SECONDS, DEFAULT_RULES, Rules, WEEKDAYS
from voltloom.functions.columns import days_in_month, half_even, month_label, month_start, ratio, wall_seconds
from voltloom.operators.ordered import DAY, SLICE, SEC, slice_of
from voltloom.operators.ranks import counted_quantiles, quantiles
from voltloom.operators.samples import sample


def _pct(c: Column) -> Column:
    return 100 * F.avg(F.coalesce(c, F.lit(False)).cast("double"))


def step_gaps(df: DataFrame, keys, sec: Column, rules: Rules = DEFAULT_RULES,
              usual: int = 60) -> DataFrame:
    """Steps longer than `usual` seconds between neighbouring stamps, and the longest.

    Steps inside a time slice are counted there; the step from one slice to the next needs
    only each slice's first and last stamp.
    """
    keys = list(keys)
    d = df.select(*keys, sec.alias(SEC)).withColumn(SLICE, slice_of(F.col(SEC), rules.segment_days))
    step = F.col(SEC) - F.lag(SEC).over(Window.partitionBy(*keys, SLICE).orderBy(SEC))
    per = d.withColumn("_step", step).groupBy(*keys, SLICE).agg(
        F.min(SEC).alias("_a"), F.max(SEC).alias("_b"), F.max("_step").alias("_s"),
        F.count_if(F.col("_step") > usual).alias("_g"))
    over = F.col("_a") - F.lag("_b").over(Window.partitionBy(*keys).orderBy(SLICE))
    return per.withColumn("_over", over).groupBy(*keys).agg(
        (F.sum("_g") + F.count_if(F.col("_over") > usual)).alias("gaps"),
        F.greatest(F.max("_s"), F.max("_over")).alias("largest_gap_s"))


def profile_readings(readings: DataFrame, keys=("meter",), ts: str = "ts",
                     rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Coverage, gaps and quality of the raw readings, one row per meter."""
    keys = list(keys)
    have = set(readings.columns)
    s, p = wall_seconds(ts), F.col("power")
    aggs = [F.count(F.lit(1)).alias("rows"), F.min(ts).alias("first"), F.max(ts).alias("last"),
            F.min(s).alias("_a"), F.max(s).alias("_b"), F.min(p).alias("power_min_w"),
            F.avg(p).alias("power_mean_w"), F.max(p).alias("power_max_w"),
            _pct(p == 0).alias("power_zero_pct"), _pct(p.isNull()).alias("power_na_pct")]
    if "power_factor" in have:
        f = F.col("power_factor")
        aggs += [_pct(f < 0).alias("pf_negative_pct"), F.min(f).alias("pf_min"), F.max(f).alias("pf_max")]
    if "voltage" in have:
        v = F.col("voltage")
        aggs += [_pct((v < rules.voltage_min) | (v > rules.voltage_max)).alias("voltage_out_of_range_pct"),
                 F.min(v).alias("voltage_min"), F.max(v).alias("voltage_max")]
    if "current" in have:
        aggs.append(_pct(F.col("current").isNull()).alias("current_na_pct"))
    d = readings.groupBy(*keys).agg(*aggs)
    expected = half_even((F.col("_b") - F.col("_a")) / 60 + 1).cast("bigint")
    d = (d.withColumn("span_days", F.floor((F.col("_b") - F.col("_a")) / DAY) + 1)
         .withColumn("expected_minutes", expected)
         .withColumn("row_coverage_pct", ratio(100.0 * F.col("rows"), F.col("expected_minutes")))
         .drop("_a", "_b"))
    gaps = step_gaps(readings, keys, s, rules)
    return d.join(gaps.select(*keys, F.col("gaps").alias("gaps_over_1min"),
                              (F.col("largest_gap_s") / 3600).alias("largest_gap_hours")), keys)


def profile_occupancy(counts: DataFrame, keys=("building",), ts: str = "ts",
                      rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Coverage and distribution of the raw occupancy rows, one row per building."""
    keys = list(keys)
    s, o = wall_seconds(ts), F.col("occupancy")
    q = counted_quantiles(counts, keys, "occupancy", {"occ_p05": 0.05, "occ_median": 0.5, "occ_p95": 0.95})
    q = q.withColumn("low_occ_threshold", F.lit(rules.low_fraction) * F.col("occ_p95"))
    d = counts.join(q, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.min(ts).alias("first"), F.max(ts).alias("last"),
        (F.floor((F.max(s) - F.min(s)) / BLOCK_SECONDS) + 1).alias("expected_10min_steps"),
        (F.floor((F.max(s) - F.min(s)) / DAY) + 1).alias("span_days"),
        F.min(o).alias("occ_min"), F.first("occ_p05").alias("occ_p05"),
        F.first("occ_median").alias("occ_median"), F.avg(o).alias("occ_mean"),
        F.first("occ_p95").alias("occ_p95"), F.max(o).alias("occ_max"),
        F.first("low_occ_threshold").alias("low_occ_threshold"),
        _pct(o <= F.col("low_occ_threshold")).alias("pct_rows_at_or_below_threshold"),
        F.bool_and(s % BLOCK_SECONDS == 0).alias("aligned_to_10min"))
    return d.withColumn("row_coverage_pct", ratio(100.0 * F.col("rows"), F.col("expected_10min_steps")))


def monthly_coverage(df: DataFrame, keys, readings_per_day: int, ts: str = "ts") -> DataFrame:
    """Percent of the readings a month should hold, capped at 100."""
    m = df.groupBy(*keys, month_start(ts).alias("month")).agg(F.count(F.lit(1)).alias("readings"))
    return m.withColumn("coverage_pct", F.least(F.lit(100.0), 100.0 * F.col("readings") / (
        days_in_month("month") * readings_per_day)))


def month_span(monthly: DataFrame) -> list[str]:
    """All months from the first to the last of the table, as 'yyyy-MM': one small row is read."""
    span = monthly.agg(F.expr("transform(sequence(min(month), max(month), interval 1 month), m -> date_format(m, 'yyyy-MM'))"))
    return span.first()[0] or []


def coverage_matrix(monthly: DataFrame, source: str, months: list[str] | None = None) -> DataFrame:
    """Sources x months, by default all of the table's span; a month without any reading is NULL."""
    months = month_span(monthly) if months is None else months
    return (monthly.withColumn("_m", month_label("month")).groupBy(source)
            .pivot("_m", months).agg(F.first("coverage_pct")))


def blank_months(monthly: DataFrame, months: list[str] | None, source: str) -> DataFrame:
    """Months of a source that are absent or below 1 %: how many, first and last. By default
    the months are all of the table's span."""
    months = month_span(monthly) if months is None else months
    every = F.explode(F.array(*[F.to_date(F.lit(f"{m}-01")) for m in months])).alias("month")
    d = (monthly.select(source).distinct().select(source, every)
         .join(monthly.select(source, "month", "coverage_pct"), [source, "month"], "left"))
    return (d.filter(F.col("coverage_pct").isNull() | (F.col("coverage_pct") < 1))
            .groupBy(source).agg(F.count(F.lit(1)).alias("blank_months"),
                                 F.min("month").alias("first_blank"), F.max("month").alias("last_blank")))


def status_coverage(status: DataFrame, meters: list[str], ts: str = "ts") -> DataFrame:
    """Monthly mean of wide 0/1 presence flags, in percent, one row per month and meter."""
    long = status.unpivot([ts], meters, "meter", "present")
    return long.groupBy(month_start(ts).alias("month"), "meter").agg(
        (100 * F.avg("present")).alias("coverage_pct"))


def low_coverage(monthly: DataFrame, below: float = 50.0) -> DataFrame:
    return monthly.filter(F.col("coverage_pct") < below)


def overlap_window(energy: DataFrame, occupancy: DataFrame) -> DataFrame:
    """Where both records exist: latest first stamp to earliest last stamp."""
    e = energy.agg(F.min("first").alias("a"), F.max("last").alias("b"))
    o = occupancy.agg(F.min("first").alias("a"), F.max("last").alias("b"))
    return e.unionByName(o).agg(F.max("a").alias("start"), F.min("b").alias("end"))


def drift(df: DataFrame, keys, value: str, year: Column, other: str | None = None) -> DataFrame:
    """Yearly count and mean, percent against the first year, optional yearly correlation."""
    keys = list(keys)
    aggs = [F.count(value).alias("n"), F.avg(value).alias("mean")]
    if other:
        aggs.append(F.corr(value, other).alias("r"))
    y = df.groupBy(*keys, year.alias("year")).agg(*aggs)
    # one row per key and year by now
    first = F.first("mean").over(Window.partitionBy(*keys).orderBy("year"))
    return y.withColumn("vs_first_year_pct", 100 * (ratio(F.col("mean"), first) - 1))


def drift_wide(yearly: DataFrame, keys, years: list[int]) -> DataFrame:
    """Years side by side, with the growth from the first to the last one present."""
    at = lambda y, c: F.max(F.when(F.col("year") == y, F.col(c)))
    growth = 100 * (ratio(F.max_by("mean", "year"), F.min_by("mean", "year")) - 1)
    return yearly.groupBy(*keys).agg(
        *[at(y, "mean").alias(f"mean_{y}") for y in years], growth.alias("growth_pct"),
        at(years[0], "r").alias(f"r_{years[0]}"), at(years[-1], "r").alias(f"r_{years[-1]}"))


def mean_by(df: DataFrame, row: str, column: str, values: list, value: str = "power_w",
            usable: str | None = "usable") -> DataFrame:
    """Mean of `value`, one column per entry of `values`."""
    d = df.filter(usable) if usable else df
    return d.groupBy(row).pivot(column, values).agg(F.avg(value))


def summary_by(df: DataFrame, keys) -> DataFrame:
    u = df.filter("usable")
    a = u.groupBy(*keys).agg(F.count(F.lit(1)).alias("intervals"), F.avg("power_w").alias("mean_power_w"),
                             F.sum("kwh").alias("total_kwh"), F.avg("occupancy").alias("mean_occupancy"))
    return a.join(quantiles(u, list(keys), "power_w", {"median_power_w": 0.5}), list(keys))


def daily_energy(df: DataFrame, keys=("building",)) -> DataFrame:
    return df.filter("usable").groupBy(*keys, "date").agg(F.sum("kwh").alias("kwh"))


def mean_daily_energy(df: DataFrame, keys=("building",)) -> DataFrame:
    return daily_energy(df, keys).groupBy(*keys).agg(F.avg("kwh").alias("mean_daily_kwh"))


def energy_share(df: DataFrame, keys=("building",)) -> DataFrame:
    """Each key's share of all measured energy; the total is taken over one row per key."""
    e = df.filter("usable").groupBy(*keys).agg(F.sum("kwh").alias("kwh"))
    return e.withColumn("share_pct", ratio(100 * F.col("kwh"), F.sum("kwh").over(Window.partitionBy())))


def value_counts(df: DataFrame, *by) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def weekday_counts(df: DataFrame, weekday: str = "weekday") -> DataFrame:
    """Counts with the calendar order as an explicit key."""
    order = F.array_position(F.array(*[F.lit(d) for d in WEEKDAYS]), F.col(weekday))
    return value_counts(df, weekday).withColumn("day_order", order.cast("bigint"))


def histogram(df: DataFrame, keys, value: str, bins: int = 60) -> DataFrame:
    """Equal-width bins between each key's smallest and largest value, empty ones left out."""
    keys = list(keys)
    lim = df.groupBy(*keys).agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    lim = lim.withColumn("_w", (F.col("_b") - F.col("_a")) / bins)
    at = F.least(F.lit(bins - 1), F.coalesce(F.floor(ratio(F.col(value) - F.col("_a"), F.col("_w"))), F.lit(0)))
    d = df.filter(F.col(value).isNotNull()).join(lim, keys)
    return (d.groupBy(*keys, at.cast("bigint").alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.first("_a").alias("_a"), F.first("_w").alias("_w"))
            .select(*keys, "bin", "n", (F.col("_a") + F.col("bin") * F.col("_w")).alias("left_edge")))


def box_statistics(df: DataFrame, keys, value: str) -> DataFrame:
    """Quartiles and Tukey whiskers: the outermost values inside the fences."""
    keys = list(keys)
    q = quantiles(df, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    v = F.col(value)
    inside = v.between(F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr)
    return df.filter(v.isNotNull()).join(q, keys).groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in ("q1", "median", "q3")],
        F.min(F.when(inside, v)).alias("low_whisker"), F.max(F.when(inside, v)).alias("high_whisker"),
        F.count_if(~inside).alias("outside"))


def plot_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """A reproducible random subsample of n rows, those of the lowest hashes."""
    return sample(df, [key], n, seed=seed)


def clip_at(df: DataFrame, keys, value: str, prob: float = 0.999) -> DataFrame:
    """Cap values at a per-key quantile for display; `above` marks the capped rows."""
    q = quantiles(df, list(keys), value, {"cap": prob})
    v = F.col(value)
    return (df.join(q, list(keys), "left").withColumn("above", F.coalesce(v > F.col("cap"), F.lit(False)))
            .withColumn(f"{value}_clipped", F.least(v, F.col("cap"))))


def month_nearest_half(df: DataFrame, keys, flag: Column, ts: str = "ts") -> DataFrame:
    """The month whose mean flag is closest to one half (the earliest on a tie)."""
    keys = list(keys)
    m = df.groupBy(*keys, month_start(ts).alias("month")).agg(F.avg(flag.cast("double")).alias("mean_flag"))
    best = F.min_by(F.struct("month", "mean_flag"), F.struct(F.abs(F.col("mean_flag") - 0.5), F.col("month")))
    g = m.groupBy(*keys) if keys else m.groupBy()
    return g.agg(best.alias("_b")).select(*keys, "_b.month", "_b.mean_flag")


def time_slice(df: DataFrame, start, end, ts: str = "ts") -> DataFrame:
    """Label slice: both ends are included."""
    return df.filter(F.col(ts).between(start, end))


def padded_slice(df: DataFrame, windows: DataFrame, key: str, hours: int, ts: str = "ts") -> DataFrame:
    """Rows from `hours` before each window's start to `hours` after its end.

    The windows are matched on key and day first, so the range test sees few rows.
    """
    pad = F.make_dt_interval(hours=F.lit(hours))
    w = windows.select(key, (F.col("start") - pad).alias("_from"), (F.col("end") + pad).alias("_to"))
    days = F.sequence(F.to_date("_from"), F.to_date("_to"))
    w = w.withColumn("_day", F.explode(days))
    return (df.withColumn("_day", F.to_date(ts)).join(w, [key, "_day"])
            .filter(F.col(ts).between(F.col("_from"), F.col("_to"))).drop("_day", "_from", "_to"))


def window_kpis(scored: DataFrame, keys, start, end, ts: str = "ts") -> DataFrame:
    """Key figures of a date window against the whole record, with the ageing warning."""
    keys = list(keys)
    inside = F.col(ts).between(start, end)
    hit = F.col("band") == "ANOMALY"
    w = lambda c: F.when(inside, c)
    d = scored.groupBy(*keys).agg(
        F.count_if(inside).alias("intervals"), F.count_if(inside & hit).alias("flagged"),
        (100 * F.avg(w(hit.cast("double")))).alias("window_rate_pct"),
        (100 * F.avg(hit.cast("double"))).alias("overall_rate_pct"),
        F.count_if(inside & F.col("low_occupancy")).alias("low_occupancy_intervals"),
        F.avg(w(F.col("temp_c"))).alias("temp_mean_c"), F.min(w(F.col("temp_c"))).alias("temp_min_c"),
        F.max(w(F.col("temp_c"))).alias("temp_max_c"),
        (F.sum(w(F.col("power_w"))) / 1000 * (10 / 60)).alias("window_kwh"))
    r, o = F.col("window_rate_pct"), F.col("overall_rate_pct")
    return d.withColumn("drift_warning", F.coalesce((o > 0) & (r > F.greatest(3 * o, F.lit(5.0))), F.lit(False)))


def versus_peers(table: DataFrame, value: str = "intensity_ratio") -> DataFrame:
    """Distance of each row from the median of all rows, in points (one row per building)."""
    med = F.median(value).over(Window.partitionBy())
    return (table.withColumn("peer_median", med)
            .withColumn("vs_median_pts", 100 * (F.col(value) - F.col("peer_median"))))
