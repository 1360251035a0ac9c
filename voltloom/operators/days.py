"""Days as observations: hourly vectors, principal components, day types."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltloom.config import (BLOCKS_PER_DAY, BLOCKS_PER_HOUR, EVENING_FROM, FLAT_SWING, LEVEL_NAMES, MORNING_BEFORE,
                             SHAPE_NAMES)
from voltloom.functions.columns import in_vacation_window, period_name, ratio, weekday_name
from voltloom.operators import clusters
from voltloom.operators.ranks import quantiles

HOURS = 24


def day_rows(df: DataFrame, keys=("building",), value: str = "power_w", ts: str = "ts",
             require_usable: bool = True) -> DataFrame:
    """One row per key and day: its 144 values in order and whether it is complete.

    A day's array has at most 144 entries. Days without all their blocks are the partial
    ones at the ends of the grid and are left out.
    """
    t = F.col(ts)
    block = ((F.hour(t) * 60 + F.minute(t)) / 10).cast("int")
    off = F.coalesce(F.col("meter_off"), F.lit(False)) if require_usable and "meter_off" in df.columns else F.lit(False)
    d = df.groupBy(*keys, F.to_date(t).alias("date")).agg(
        F.array_sort(F.collect_list(F.struct(block.alias("b"), F.col(value).alias("v")))).alias("_v"),
        F.count(F.lit(1)).alias("_n"), F.count(value).alias("_have"), F.bool_or(off).alias("_off"))
    return d.filter(F.col("_n") == BLOCKS_PER_DAY).select(
        *keys, "date", F.transform("_v", lambda s: s["v"]).alias("values"),
        ((F.col("_have") == BLOCKS_PER_DAY) & ~F.col("_off")).alias("complete"))


def array_mean(c: Column, start: int, length: int) -> Column:
    """Mean of a stretch of an array column (0-based start)."""
    return F.aggregate(F.slice(c, start + 1, length), F.lit(0.0), lambda a, x: a + x) / length


def hourly(days: DataFrame) -> DataFrame:
    """144 values to 24 hourly means."""
    v = F.col("values")
    hours = F.transform(F.sequence(F.lit(0), F.lit(HOURS - 1)), lambda h: F.aggregate(
        F.slice(v, h * BLOCKS_PER_HOUR + 1, BLOCKS_PER_HOUR), F.lit(0.0), lambda a, x: a + x) / BLOCKS_PER_HOUR)
    return days.withColumn("hours", hours).drop("values")


def night_and_midday(days: DataFrame) -> DataFrame:
    v = F.col("values")
    return days.withColumns({"night_w": array_mean(v, 0, 36), "midday_w": array_mean(v, 60, 24)})


def with_labels(days: DataFrame) -> DataFrame:
    """Calendar context of a day, with the approximate vacation windows."""
    vac = in_vacation_window("date")
    return days.withColumns({
        "weekday": weekday_name("date"), "day_of_week": F.weekday("date"), "is_weekend": F.weekday("date") >= 5,
        "month": F.month("date"), "year": F.year("date"), "is_vacation": vac, "period": period_name(vac)})


def standardise(hourly_days: DataFrame, keys=("building",)) -> DataFrame:
    """Centre and scale each hour by its mean and sample sd; a constant hour is left unscaled.

    Days that are not complete are left out, as their hours would count in one sum and not in another.
    """
    keys = list(keys)
    if "complete" in hourly_days.columns:
        hourly_days = hourly_days.filter("complete")
    h = [F.get("hours", i) for i in range(HOURS)]
    s = hourly_days.groupBy(*keys).agg(
        F.array(*[F.avg(c) for c in h]).alias("_mu"), F.array(*[F.stddev_samp(c) for c in h]).alias("_sd"),
        F.count(F.lit(1)).alias("_days"))
    one = lambda sd: F.when(sd > 0, sd).otherwise(1.0)
    z = F.transform("hours", lambda x, i: (x - F.get("_mu", i)) / one(F.get("_sd", i)))
    return hourly_days.join(s, keys).withColumn("z", z).drop("_mu", "_sd", "_days")


def principal_components(scaled: DataFrame, keys=("building",)) -> DataFrame:
    """Loadings of all components per key, one row per component.

    The 24 x 24 sums of products are partial aggregates over the days; only that small
    matrix is decomposed, in one Arrow group per key. The sign makes the first loading
    that is not 0 positive.
    """
    keys = list(keys)
    kinds = dict(scaled.dtypes)
    z = [F.get("z", i) for i in range(HOURS)]
    upper = [(i, j) for i in range(HOURS) for j in range(i, HOURS)]
    g = scaled.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                                  F.array(*[F.sum(z[i] * z[j]) for i, j in upper]).alias("g"))
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys]
                       + ["component int", "eigenvalue double", "share double", "cumulative double", "loadings array<double>"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        cov = np.zeros((HOURS, HOURS))
        for (i, j), v in zip(upper, pdf["g"].iloc[0]):
            cov[i, j] = cov[j, i] = v
        values, vectors = np.linalg.eigh(cov / max(int(pdf["n"].iloc[0]) - 1, 1))
        order = np.argsort(values)[::-1]
        values, vectors = values[order], vectors[:, order]
        share = values / values.sum()
        rows = []
        for c in range(HOURS):
            w = vectors[:, c]
            lead = w[np.flatnonzero(np.abs(w) > 1e-12)[0]]
            rows.append([*[pdf[k].iloc[0] for k in keys], c + 1, float(values[c]), float(share[c]),
                         float(share[: c + 1].sum()), (w if lead > 0 else -w).tolist()])
        return pd.DataFrame(rows, columns=[*keys, "component", "eigenvalue", "share", "cumulative", "loadings"])

    return g.groupBy(*keys).applyInPandas(solve, schema)


def align_signs(a: DataFrame, b: DataFrame, keys=("building",)) -> DataFrame:
    """Flip the components of `a` that point away from those of `b`."""
    other = b.select(*keys, "component", F.col("loadings").alias("_b"))
    dot = F.aggregate(F.zip_with("loadings", "_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return (a.join(other, [*keys, "component"]).withColumn("_d", dot)
            .withColumn("loadings", F.when(F.col("_d") < 0, F.transform("loadings", lambda x: -x)).otherwise(F.col("loadings")))
            .drop("_b", "_d"))


def day_scores(scaled: DataFrame, components: DataFrame, k: int = 3, keys=("building",)) -> DataFrame:
    """Scores on the first k components (`pc1`..) and the reconstruction error from them.

    Loadings are orthonormal, so what k components miss is |z|^2 less the squared scores.
    """
    keys = list(keys)
    top = components.filter(F.col("component") <= k).groupBy(*keys).agg(*[
        F.max(F.when(F.col("component") == c, F.col("loadings"))).alias(f"_l{c}") for c in range(1, k + 1)])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    d = scaled.join(top, keys).withColumns({f"pc{c}": dot("z", f"_l{c}") for c in range(1, k + 1)})
    rest = dot("z", "z") - sum((F.col(f"pc{c}") * F.col(f"pc{c}") for c in range(1, k + 1)), F.lit(0.0))
    return d.withColumn("reconstruction_error", F.sqrt(F.greatest(rest, F.lit(0.0)) / HOURS)).drop(
        *[f"_l{c}" for c in range(1, k + 1)])


def scree(components: DataFrame, first: int = 6) -> DataFrame:
    return components.filter(F.col("component") <= first).select(
        *[c for c in components.columns if c not in ("loadings",)])


def loading_summary(components: DataFrame, keys=("building",), first: int = 3) -> DataFrame:
    """Per component: one sign or mixed, and the hours of its largest and smallest weight."""
    d = components.filter(F.col("component") <= first).select(
        *keys, "component", F.posexplode("loadings").alias("hour", "w"))
    return d.groupBy(*keys, "component").agg(
        (F.bool_and(F.col("w") > 0) | F.bool_and(F.col("w") < 0)).alias("same_sign"),
        F.max_by("hour", "w").alias("peak_hour"), F.min_by("hour", "w").alias("trough_hour"))


def unusual_days(scores: DataFrame, n: int = 10) -> DataFrame:
    return scores.orderBy(F.col("reconstruction_error").desc(), "building", "date").limit(n)


def error_threshold(scores: DataFrame, keys=("building",), prob: float = 0.99) -> DataFrame:
    return quantiles(scores, list(keys), "reconstruction_error", {"p99": prob})


def day_types(scores: DataFrame, k: int = 4, seed: int = 42, features=("pc1", "pc2", "pc3"), keys=("building",)) -> DataFrame:
    """k-means over the component scores of each key, which share that key's basis; `cluster` per day."""
    return clusters.k_means(scores, keys, features, "date", k, seed)[0]


def mean_profile(days: DataFrame, by) -> DataFrame:
    """Average hourly profile per group, as an array, with the number of days."""
    return days.groupBy(*by).agg(F.count(F.lit(1)).alias("days"),
                                 F.array(*[F.avg(F.get("hours", i)) for i in range(HOURS)]).alias("profile"))


def name_clusters(profiles: DataFrame, cluster: str = "cluster", keys=()) -> DataFrame:
    """Plain names from overall level, night-to-day swing and peak hour (a row per key and cluster)."""
    p = F.col("profile")
    night, day = array_mean(p, 0, 6), array_mean(p, 9, 9)
    d = profiles.withColumns({
        "level_w": array_mean(p, 0, HOURS), "night_floor_w": night, "midday_w": array_mean(p, 10, 4),
        "swing": F.when(night > 0, ratio(day - night, night)).otherwise(F.lit(float("inf"))),
        "peak_hour": F.array_position(p, F.array_max(p)).cast("int") - 1})
    every = Window.partitionBy(*keys)  # a key has a handful of clusters
    rank, of = F.row_number().over(every.orderBy("level_w", cluster)), F.count(F.lit(1)).over(every)
    level = F.lit(LEVEL_NAMES["top"])
    for place in ("third", "second"):
        level = F.when((of > 3) & (rank == {"third": 3, "second": 2}[place]), LEVEL_NAMES[place]).otherwise(level)
    level = F.when(rank == 1, LEVEL_NAMES["bottom"]).otherwise(level)
    shape = (F.when(F.col("swing") < FLAT_SWING, SHAPE_NAMES["flat"]).when(F.col("peak_hour") < MORNING_BEFORE, SHAPE_NAMES["morning"])
             .when(F.col("peak_hour") >= EVENING_FROM, SHAPE_NAMES["evening"]).otherwise(SHAPE_NAMES["daytime"]))
    return d.withColumn("name", F.concat(level, F.lit(" load, "), shape))


def day_type_summary(days: DataFrame, cluster: str = "cluster", keys=("building",)) -> DataFrame:
    """One row per key and day type: name, days, mean / night / midday power, weekend and vacation share."""
    keys = list(keys)
    pct = lambda c: (100 * F.avg(F.col(c).cast("double"))).alias(f"pct_{c[3:]}")
    extra = days.groupBy(*keys, cluster).agg(pct("is_weekend"), pct("is_vacation"))
    return (name_clusters(mean_profile(days, [*keys, cluster]), cluster, keys).join(extra, [*keys, cluster])
            .drop("profile", "swing", "peak_hour"))


def mean_day_shape(days: DataFrame, keys=("building",), min_days: int = 30) -> DataFrame:
    """Average day of each key divided by its own mean; a key with few complete days has one row,
    its days and a reason."""
    keys = list(keys)
    whole = days.groupBy(*keys).agg(F.count_if("complete").alias("days"))
    enough = F.col("days") >= min_days
    d = whole.join(mean_profile(days.filter("complete"), keys).drop("days"), keys, "left").withColumn("profile", F.when(enough, F.col("profile")))
    level = array_mean(F.col("profile"), 0, HOURS)
    return (d.withColumn("_m", level).select(*keys, "days", "_m", F.posexplode_outer("profile").alias("hour", "mean_w"))
            .withColumn("relative", ratio(F.col("mean_w"), F.col("_m"))).drop("_m")
            .withColumn("reason", F.when(~enough, F.lit(f"fewer than {min_days} complete days"))))


def complete_days(days: DataFrame, keys=("building",)) -> DataFrame:
    return days.groupBy(*keys).agg(F.count_if("complete").alias("complete_days"), F.count(F.lit(1)).alias("days"))
