"""Descriptive statistics, correlations and group comparisons."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltloom.functions.columns import effect_label, half_even, ratio, unbiased_skew
from voltloom.functions.tails import normal_cdf, normal_pvalue, t_pvalue
from voltloom.operators.ranks import COUNT, average_ranks, quantiles, ranked_values


def mode_binned(df: DataFrame, keys, value: str, width: float = 1000.0) -> DataFrame:
    """Most common bin of `width`; the lowest bin wins a tie."""
    keys = list(keys)
    bins = (df.filter(F.col(value).isNotNull())
            .groupBy(*keys, (half_even(F.col(value) / width) * width + 0.0).alias("mode"))
            .agg(F.count(F.lit(1)).alias("_n")))
    top = F.max_by(F.struct("mode", "_n"), F.struct(F.col("_n"), -F.col("mode")))
    return bins.groupBy(*keys).agg(top.alias("_t")).select(
        *keys, "_t.mode", F.col("_t._n").alias("mode_count"))


def describe(df: DataFrame, keys, value: str, mode_width: float | None = None) -> DataFrame:
    """The full descriptive table, one row per key."""
    keys = list(keys)
    v = F.col(value)
    a = df.filter(v.isNotNull()).groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"),
        (F.max(v) - F.min(v)).alias("range"), F.var_samp(v).alias("variance"),
        F.stddev_samp(v).alias("std"), unbiased_skew(value).alias("skew"))
    q = quantiles(df, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    out = a.join(q, keys).withColumn("iqr", F.col("q3") - F.col("q1"))
    return out.join(mode_binned(df, keys, value, mode_width), keys) if mode_width else out


def spearman(df: DataFrame, keys, x: str, y: str) -> DataFrame:
    """Correlation of average ranks, on the distinct (x, y) pairs with their counts."""
    keys = list(keys)
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    pairs = d.groupBy(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).agg(
        F.count(F.lit(1)).alias("_w"))
    rx = average_ranks(d, keys, x).select(*keys, F.col("_v").alias("_x"), F.col("rank").alias("_rx"))
    ry = average_ranks(d, keys, y).select(*keys, F.col("_v").alias("_y"), F.col("rank").alias("_ry"))
    r = pairs.join(rx, [*keys, "_x"]).join(ry, [*keys, "_y"])
    n, half = F.sum("_w"), lambda c: F.col(c) * F.col("_w")
    m = r.groupBy(*keys).agg(n.alias("n"), F.sum(half("_rx")).alias("sx"), F.sum(half("_ry")).alias("sy"),
                             F.sum(half("_rx") * F.col("_rx")).alias("xx"),
                             F.sum(half("_ry") * F.col("_ry")).alias("yy"),
                             F.sum(half("_rx") * F.col("_ry")).alias("xy"))
    cov = F.col("xy") - ratio(F.col("sx") * F.col("sy"), F.col("n"))
    vx = F.col("xx") - ratio(F.col("sx") * F.col("sx"), F.col("n"))
    vy = F.col("yy") - ratio(F.col("sy") * F.col("sy"), F.col("n"))
    return m.select(*keys, ratio(cov, F.sqrt(vx * vy)).alias("spearman_r"))


def correlation(df: DataFrame, keys, x: str, y: str, min_rows: int = 100,
                p_values: bool = False) -> DataFrame:
    """Pearson, Spearman and r squared of every key; with under `min_rows` complete rows they
    are NULL and `reason` says so."""
    keys = list(keys)
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a = df.groupBy(*keys).agg(F.count_if(both).alias("n"), F.corr(F.when(both, F.col(x)), F.when(both, F.col(y))).alias("pearson_r"))
    enough = F.col("n") >= min_rows
    out = a.join(spearman(df.filter(both), keys, x, y), keys, "left").withColumns(
        {r: F.when(enough, F.col(r)) for r in ("pearson_r", "spearman_r")})
    out = out.withColumns({"r_squared": F.col("pearson_r") * F.col("pearson_r"),
                           "reason": F.when(~enough, F.lit(f"fewer than {min_rows} complete rows"))})
    if p_values:
        for r in ("pearson", "spearman"):
            c = F.col(f"{r}_r")
            t = c * F.sqrt(ratio((F.col("n") - 2).cast("double"), 1 - c * c))
            out = out.withColumn(f"{r}_p", t_pvalue(t, (F.col("n") - 2).cast("double")))
    return out


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairwise Pearson over complete rows, in one aggregate, laid out as (a, b, r).

    A constant column has no correlation: its r is NaN. With no complete row r is NULL.
    """
    d = df.select(*columns).dropna()
    pairs = list(combinations(columns, 2))
    # not corr(): it divides by 0, an error in ANSI mode, where a column is constant
    wide = d.agg(*[F.stddev_pop(a).alias(a) for a in columns], *[F.covar_pop(a, b).alias(f"{a}|{b}") for a, b in pairs])

    def r(a: str, b: str) -> Column:
        spread = F.col(f"`{a}`") * F.col(f"`{b}`")
        return F.when(spread == 0, float("nan")).otherwise(F.col(f"`{a}|{b}`") / spread)

    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r(a, b).alias("r"))
        for a, b in pairs])).alias("_c")).select("_c.*")


def cohens_d(na, ma, va, nb, mb, vb) -> Column:
    """Standardised difference with the pooled sample variance; NULL when undefined."""
    dof = na + nb - 2
    # one observation has no variance of its own, so no pooled one exists either
    pooled = F.sqrt(F.when(dof > 0, ((na - 1) * va + (nb - 1) * vb) / F.greatest(dof, F.lit(1))))
    return F.when(pooled > 0, ratio(ma - mb, pooled))


def compare_groups(df: DataFrame, keys, value: str, in_a: Column, p_values: bool = False) -> DataFrame:
    """Group a (`in_a` true) against group b, per key: means, medians, Welch t, Mann-Whitney
    U with tie correction, Cohen's d and its label."""
    keys = list(keys)
    d = df.filter(F.col(value).isNotNull() & in_a.isNotNull()).select(
        *keys, in_a.alias("_a"), F.col(value).cast("double").alias("_x"))
    a, x = F.col("_a"), F.col("_x")
    pick = {"a": F.when(a, x), "b": F.when(~a, x)}
    aggs = []
    for g, c in pick.items():
        aggs += [F.count(c).alias(f"n_{g}"), F.avg(c).alias(f"mean_{g}"), F.var_samp(c).alias(f"var_{g}")]
    m = d.groupBy(*keys).agg(*aggs)
    med = quantiles(d, [*keys, "_a"], "_x", {"_m": 0.5}).groupBy(*keys).agg(
        F.max(F.when(a, F.col("_m"))).alias("median_a"), F.max(F.when(~a, F.col("_m"))).alias("median_b"))
    ranked = ranked_values(d, keys, "_x", {"_ca": a.cast("bigint")})
    avg_rank = F.col("before") + (F.col(COUNT) + 1) / 2
    t3 = F.col(COUNT).cast("double")
    u = ranked.groupBy(*keys).agg(F.sum(avg_rank * F.col("_ca")).alias("_ra"),
                                  F.sum(t3 * t3 * t3 - t3).alias("_ties"))
    out = m.join(med, keys).join(u, keys)
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    sa, sb = ratio(F.col("var_a"), na), ratio(F.col("var_b"), nb)
    n = na + nb
    out = out.withColumns({
        "difference_in_means": F.col("mean_a") - F.col("mean_b"),
        "percent_difference": 100 * ratio(F.col("mean_a") - F.col("mean_b"), F.col("mean_b")),
        "t_statistic": ratio(F.col("mean_a") - F.col("mean_b"), F.sqrt(sa + sb)),
        "t_dof": ratio((sa + sb) * (sa + sb), ratio(sa * sa, na - 1) + ratio(sb * sb, nb - 1)),
        "u_statistic": F.col("_ra") - na * (na + 1) / 2,
        "_sd": F.sqrt(na * nb / 12 * (n + 1 - ratio(F.col("_ties"), n * (n - 1)))),
        "cohens_d": cohens_d(na, F.col("mean_a"), F.col("var_a"), nb, F.col("mean_b"), F.col("var_b")),
    })
    out = out.withColumn("effect_size_label", effect_label("cohens_d"))
    if p_values:
        # the larger of the two U with a continuity correction of one half
        big = F.greatest(F.col("u_statistic"), na * nb - F.col("u_statistic"))
        z = ratio(big - na * nb / 2 - 0.5, F.col("_sd"))
        out = (out.withColumn("t_pvalue", t_pvalue(F.col("t_statistic"), F.col("t_dof")))
               .withColumn("mannwhitney_pvalue", F.least(F.lit(1.0), F.when(
                   z > 0, normal_pvalue(z)).otherwise(1.0))))
    return out.drop("_ra", "_ties", "_sd", "var_a", "var_b")


def fit_normal_and_lognormal(df: DataFrame, value: str, keys=()) -> DataFrame:
    """Maximum-likelihood normal and log-normal of the positive values of every key, compared by the
    Kolmogorov-Smirnov distance: the largest gap between the fitted and the empirical distribution,
    on either side of each distinct value. One ranking serves both, as the logarithm keeps the order.

    A constant key has NULL distances; a key without positive values has no row.
    """
    keys = list(keys)
    if not keys:
        return fit_normal_and_lognormal(df.withColumn("_all", F.lit(1)), value, ["_all"]).drop("_all")
    x = F.col(value).cast("double")
    rows = df.filter(x > 0).select(*keys, x.alias("_x"))
    fit = rows.groupBy(*keys).agg(
        F.count("_x").alias("n"), F.avg("_x").alias("mu"), F.stddev_pop("_x").alias("sd"), F.avg(F.log("_x")).alias("log_mu"),
        F.stddev_pop(F.log("_x")).alias("log_sd"), F.skewness("_x").alias("skew"), F.kurtosis("_x").alias("kurtosis"))
    ranked = ranked_values(rows, keys, "_x").join(fit, keys)

    def distance(z: Column) -> Column:
        p = normal_cdf(z)
        return F.max(F.greatest(F.abs(p - F.col("before") / F.col("n")), F.abs((F.col("before") + F.col(COUNT)) / F.col("n") - p)))

    ks = ranked.groupBy(*keys).agg(distance(ratio(F.col("_v") - F.col("mu"), F.col("sd"))).alias("ks_normal"),
                                   distance(ratio(F.log("_v") - F.col("log_mu"), F.col("log_sd"))).alias("ks_lognormal"))
    better = F.when(F.col("ks_lognormal") < F.col("ks_normal"), "log-normal").when(F.col("ks_lognormal") >= F.col("ks_normal"), "normal")
    return fit.join(ks, keys).withColumn("better_fit", better)


def sampling_distribution(population: DataFrame, key: str, value: str, sample_size: int = 30,
                          n_samples: int = 1000, seed: int = 42) -> DataFrame:
    """How the means of repeated samples without replacement spread around the true mean.

    Rows are numbered in the order of the MD5 of `key`, within 4,096 ranges of it, so no task
    sorts them all. Sample s draws its positions one by one: the i-th is uniform among the first
    n - size + i; if it is taken already, the last of them is taken (every subset is equally
    likely). The positions of all samples are then joined to the rows. `key` is unique.
    """
    pop = population.filter(F.col(value).isNotNull()).select(
        F.col(key).cast("string").alias("_k"), F.col(value).cast("double").alias("_x"))
    pop = pop.withColumn("_h", F.md5("_k")).withColumn("_range", F.substring("_h", 1, 3))
    counts = pop.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    start = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # 4,096 rows at most
    starts = counts.select("_range", F.coalesce(start, F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("_h", "_k")) - 1
    numbered = pop.withColumn("_i", inside).join(starts, "_range").select((F.col("_start") + F.col("_i")).alias("_at"), "_x")
    size = F.least(F.lit(sample_size).cast("bigint"), F.col("N"))
    text = lambda n: F.concat_ws("|", F.lit(str(seed)), F.col("sample").cast("string"), n.cast("string"))
    draw = lambda n, last: F.pmod(F.conv(F.substring(F.md5(text(n)), 1, 15), 16, 10).cast("bigint"), last + 1)

    def add(taken: Column, last: Column) -> Column:
        one = draw(last - (F.col("N") - size), last)
        return F.concat(taken, F.array(F.when(F.array_contains(taken, one), last).otherwise(one)))

    samples = pop.agg(F.count(F.lit(1)).alias("N")).filter("N > 0").select(
        "N", F.explode(F.sequence(F.lit(1), F.lit(n_samples))).alias("sample"))
    taken = F.aggregate(F.sequence(F.col("N") - size, F.col("N") - 1), F.array().cast("array<bigint>"), add)
    means = samples.select("sample", F.explode(taken).alias("_at")).join(numbered, "_at").groupBy("sample").agg(F.avg("_x").alias("m"))
    a = means.agg(F.count("m").alias("n_samples"), F.avg("m").alias("mean_of_sample_means"),
                  F.stddev_samp("m").alias("sd_of_sample_means"))
    b = pop.agg(F.count("_x").alias("population_n"), F.avg("_x").alias("population_mean"),
                F.stddev_samp("_x").alias("population_sd"))
    both = b.unionByName(a, allowMissingColumns=True)  # two one-row summaries
    out = both.agg(*[F.max(c).alias(c) for c in both.columns])
    return out.withColumns({
        "sample_size": F.lit(sample_size),
        "predicted_standard_error": F.col("population_sd") / F.sqrt(F.lit(float(sample_size))),
        "bias": F.col("mean_of_sample_means") - F.col("population_mean")})


def scaling_check(df: DataFrame, columns: list[str]) -> DataFrame:
    """Original, min-max and standardised (population sd) columns described side by side.

    Both scalings are linear, so their mean, sd, min and max follow from the original's
    and one pass is enough.
    """
    d = df.select(*columns).dropna()
    s = d.agg(*[F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.avg(c).alias("mean"),
                         F.stddev_samp(c).alias("std"), F.stddev_pop(c).alias("psd"),
                         F.min(c).alias("min"), F.max(c).alias("max")).alias(f"_{c}") for c in columns])
    s = s.select(F.explode(F.array(*[f"_{c}" for c in columns])).alias("_s")).select("_s.*")
    span, zero = F.col("max") - F.col("min"), F.lit(0.0)

    def form(name, shift, scale):
        at = lambda c: ratio(F.col(c) - shift, scale).alias(c)
        return F.struct(F.lit(name).alias("form"), at("mean"), ratio(F.col("std"), scale).alias("std"),
                        at("min"), at("max"))

    forms = F.array(form("original", zero, F.lit(1.0)), form("minmax", F.col("min"), span),
                    form("standard", F.col("mean"), F.col("psd")))
    return s.select("column", "n", F.explode(forms).alias("_f")).select("column", "n", "_f.*")


def log_transform_check(df: DataFrame, keys, value: str) -> DataFrame:
    """Skewness before and after log(1 + x)."""
    d = df.filter(F.col(value).isNotNull()).withColumn("_l", F.log1p(value))
    return d.groupBy(*keys).agg(unbiased_skew(value).alias("skew_before"), unbiased_skew("_l").alias("skew_after"))
