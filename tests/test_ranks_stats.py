"""Quantiles, ranks and tests against NumPy and direct counting."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import series
from voltloom.functions import columns as C
from voltloom.functions import tails
from voltloom.operators import compare, profile, ranks, stats

N = None


def draws(seed, n=500):
    rng = random.Random(seed)
    return [rng.choice([0.0, 1.0, -3.5, rng.gauss(0, 1), rng.gauss(0, 1e6), rng.lognormvariate(0, 3), 1e-9]) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_quantiles_match_numpy(spark, seed):
    a, b = draws(seed), draws(seed + 10, 37)
    d = series(spark, a, key="a").unionByName(series(spark, [*b, N, N], key="b"))
    probs = {"lo": 0.0, "q1": 0.25, "med": 0.5, "p95": 0.95, "p999": 0.999, "hi": 1.0}
    got = {r.key: r for r in ranks.quantiles(d, ["key"], "value", probs).collect()}
    for key, values in (("a", a), ("b", b)):
        for name, p in probs.items():
            assert got[key][name] == pytest.approx(np.percentile(values, 100 * p), rel=1e-12, abs=1e-12)
    whole = ranks.quantiles(d, [], "value", {"med": 0.5}).first()
    assert whole.med == pytest.approx(np.median(a + b))
    same = ranks.quantiles(series(spark, [7.0] * 50), ["key"], "value", probs).first()
    assert {same[n] for n in probs} == {7.0}


def test_bins_are_monotone(spark):
    values = sorted(draws(3, 400))
    d = series(spark, values).orderBy("value").select(ranks.value_bin(F.col("value")).alias("b"))
    got = [r.b for r in d.collect()]
    assert got == sorted(got)


def test_average_ranks(spark):
    r = {x._v: x["rank"] for x in ranks.average_ranks(series(spark, [3, 1, 3, 2, 3]), ["key"], "value").collect()}
    assert r == {1.0: 1, 2.0: 2, 3.0: 4}


def test_group_comparison_by_direct_counting(spark):
    rng = random.Random(5)
    a, b = [rng.randint(0, 9) for _ in range(60)], [rng.randint(2, 12) for _ in range(45)]
    d = series(spark, [(v, True) for v in a] + [(v, False) for v in b], cols=("value", "is_a"))
    r = stats.compare_groups(d, ["key"], "value", F.col("is_a"), p_values=True).first()
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert r.u_statistic == u and (r.median_a, r.median_b) == (np.median(a), np.median(b))
    pooled = math.sqrt((59 * np.var(a, ddof=1) + 44 * np.var(b, ddof=1)) / 103)
    assert r.cohens_d == pytest.approx((np.mean(a) - np.mean(b)) / pooled)
    assert r.t_statistic == pytest.approx((np.mean(a) - np.mean(b)) / math.sqrt(np.var(a, ddof=1) / 60 + np.var(b, ddof=1) / 45))
    n = 105
    ties = sum(c ** 3 - c for c in np.unique(a + b, return_counts=True)[1])
    sd = math.sqrt(60 * 45 / 12 * (n + 1 - ties / (n * (n - 1))))
    z = (max(u, 2700 - u) - 1350 - 0.5) / sd
    assert r.mannwhitney_pvalue == pytest.approx(math.erfc(z / math.sqrt(2)))
    assert 0 < r.t_pvalue < 1 and r.effect_size_label == "large"


def test_tail_probabilities(spark):
    def all_of(fn, rows):
        d = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "i int, " + ", ".join(f"x{k} double" for k in range(len(rows[0]))))
        got = d.select("i", fn(*[F.col(f"x{k}") for k in range(len(rows[0]))]).alias("p")).collect()
        return [r.p for r in sorted(got)]

    nan = float("nan")
    p = all_of(tails.t_pvalue, [(0, 5), (1, 1), (-1, 1), (2, 2), (1.959964, 1e7), (40, 1e5), (nan, 4), (1, 0)])
    assert p[:5] == pytest.approx([1, 0.5, 0.5, 1 - 2 / math.sqrt(6), 0.05], abs=1e-6)  # Cauchy; closed form for 2 degrees
    assert p[1] == p[2] and p[5] < 1e-200 and p[6] is None and p[7] is None
    below = [(0.3, 2, 7), (2.5, 2, 40), (1.0, 2, 900), (0.0, 2, 5), (4.0, 1, 2)]
    want = [(1 + 2 * f / d2) ** (-d2 / 2) for f, _, d2 in below[:4]] + [p[3]]  # closed form for 2 degrees above
    assert all_of(tails.f_pvalue, below) == pytest.approx(want, rel=1e-9)
    z = [(x,) for x in (-40, -9, -7.08, -3.1, -0.2, 0, 1e-9, 0.7, 2.0, 6.9, 7.2, 39)]
    assert all_of(tails.normal_cdf, z) == pytest.approx([math.erfc(-x / math.sqrt(2)) / 2 for x, in z], rel=1e-7, abs=1e-300)
    g = [(x,) for x in (0.5, 1.5, 8.0, 15.9, 16.0, 1e6)]
    assert all_of(tails.log_gamma, g) == pytest.approx([math.lgamma(x) for x, in g], rel=1e-12, abs=1e-12)


def test_effect_labels_and_buckets(spark):
    d = series(spark, [0.1, -0.3, 0.6, 0.9, N])
    got = [r.e for r in d.orderBy("ts").select(C.effect_label("value").alias("e")).collect()]
    assert got == ["negligible", "small", "medium", "large", "undefined"]
    z = series(spark, [0, 1.9, 2, 2.9, 3, 10, -3.5, -2.5, -1])
    got = [r.b for r in z.orderBy("ts").select(C.band("value").alias("b")).collect()]
    assert got == ["NORMAL", "NORMAL", "WARNING", "WARNING", "ANOMALY", "ANOMALY", "ANOMALY", "WARNING", "NORMAL"]


def test_spearman_of_a_bent_line_is_one(spark):
    d = series(spark, [(float(i), float(i) ** 3) for i in range(150)], cols=("x", "y"))
    r = stats.correlation(d, ["key"], "x", "y", p_values=True).first()
    assert r.spearman_r == pytest.approx(1) and r.pearson_r < 1 and r.pearson_p < 1e-6


def test_distribution_fit_prefers_the_right_family(spark):
    rng = random.Random(1)
    values = {"log": [rng.lognormvariate(2, 1) for _ in range(2000)], "plain": [round(rng.gauss(50, 5), 1) for _ in range(900)], "same": [3.0] * 4, "none": [-1.0]}
    rows = [(k, float(v)) for k, own in values.items() for v in own]
    d = spark.createDataFrame([*rows, ("log", None), ("log", -5.0)], "kind string, value double").repartition(3)
    got = {r.kind: r for r in stats.fit_normal_and_lognormal(d, "value", ["kind"]).collect()}
    assert set(got) == {"log", "plain", "same"} and got["same"].ks_normal is None and got["same"].better_fit is None
    assert got["log"].better_fit == "log-normal" and got["plain"].better_fit == "normal"
    for k in ("log", "plain"):
        for name, x in (("ks_normal", np.sort(values[k])), ("ks_lognormal", np.sort(np.log(values[k])))):
            p = np.array([math.erfc(-z / math.sqrt(2)) / 2 for z in (x - x.mean()) / x.std()])
            at = np.arange(len(x))
            assert got[k][name] == pytest.approx(max((p - at / len(x)).max(), ((at + 1) / len(x) - p).max()), abs=1e-9)
    assert stats.fit_normal_and_lognormal(d.filter("kind = 'log'"), "value").first().ks_normal == pytest.approx(got["log"].ks_normal)


def test_sample_means_centre_on_the_population(spark):
    rng = random.Random(2)
    d = series(spark, [rng.gauss(50, 10) for _ in range(300)]).withColumn("id", F.col("i"))
    r = stats.sampling_distribution(d, "id", "value", 30, 400).first()
    assert r.n_samples == 400 and r.population_n == 300
    assert abs(r.bias) < 0.5 and r.sd_of_sample_means == pytest.approx(r.predicted_standard_error, rel=0.2)


def test_mode_histogram_and_scaling(spark):
    d = series(spark, [1400, 1600, 2400, 2500, 9000])
    assert stats.mode_binned(d, ["key"], "value").first().mode == 2000   # 2500 rounds to the even bin
    h = profile.histogram(series(spark, [0, 1, 2, 60]), ["key"], "value").collect()
    assert {(r.bin, r.n) for r in h} == {(0, 1), (1, 1), (2, 1), (59, 1)}
    s = {r.form: r for r in stats.scaling_check(series(spark, [0, 5, 10]), ["value"]).collect()}
    assert (s["minmax"].min, s["minmax"].max, s["minmax"].mean) == (0, 1, 0.5)
    assert s["standard"].mean == pytest.approx(0) and s["standard"].max == pytest.approx(math.sqrt(1.5))


def test_table_diff(spark):
    a = series(spark, [(1, "x"), (2, "y"), (3, "z")], cols=("v", "t")).drop("ts", "key")
    b = series(spark, [(1, "x"), (2.5, "y"), (N, "w")], cols=("v", "t")).drop("ts", "key")
    r = {x["column"]: x for x in compare.table_diff(a, b, ["i"]).collect()}
    assert (r["v"].max_abs_diff, r["v"].null_mismatches, r["v"].same) == (0.5, 1, False)
    assert (r["t"].text_mismatches, r["t"].same) == (1, False)
    assert all(x.same for x in compare.table_diff(a, a, ["i"]).collect())
    assert compare.rows_only_in(a, b).count() == 2


def test_step_gaps_across_slices(spark):
    d = series(spark, [1.0] * 5, step=1).filter("i <> 2")
    far = d.withColumn("ts", F.col("ts") + F.make_dt_interval(days=F.when(F.col("i") == 4, 90).otherwise(0)))
    r = profile.step_gaps(far, ["key"], C.wall_seconds("ts")).first()
    assert (r.gaps, r.largest_gap_s) == (2, 90 * 86400 + 60)


def test_a_steady_load_is_sorted_in_small_parts(spark):
    from voltloom.operators import ranks
    d = spark.range(200_001).select(F.lit("k").alias("key"), (230 + (F.col("id") - 100_000) * 1e-6).alias("value"))
    bins = d.groupBy(ranks.value_bin(F.col("value")).alias("b")).count().agg(F.max("count")).first()[0]
    parts = d.groupBy(ranks.value_bin(F.col("value"), ranks.PARTS_PER_OCTAVE).alias("b")).count().agg(F.max("count")).first()[0]
    assert bins > 50_000 and parts < 300
    q = ranks.quantiles(d, ["key"], "value", {"low": 0.25, "mid": 0.5}).first()
    assert q.mid == 230 and q.low == pytest.approx(229.95, abs=1e-9)
    r = ranks.ranked_values(d, ["key"], "value").agg(F.max("before"), F.sum("before")).first()
    assert tuple(r) == (200_000, 200_000 * 200_001 // 2)


def test_samples_are_without_replacement(spark):
    d = series(spark, [float(i) for i in range(30)]).withColumn("id", F.col("i"))
    r = stats.sampling_distribution(d, "id", "value", 30, 50).first()
    assert r.mean_of_sample_means == 14.5 and r.sd_of_sample_means == 0


def test_correlation_matrix_of_a_constant_column(spark):
    rows = [(float(i), float(i * i % 7), 99.0, None if i == 3 else 2.0 * i) for i in range(12)]
    df = spark.createDataFrame(rows, "x double, y double, flat double, z double")
    got = {(r.a, r.b): r.r for r in stats.correlation_matrix(df, ["x", "y", "flat", "z"]).collect()}
    want = np.corrcoef(np.array([r for r in rows if r[3] is not None])[:, [0, 1, 3]].T)
    assert got[("x", "y")] == pytest.approx(want[0, 1]) and got[("x", "z")] == pytest.approx(1.0)
    assert got[("y", "z")] == pytest.approx(want[1, 2]) and len(got) == 6
    assert all(math.isnan(got[p]) for p in (("x", "flat"), ("y", "flat"), ("flat", "z")))
    one = stats.correlation_matrix(df.filter("x = 1"), ["x", "y"]).collect()
    assert [math.isnan(r.r) for r in one] == [True]
    assert [r.r for r in stats.correlation_matrix(df.filter("x < 0"), ["x", "y"]).collect()] == [None]
