"""Gap, fill and dead-meter rules on hand-worked series and against brute force."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tests.conftest import column, series
from voltloom.config import DEFAULT_RULES
from voltloom.operators import blocks, ordered, runs

N = None
WEEKLY = replace(DEFAULT_RULES, segment_days=1)   # many slices, so borders are crossed


@pytest.mark.parametrize("values, expected", [
    ([1, N, N, N, 5], [1, 3, 3, 3, 1]),
    ([1, N, 3, N, N, 6], [1, 1, 1, 2, 2, 1]),
])
def test_gap_runs(spark, values, expected):
    assert column(runs.gap_runs(series(spark, values), ["key"], "value"), "run_rows") == expected


@pytest.mark.parametrize("values, filled", [
    ([10, N, N, 40], [10, 20, 30, 40]),
    ([10, *[N] * 10, 110], [10, *[N] * 10, 110]),
    ([0, N, N, N, 40], [0, 10, 20, 30, 40]),
    ([0, *[N] * 4, 50], [0, *[N] * 4, 50]),
    ([N, N, 30, 40, N, N], [N, N, 30, 40, N, N]),
    ([1, 2, 3], [1, 2, 3]),
])
def test_short_gap_fill(spark, values, filled):
    out = runs.fill_short_gaps(series(spark, values), ["key"], "value", "filled", "was", 3)
    got = column(out, "filled")
    assert [None if v is None else pytest.approx(v) for v in got] == filled
    assert column(out, "was") == [v is None and f is not None for v, f in zip(values, filled)]


@pytest.mark.parametrize("values, flagged", [
    ([50, *[0] * 48, 50], 48),
    ([50, *[0] * 12, 50], 0),
    ([50, *[0] * 36, 50], 36),
    ([50, *[0] * 35, 50], 0),
    ([50, *[0] * 30, N, *[0] * 30, 50], 60),
    ([50, *[0] * 30, *[N] * 8, *[0] * 30, 50], 0),
    ([N] * 60, 0),
])
def test_meter_off(spark, values, flagged):
    out = runs.flag_meter_off(series(spark, values, cols=("power_max_w",)), ["key"])
    got = column(out, "meter_off")
    assert sum(got) == flagged
    assert not any(f and v is None for f, v in zip(got, values))


def test_zero_run_lengths_in_hours(spark):
    d = series(spark, [50, *[0] * 18, 50, *[0] * 72, 50], cols=("power_max_w",))
    assert sorted(column(runs.zero_runs(d, ["key"]), "hours", ("key", "start"))) == [3.0, 12.0]


def test_fences_and_outliers(spark):
    f = runs.fences(series(spark, [1, 2, 3, 4, 5]), ["key"], "value").first()
    assert (f.q1, f.q3, f.low_fence, f.high_fence) == (2, 4, -1, 7)
    d = series(spark, [*[10] * 20, 1000]).withColumnRenamed("value", "power_w").withColumn("meter_off", F.lit(False))
    out = runs.flag_outliers(d, ["key"], "power_w", runs.live_rows())
    assert column(out, "outlier_iqr") == [False] * 20 + [True]
    flat = d.withColumn("power_w", F.lit(7.0))
    assert not any(column(runs.flag_outliers(flat, ["key"], "power_w", runs.live_rows()), "outlier_zscore"))


# ------------------------------------------------------------------ brute force
def brute_runs(flags):
    out, i = [], 0
    while i < len(flags):
        j = i
        while j < len(flags) and flags[j] == flags[i]:
            j += 1
        out += [j - i] * (j - i)
        i = j
    return out


def brute_off(p, need, bridge):
    missing = [v is None for v in p]
    gap = brute_runs(missing)
    inside = []
    for i, v in enumerate(p):
        if v is None:
            before = next((p[j] for j in range(i, -1, -1) if p[j] is not None), None)
            after = next((p[j] for j in range(i, len(p)) if p[j] is not None), None)
            inside.append(gap[i] <= bridge and before == 0 and after == 0)
        else:
            inside.append(v == 0)
    length = brute_runs(inside)
    return [v == 0 and length[i] >= need for i, v in enumerate(p)]


def brute_fill(p, limit):
    gap, out = brute_runs([v is None for v in p]), list(p)
    for i, v in enumerate(p):
        a = next((j for j in range(i, -1, -1) if p[j] is not None), None)
        b = next((j for j in range(i, len(p)) if p[j] is not None), None)
        if v is None and gap[i] <= limit and a is not None and b is not None:
            out[i] = p[a] + (p[b] - p[a]) * (i - a) / (b - a)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rules_across_slice_borders(spark, seed):
    """Three days in one-day slices: runs and gaps cross the borders."""
    rng, p = random.Random(seed), []
    while len(p) < 430:
        kind, n = rng.choice("zzmv"), rng.randint(1, 60)
        n = rng.randint(1, 5) if kind == "m" else n
        p += [0.0 if kind == "z" else None if kind == "m" else rng.uniform(1, 9) for _ in range(n)]
    d = series(spark, p, cols=("power_max_w",))
    assert column(runs.flag_meter_off(d, ["key"], rules=WEEKLY), "meter_off") == brute_off(p, 36, 3)
    assert column(runs.gap_runs(d, ["key"], "power_max_w", rules=WEEKLY), "run_rows") == brute_runs([v is None for v in p])
    got = column(runs.fill_short_gaps(d, ["key"], "power_max_w", "f", "w", 3, rules=WEEKLY), "f")
    assert got == [None if v is None else pytest.approx(v) for v in brute_fill(p, 3)]
    pos = ordered.row_positions(d, ["key"], "ts", 1, "pos", "n")
    assert column(pos, "pos") == list(range(len(p))) and set(column(pos, "n")) == {len(p)}


def test_long_run_over_many_slices(spark):
    d = series(spark, [1.0, *[0.0] * 700, 2.0], cols=("power_max_w",))
    z = runs.zero_runs(d, ["key"], rules=WEEKLY).collect()
    assert [r.rows for r in z] == [700]
    assert sum(column(runs.flag_meter_off(d, ["key"], rules=WEEKLY), "meter_off")) == 700


def test_invalid_readings_and_blocks(spark):
    rows = [(-1.0, 179.9, -0.8), (200001.0, 180.0, 0.5), (200000.0, 270.0, None), (None, 270.1, 0.9)]
    d = series(spark, rows, cols=("power", "voltage", "power_factor"), step=1).withColumnRenamed("key", "meter")
    c = blocks.invalidate(d)
    assert column(c, "power", ("ts",)) == [None, None, 200000.0, None]
    assert column(c, "voltage", ("ts",)) == [None, 180.0, 270.0, None]
    assert column(c, "power_factor", ("ts",)) == [0.8, 0.5, None, 0.9]
    n = blocks.reading_counters(c).first()
    assert (n.rows_read, n.power_missing_in_source, n.power_invalid, n.power_missing) == (4, 1, 2, 3)
    assert (n.voltage_invalid, n.pf_negative) == (2, 1)
    b = blocks.aggregate_blocks(c).first()
    assert (b.power_w, b.n_readings, b.pf_neg_frac) == (200000.0, 1, pytest.approx(1 / 3))
    none = blocks.aggregate_blocks(blocks.invalidate(d.withColumn("power", F.lit(-5.0)))).first()
    assert none.power_w is None and none.n_readings == 0


def test_grid_has_every_block(spark):
    d = series(spark, [5.0, 6.0, 7.0], cols=("power_w",)).filter("i <> 1").withColumnRenamed("key", "meter")
    far = d.withColumn("ts", F.col("ts") + F.make_dt_interval(days=F.when(F.col("i") == 2, 3).otherwise(0)))
    out = blocks.complete_grid(far.select("meter", "ts", "power_w"))
    assert out.count() == 3 * 144 + 3 and out.filter("power_w IS NOT NULL").count() == 2


def test_occupancy_is_floored_counted_and_keeps_the_first(spark):
    rows = [("2015-06-01 00:00:00", 5.0), ("2015-06-01 00:03:00", 9.0), ("2015-06-01 00:20:00", 7.0)]
    d = spark.createDataFrame(rows, "ts string, occupancy double").select(
        F.lit("b").alias("building"), F.col("ts").cast("timestamp_ntz").alias("ts"), "occupancy")
    assert column(blocks.occupancy_blocks(d), "occupancy", ("ts",)) == [5.0, None, 7.0]
    assert blocks.moved_rows(d).first().moved == 1
