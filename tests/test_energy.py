"""Buildings, shares, thresholds, weather."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tests.conftest import column, series
from voltloom.config import DEFAULT_RULES
from voltloom.functions import columns as C
from voltloom.operators import assemble, features, waste, weather

N = None


def meters(spark, **roles):
    """roles: role -> list of (raw, filled, flag)."""
    out = None
    for role, rows in roles.items():
        vals = [(r, f, float(230 if role == "mains" else 999), bool(b)) for r, f, b in rows]
        d = series(spark, vals, key=role, cols=("power_w", "power_filled_w", "voltage", "flag"))
        out = d if out is None else out.unionByName(d)
    d = out.withColumnRenamed("key", "meter")
    for f in assemble.FLAGS:
        d = d.withColumn(f, F.col("flag"))
    d = d.drop("flag").withColumns({"power_min_w": F.col("power_w"), "power_max_w": F.col("power_w"),
                                    "n_readings": F.lit(10), "power_factor": F.lit(0.9), "pf_neg_frac": F.lit(0.0)})
    reg = spark.createDataFrame([(r, "B", r, "commercial") for r in roles], "meter string, building string, role string, kind string")
    return d, reg


def combined(spark, **roles):
    return assemble.combine_meters(*meters(spark, **roles))


def test_total_uses_filled_power(spark):
    d = combined(spark, mains=[(100, 100, 0), (N, 200, 0), (300, 300, 0)])
    assert column(d, "power_w", ("ts",)) == [100, 200, 300]
    d = combined(spark, mains=[(100, 100, 0)] * 3, ups=[(50, 50, 0), (N, 50, 0), (50, 50, 0)])
    assert column(d, "power_w", ("ts",)) == [150, 150, 150]


def test_one_missing_meter_makes_the_total_missing(spark):
    d = combined(spark, mains=[(100, 100, 0)] * 2, ups=[(50, 50, 0), (N, N, 0)])
    assert column(d, "power_w", ("ts",)) == [150, None]
    short = combined(spark, mains=[(100, 100, 0)] * 2, ups=[(50, 50, 0)])
    assert column(short, "power_w", ("ts",)) == [150, None]


@pytest.mark.parametrize("flag", assemble.FLAGS)
def test_flags_are_ored_and_voltage_is_the_mains(spark, flag):
    d = combined(spark, mains=[(1, 1, 1), (1, 1, 0)], ups=[(1, 1, 0), (1, 1, 0)])
    assert column(d, flag, ("ts",)) == [True, False]
    assert column(d, "voltage", ("ts",)) == [230, 230]


def table(spark, groups):
    """groups: (count, occupancy, power[, usable])"""
    rows = []
    for g in groups:
        n, occ, p, *u = g
        rows += [(occ, float(p), u[0] if u else True)] * n
    d = series(spark, rows, cols=("occupancy", "power_w", "usable")) if rows else series(
        spark, [(1.0, 1.0, True)], cols=("occupancy", "power_w", "usable")).filter("false")
    return d.withColumnRenamed("key", "building").withColumn("kwh", C.kwh("power_w"))


def test_share_worked_by_hand(spark):
    r = waste.intensity_ratio(waste.low_occupancy_share(table(spark, [(80, 100.0, 100), (20, 0.0, 50)]))).first()
    assert (r.intervals_low, r.threshold, r.mean_power_low_w, r.mean_power_all_w) == (20, 5, 50, 90)
    assert r.share_pct == pytest.approx(100 * 1000 / 9000) and r.intensity_ratio == pytest.approx(50 / 90)
    flat = waste.intensity_ratio(waste.low_occupancy_share(table(spark, [(80, 100.0, 100), (20, 0.0, 100)]))).first()
    assert flat.intensity_ratio == pytest.approx(1.0)


def test_unreachable_threshold_is_blank_not_an_error(spark):
    r = waste.intensity_ratio(waste.low_occupancy_share(table(spark, [(100, 18.0, 100)]))).first()
    assert (r.reachable, r.intervals_low, r.intensity_ratio) == (False, 0, None) and r.low_occ_kwh == 0


def test_nothing_measured_still_has_a_row(spark):
    r = waste.low_occupancy_share(table(spark, [(5, 1.0, 1, False)])).first()
    assert (r.intervals_total, r.intervals_low, r.reachable, r.share_pct, r.total_kwh) == (0, 0, False, None, None)
    assert waste.low_occupancy_share(table(spark, [])).count() == 0


def test_unusable_and_missing_rows_are_left_out(spark):
    total = lambda g: waste.low_occupancy_share(table(spark, g)).first().intervals_total
    assert total([(50, 10.0, 1), (50, 10.0, 1, False)]) == 50
    assert total([(70, 10.0, 1), (30, N, 1)]) == 70


def test_sweep_rises(spark):
    d = table(spark, [(1, 100.0 * i / 199, 50 + i) for i in range(200)])
    curve = waste.sensitivity_curve(d, fractions=[0.02, 0.05, 0.1, 0.2]).orderBy("fraction_of_p95").collect()
    shares = [r.share_pct for r in curve]
    assert shares == sorted(shares)
    one = waste.low_occupancy_share(d, fraction=0.1).first()
    assert [r for r in curve if r.fraction_of_p95 == 0.1][0].share_pct == pytest.approx(one.share_pct)


def test_low_mask_is_inclusive_and_never_true_for_missing(spark):
    d = series(spark, [4, 5, 6, N]).select("key", "ts", C.is_low("value", F.lit(5.0)).alias("low"))
    assert column(d, "low") == [True, True, False, False]
    s = waste.occupancy_summary(series(spark, [*[18] * 99, 1], cols=("occupancy",)).withColumnRenamed("key", "building")).first()
    assert s.threshold < s.min and s.intervals_low_occ == 0 and not s.threshold_reachable


def test_cooling_degree_hours(spark):
    d = series(spark, [5, 15, 23.9, 24, 25, 30, 36, N, 49])
    got = column(d.withColumn("c", C.cooling_degree_hours("value", 24.0)), "c")
    assert got == [0, 0, 0, 0, pytest.approx(1 / 6), 1, 2, None, pytest.approx(25 / 6)]


def test_weather_gap_counts_rows_of_the_union(spark):
    rows = [("2015-06-01 00:05", "10.0", "50"), ("2015-06-01 00:35", "M", ""), ("2015-06-01 01:05", "22.0", "T"),
            ("2015-06-01 06:00", "30", "60"), ("bad", "1", "1")]
    st = weather.parse_station(spark.createDataFrame(rows, "valid string, tmpc string, relh string"))
    assert st.count() == 4
    g = weather.weather_grid(st).orderBy("ts").collect()
    assert (str(g[0].ts), str(g[-1].ts)) == ("2015-06-01 00:00:00", "2015-06-01 06:00:00")
    at = {str(r.ts)[11:16]: r.temp_c for r in g}
    assert at["00:00"] is None and at["00:10"] == pytest.approx(11) and at["01:00"] == pytest.approx(21)
    assert at["03:00"] is None and at["06:00"] == 30


def test_a_reading_beats_a_missing_one_of_the_same_stamp(spark):
    rows = [("2015-06-01 00:05", "M", "50"), ("2015-06-01 00:05", "30.0", "M"), ("2015-06-01 00:35", "M", "M"),
            ("2015-06-01 00:35", "25.0", "40"), ("2015-06-01 00:35", "20.0", "M"), ("2015-06-01 01:05", "M", "M")]
    st = weather.parse_station(spark.createDataFrame(rows, "valid string, tmpc string, relh string")).orderBy("ts").collect()
    assert [(r.temp_c, r.relh) for r in st] == [(30.0, None), (25.0, 40.0), (None, None)]


def test_decomposition_recovers_a_known_slope(spark):
    rows = [(1000.0 + 30 * (i % 24) + 60 * max(0.0, t - 20) / 6, t, float(i % 24)) for i in range(720)
            for t in [10 + (i * 7 % 31)]]
    d = series(spark, rows, cols=("power_w", "temp_c", "hour"))
    r = weather.decompose_low_occupancy(d, F.lit(True), ["key"]).first()
    assert (r.base_c, r.identifiable) == (20.0, True) and r.slope_w_per_degree_hour == pytest.approx(60)
    assert r.r2 == pytest.approx(1.0) and r.schedule_kw + r.weather_kw == pytest.approx(r.mean_power_kw)
    none = weather.decompose_low_occupancy(d, F.lit(False), ["key"]).first()
    assert none.n == 0 and none.reason == weather.TOO_FEW and not none.identifiable
    b = weather.fit_base_temperature(d.withColumn("power_w", 500 + 3 * F.greatest(F.col("temp_c") - 22, F.lit(0.0))), ["key"]).first()
    assert b.base_c == 22.0 and b.r2 == pytest.approx(1.0) and b.intercept_w == pytest.approx(500)


def test_history_features_need_six_values_and_exclude_the_row(spark):
    d = series(spark, [float(i) for i in range(400)], cols=("power_w",)).withColumnRenamed("key", "building")
    out = features.add_history_features(d, rules=replace(DEFAULT_RULES, segment_days=1)).orderBy("ts").collect()
    assert [r.power_lag_1h for r in out[:7]] == [None] * 6 + [0.0]
    assert out[143].power_lag_1d is None and out[350].power_lag_1d == 206.0
    assert out[5].power_roll24h_mean is None and out[6].power_roll24h_mean == pytest.approx(2.5)
    assert out[300].power_roll24h_mean == pytest.approx(sum(range(156, 300)) / 144)


def test_calendar_falls_back_per_day(spark):
    d = series(spark, [1.0] * 3, step=1440, start="2015-06-01 00:00:00")
    cal = spark.createDataFrame([("2015-06-01", 1, "H"), ("2015-06-02", 0, "L")], "date string, working_day int, activity string")
    out = features.add_calendar_features(d, cal.withColumn("date", F.to_date("date")))
    assert column(out, "is_vacation") == [False, True, True]      # 3 June: inside the approximate window
    assert column(out, "is_working_day") == [True, False, True]
    assert set(column(out, "calendar_source")) == {"official"}
    assert column(features.add_calendar_features(d, None), "period") == ["vacation"] * 3
