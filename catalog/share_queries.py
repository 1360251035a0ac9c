"""Low-occupancy energy, weather response."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import roles as R
from catalog.registry import query
from catalog.sql import i, is_, r, rs, sql, RUNS_SQL
from voltloom.operators import assemble, intervals, models, waste, weather
from voltloom.functions import columns as C
from voltloom.plans import experiment, headline

FRACTION = 0.25   # the stand-in counts are small: 5 % of their p95 is never reached


def share_sql(fraction: str, source: str = "ok", keys: str = "building", prefix: str = "") -> str:
    """CTEs ok (measured rows), thr (threshold per building) and share."""
    return f"""{prefix}ok AS (SELECT * FROM buildings WHERE usable AND occupancy IS NOT NULL AND kwh IS NOT NULL),
    thr AS (SELECT building, quantile_cont(occupancy, 0.95) AS p95, {fraction} * quantile_cont(occupancy, 0.95) AS thr FROM ok GROUP BY 1),
    share AS (SELECT {keys}, any_value(thr) AS threshold, any_value(p95) AS p95_occupancy, count(*) AS intervals_total,
      count(*) FILTER (WHERE occupancy <= thr) AS intervals_low, 1e2 * count(*) FILTER (WHERE occupancy <= thr) / count(*) AS pct_intervals_low,
      sum(kwh) AS total_kwh, coalesce(sum(kwh) FILTER (WHERE occupancy <= thr), 0e0) AS low_occ_kwh,
      100 * coalesce(sum(kwh) FILTER (WHERE occupancy <= thr), 0e0) / sum(kwh) AS share_pct,
      avg(power_w) FILTER (WHERE occupancy <= thr) AS mean_power_low_w, avg(power_w) AS mean_power_all_w,
      count(*) FILTER (WHERE occupancy <= thr) > 0 AS reachable
      FROM {source} JOIN thr USING (building) GROUP BY ALL)"""


SHARE_COLS = (is_("intervals_total", "intervals_low") + ", "
              + rs("threshold", "p95_occupancy", "pct_intervals_low", "total_kwh", "low_occ_kwh", "share_pct",
                   "mean_power_low_w", "mean_power_all_w") + ", reachable")


@query("a06_low_occ_share", sql(f"SELECT building, {SHARE_COLS} FROM share", "buildings", extra=share_sql("25e-2")))
def _(w):
    return waste.low_occupancy_share(w.buildings, fraction=FRACTION, rules=w.rules)


@query("a06_low_occ_share_unreachable", sql(f"SELECT building, {SHARE_COLS} FROM share", "buildings", extra=share_sql("5e-2")))
def _(w):
    return waste.low_occupancy_share(w.buildings, rules=w.rules)


CURVE_SQL = """curve AS (SELECT building, f AS fraction_of_p95, f * p95 AS threshold,
    1e2 * count(*) FILTER (WHERE occupancy <= f * p95) / count(*) AS pct_intervals_low,
    100 * coalesce(sum(kwh) FILTER (WHERE occupancy <= f * p95), 0e0) / sum(kwh) AS share_pct,
    count(*) FILTER (WHERE occupancy <= f * p95) > 0 AS reachable
  FROM ok JOIN thr USING (building), (SELECT x::DOUBLE / 100e0 * 5 AS f FROM range(21) q(x)) GROUP BY ALL)"""


def _curve(w):
    return waste.sensitivity_curve(w.buildings, fractions=[x / 100 * 5 for x in range(21)], rules=w.rules)


@query("a07_sensitivity_curve", sql(f"SELECT building, {rs('fraction_of_p95', 'threshold', 'pct_intervals_low', 'share_pct')}, reachable FROM curve",
                                    "buildings", extra=share_sql("25e-2") + ", " + CURVE_SQL))
def _(w):
    return _curve(w)


@query("a08_first_reachable_fraction", sql(f"SELECT building, {r('min(fraction_of_p95) FILTER (WHERE reachable)', 'first_reachable')} FROM curve GROUP BY 1",
                                           "buildings", extra=share_sql("25e-2") + ", " + CURVE_SQL))
def _(w):
    return waste.first_reachable_fraction(_curve(w))


RATIO = "CASE WHEN reachable THEN mean_power_low_w / mean_power_all_w END"


@query("a09_intensity_ratio", sql(f"SELECT building, {r(RATIO, 'intensity_ratio')} FROM share", "buildings", extra=share_sql("25e-2")))
def _(w):
    return waste.intensity_ratio(waste.low_occupancy_share(w.buildings, fraction=FRACTION, rules=w.rules)).select(
        "building", "intensity_ratio")


OOH_SQL = """ooh AS (SELECT building, 1e2 * count(*) FILTER (WHERE NOT (hour >= 8 AND hour < 18 AND NOT is_weekend)) / count(*) AS pct_intervals_out_of_hours,
    sum(kwh) AS total_kwh, coalesce(sum(kwh) FILTER (WHERE NOT (hour >= 8 AND hour < 18 AND NOT is_weekend)), 0e0) AS out_of_hours_kwh
  FROM buildings WHERE usable AND kwh IS NOT NULL GROUP BY building)"""


@query("a10_out_of_hours_share", sql(f"SELECT building, {rs('pct_intervals_out_of_hours', 'total_kwh', 'out_of_hours_kwh', ('100 * out_of_hours_kwh / total_kwh', 'share_pct'))} FROM ooh",
                                     "buildings", extra=OOH_SQL))
def _(w):
    return waste.out_of_hours_share(w.buildings)


@query("a11_share_by_period", sql(f"SELECT building, period, {SHARE_COLS} FROM share", "buildings",
                                  extra=share_sql("25e-2", keys="building, period")))
def _(w):
    return waste.by_period(w.buildings, fraction=FRACTION, rules=w.rules)


@query("a12_share_by_supply", sql(f"""
  SELECT building, role, {rs(('sum(k)', 'total_kwh'), ('coalesce(sum(k) FILTER (WHERE occupancy <= thr), 0e0)', 'low_occ_kwh'),
    ('100 * coalesce(sum(k) FILTER (WHERE occupancy <= thr), 0e0) / sum(k)', 'share_pct'), ('avg(p)', 'mean_power_w'),
    ('avg(p) FILTER (WHERE occupancy <= thr)', 'mean_power_low_occ_w'))}
  FROM (SELECT building, role, c.power_w AS p, c.power_w / 1e3 * (10e0/60e0) AS k, occupancy, thr
    FROM cleaned c JOIN registry USING (meter) JOIN (SELECT building, ts, occupancy FROM buildings WHERE usable) USING (building, ts)
      JOIN thr USING (building)
    WHERE building IN (SELECT building FROM registry GROUP BY 1 HAVING count(*) >= 2)) GROUP BY 1, 2""", "buildings",
    extra=share_sql("25e-2")))
def _(w):
    return waste.supply_shares(w.buildings, assemble.supplies(w.cleaned, w.registry), FRACTION, w.rules)


NIGHT_SQL = "night AS (SELECT building, quantile_cont(power_w, 0.5) AS night_median_w FROM buildings WHERE usable AND hour BETWEEN 2 AND 5 GROUP BY 1)"


@query("a13_night_minimum", sql(f"SELECT building, {r('night_median_w', 'night_median_w')} FROM night", "buildings", extra=NIGHT_SQL))
def _(w):
    return waste.night_minimum(w.buildings)


@query("a14_a15_occupancy_summary", sql(f"""
  SELECT building, {i('count(*)', 'n')}, {rs(('min(occupancy)', 'min'), ('quantile_cont(occupancy, 0.5)', 'median'), ('any_value(p95)', 'p95'),
    ('max(occupancy)', 'max'), ('any_value(5e-2 * p95)', 'threshold'), ('1e2 * count(*) FILTER (WHERE occupancy <= 5e-2 * p95) / count(*)', 'pct_intervals_low_occ'))},
    {i('count(*) FILTER (WHERE occupancy <= 5e-2 * p95)', 'intervals_low_occ')}, count(*) FILTER (WHERE occupancy <= 5e-2 * p95) > 0 AS threshold_reachable
  FROM occ JOIN (SELECT building, quantile_cont(occupancy, 0.95) AS p95 FROM occ WHERE occupancy IS NOT NULL GROUP BY 1) USING (building)
  WHERE occupancy IS NOT NULL GROUP BY building""", "occ"))
def _(w):
    return waste.occupancy_summary(w.occupancy, rules=w.rules)


@query("g08_dead_meter_comparison", sql(f"""
  SELECT building, rule, {i('count(*)', 'usable_intervals')}, {rs(('sum(kwh)', 'total_kwh'),
    ('100 * coalesce(sum(kwh) FILTER (WHERE occupancy <= 25e-2 * p95), 0e0) / sum(kwh)', 'share_pct'))}
  FROM both_rules JOIN (SELECT building, rule, quantile_cont(occupancy, 0.95) AS p95 FROM both_rules GROUP BY 1, 2) USING (building, rule)
  GROUP BY 1, 2""", "buildings", extra="""need4 AS (SELECT * FROM (""" + "WITH " + RUNS_SQL.format(need=4) + """ SELECT * FROM off)),
    alt AS (SELECT building, ts, CASE WHEN count(power_w) = max(n_meters) THEN sum(power_w) END AS p, bool_or(meter_off) AS mo
      FROM need4 JOIN registry USING (meter) JOIN nm USING (building) GROUP BY 1, 2),
    both_rules AS (SELECT building, 'default' AS rule, kwh, occupancy FROM buildings WHERE usable
      UNION ALL SELECT building, 'longer', p / 1e3 * (10e0/60e0), occupancy FROM alt JOIN occ USING (building, ts)
        WHERE p IS NOT NULL AND NOT mo AND occupancy IS NOT NULL)"""))
def _(w):
    alt = assemble.with_dead_meter_rule(w.blocks, w.registry, w.occupancy, 4 / 6, w.rules)
    return headline.dead_meter_comparison({"default": w.buildings, "longer": alt}, FRACTION, w.rules)


@query("a41_corrected_occupancy", sql(f"""
  SELECT building, {rs('raw_threshold', 'corrected_threshold', 'raw_share_pct', 'corrected_share_pct', ('corrected_share_pct - raw_share_pct', 'change_pp'))}
  FROM (SELECT building, 25e-2 * p95 AS raw_threshold, 25e-2 * c95 AS corrected_threshold,
      100 * coalesce(sum(kwh) FILTER (WHERE occupancy <= 25e-2 * p95), 0e0) / sum(kwh) AS raw_share_pct,
      100 * coalesce(sum(kwh) FILTER (WHERE co <= 25e-2 * c95), 0e0) / sum(kwh) AS corrected_share_pct
    FROM ok2 JOIN (SELECT building, quantile_cont(occupancy, 0.95) AS p95, quantile_cont(co, 0.95) AS c95 FROM ok2 GROUP BY 1) USING (building)
    GROUP BY building, p95, c95)""", "buildings",
    extra="ok2 AS (SELECT *, greatest(occupancy - 1e0, 0e0) AS co FROM buildings WHERE usable)"))
def _(w):
    return headline.corrected_comparison(w.buildings, F.lit(1.0), FRACTION, w.rules)


# model A on the training stretch of buildings with at least 2000 usable rows
MODEL_A_SQL = """mt AS (SELECT * FROM (SELECT building, power_w, occupancy, hour, row_number() OVER (PARTITION BY building ORDER BY ts) - 1 AS pos,
    count(*) OVER (PARTITION BY building) AS n FROM buildings WHERE usable) WHERE n >= 2000 AND pos < floor(7e-1 * n)),
  ma AS (SELECT building, regr_intercept(power_w, occupancy) AS a, regr_slope(power_w, occupancy) AS b,
    regr_r2(power_w, occupancy) AS r2, avg(power_w) AS mp, quantile_cont(power_w, 0.5) FILTER (WHERE hour BETWEEN 2 AND 5) AS nm FROM mt GROUP BY building)"""


def _coefs(w):
    return models.model_a(w.buildings, rules=w.rules)


@query("m01_model_a", sql(f"""SELECT building, {i('any_value(u)', 'usable_rows')}, any_value(CASE WHEN u < 2000 THEN 'fewer than 2000 usable rows' END) AS reason, {i('nullif(count(mt.pos), 0)', 'n')}, {rs(('any_value(a)', 'a_base_load_w'), ('any_value(b)', 'b_watts_per_occupant'), ('any_value(r2)', 'r2_in_sample'),
    ('any_value(mp)', 'mean_power_w'), ('any_value(nm)', 'night_median_w'), ('100 * any_value(a) / any_value(mp)', 'base_load_pct_of_mean'))}
  FROM (SELECT building, count(*) FILTER (WHERE usable) AS u FROM buildings GROUP BY 1) LEFT JOIN ma USING (building) LEFT JOIN mt USING (building)
  GROUP BY building""", "buildings", extra=MODEL_A_SQL))
def _(w):
    return _coefs(w)


@query("a41_headline", sql(f"""
  SELECT building, building_kind, {rs('threshold', ('1e2 * intervals_total / n', 'coverage_pct'), 'total_kwh', 'low_occ_kwh', 'share_pct',
    'pct_intervals_low', ('mean_power_all_w / 1e3', 'mean_power_kw'), ('mean_power_low_w / 1e3', 'mean_power_low_kw'), (RATIO, 'intensity_ratio'),
    ('a / 1e3', 'base_load_kw'), ('b', 'watts_per_occupant'))}
  FROM share LEFT JOIN ma USING (building) JOIN (SELECT building, building_kind, count(*) AS n FROM buildings GROUP BY 1, 2) USING (building)""",
    "buildings", extra=share_sql("25e-2") + ", " + MODEL_A_SQL))
def _(w):
    return headline.headline_table(w.buildings, _coefs(w), FRACTION, w.rules)


BASE_SQL = """base AS (SELECT building, a / 1e3 AS base_load_kw, night_median_w / 1e3 AS night_kw, allp / 1e3 AS mean_power_kw
  FROM ma JOIN night USING (building) JOIN (SELECT building, avg(power_w) AS allp FROM buildings WHERE usable GROUP BY 1) USING (building))"""


@query("a41_base_load", sql(f"""
  SELECT building, {rs('base_load_kw', 'night_kw', ('base_load_kw - night_kw', 'difference_kw'), ('100 * (base_load_kw - night_kw) / night_kw', 'difference_pct'),
    'mean_power_kw', ('100 * base_load_kw / mean_power_kw', 'base_load_pct_of_mean'))} FROM base""", "buildings",
    extra=", ".join([MODEL_A_SQL, NIGHT_SQL, BASE_SQL])))
def _(w):
    return headline.base_load_table(w.buildings, _coefs(w))


@query("w01_responsiveness", sql(f"""
  SELECT building, {r('v', 'variable_share_pct')}, {i('rank() OVER (ORDER BY v DESC NULLS LAST)', 'responsiveness_rank')},
    {r('ir', 'intensity_ratio')}, {i('CASE WHEN ir IS NOT NULL THEN rank() OVER (ORDER BY ir ASC NULLS LAST) END', 'measured_rank')},
    CASE WHEN abs(dp) > 25 THEN 'NO -- extrapolated' ELSE 'yes' END AS model_a_reliable
  FROM (SELECT building, round_even(100 * (mean_power_kw - base_load_kw) / mean_power_kw, 1) AS v, {RATIO} AS ir,
      100 * (base_load_kw - night_kw) / night_kw AS dp FROM base JOIN share USING (building))""", "buildings",
    extra=", ".join([MODEL_A_SQL, NIGHT_SQL, BASE_SQL, share_sql("25e-2")])))
def _(w):
    return headline.responsiveness_table(w.buildings, _coefs(w), FRACTION, w.rules)


@query("a31_kind_summary", sql(f"""
  SELECT building_kind, {i('count(*)', 'buildings')}, {rs(('avg(share_pct)', 'mean_share_pct'), (f'avg({RATIO})', 'mean_intensity_ratio'),
    ('avg(a / 1e3)', 'mean_base_load_kw'), ('sum(total_kwh)', 'total_kwh'))}
  FROM share LEFT JOIN ma USING (building) JOIN (SELECT DISTINCT building, building_kind FROM buildings) USING (building) GROUP BY 1""", "buildings",
    extra=share_sql("25e-2") + ", " + MODEL_A_SQL))
def _(w):
    return headline.kind_summary(headline.headline_table(w.buildings, _coefs(w), FRACTION, w.rules))


@query("a41_clock_against_occupancy", sql(f"""
  SELECT building, {rs(('100 * out_of_hours_kwh / o.total_kwh', 'clock_share_pct'), 'pct_intervals_out_of_hours', ('share_pct', 'occupancy_share_pct'), 'pct_intervals_low')}
  FROM ooh o JOIN share USING (building)""", "buildings", extra=share_sql("25e-2") + ", " + OOH_SQL))
def _(w):
    return headline.clock_against_occupancy(w.buildings, FRACTION, w.rules)


# ---------------------------------------------------------------------- weather
@query("f13_temperature_response", sql(f"""
  SELECT building, {', '.join(r(f'CASE WHEN count(*) FILTER (WHERE temp_c >= {a} AND temp_c < {b}) > 200 THEN avg(power_w) FILTER (WHERE temp_c >= {a} AND temp_c < {b}) END', f'band_{a}_{b}') for a, b in ((0, 15), (15, 20), (20, 25), (25, 30), (30, 35), (35, 40), (40, 50)))},
    {rs(('100 * (avg(power_w) FILTER (WHERE temp_c >= 30) / avg(power_w) FILTER (WHERE temp_c BETWEEN 15 AND 25) - 1)', 'hot_vs_mild_pct'), ('corr(power_w, temp_c)', 'r_power_temp'))}, {i('count(*) FILTER (WHERE temp_c < 0 OR temp_c >= 50)', 'n_outside')}
  FROM buildings WHERE usable AND temp_c IS NOT NULL GROUP BY building""", "buildings"))
def _(w):
    return weather.temperature_response(w.buildings.filter("usable"), ["building"])


@query("j09_band_means", sql(f"""
  SELECT building, CASE WHEN lo = -1e9 THEN 'below 0C' WHEN hi = 1e9 THEN 'from 50C' ELSE lo::INT || '-' || hi::INT || 'C' END AS band,
    {i('count(power_w)', 'n')}, {r('avg(power_w)', 'mean_power_w')}
  FROM buildings JOIN (VALUES (-1e9,0),(50,1e9),(0,15),(15,20),(20,25),(25,30),(30,35),(35,40),(40,50)) b(lo, hi) ON temp_c >= lo AND temp_c < hi
  WHERE usable GROUP BY 1, 2""", "buildings"))
def _(w):
    return weather.band_means(w.buildings.filter("usable"), ["building"])


@query("j09_overlapping_bands", sql(f"""
  SELECT building, p_brand AS band, {i('count(power_w)', 'n')}, {rs(('avg(power_w)', 'mean_power_w'), ('min(temp_c)', 'min_temp_c'), ('max(temp_c)', 'max_temp_c'))}
  FROM buildings JOIN (SELECT p_brand, min(p_size)::DOUBLE AS lo, min(p_size) + 1 + avg(p_size) / 2e0 AS hi FROM part GROUP BY 1) b ON temp_c >= lo AND temp_c < hi
  WHERE usable GROUP BY 1, 2""", "buildings"))
def _(w):
    """Power by temperature bands that overlap, given as a table: one band per part brand."""
    size = F.col("p_size")
    bands = w.table("part").groupBy(F.col("p_brand").alias("band")).agg(
        F.min(size).cast("double").alias("lo"), (F.min(size) + 1 + F.avg(size) / 2).alias("hi"))
    d = intervals.covering(w.buildings.filter("usable"), bands, "temp_c", "lo", "hi")
    return d.groupBy("building", "band").agg(F.count("power_w").alias("n"), F.avg("power_w").alias("mean_power_w"),
                                             F.min("temp_c").alias("min_temp_c"), F.max("temp_c").alias("max_temp_c"))


@query("j09_long_events", sql(f"""
  SELECT event_id, {i('count(b.ts)', 'blocks')}, {i('count(power_w)', 'n')}, {r('avg(power_w)', 'mean_power_w')}
  FROM (SELECT event_id, event_type AS meter, ts AS a, ts + to_minutes(k * 600) AS z FROM ev WHERE k % 10 = 0) e
  LEFT JOIN blocks b ON b.meter = e.meter AND b.ts >= a AND b.ts < z GROUP BY 1 HAVING count(b.ts) > 0""", "blocks"))
def _(w):
    """Power of a meter's blocks while an event holds, of none to 37 days; events overlap."""
    k = F.col("k")
    e = R.events(w.spark, w.sf_dir).filter(k % 10 == 0).select("event_id", F.col("event_type").alias("meter"), F.col("ts").alias("start"),
                                                              (F.col("ts") + F.make_dt_interval(mins=(k * 600).cast("int"))).alias("end"))
    d = intervals.covering(w.blocks.select("meter", "ts", "power_w"), e, "ts", "start", "end", ["meter"])
    return d.groupBy("event_id").agg(F.count(F.lit(1)).alias("blocks"), F.count("power_w").alias("n"), F.avg("power_w").alias("mean_power_w"))


@query("a35_weather_coverage", sql(f"""
  SELECT {is_(('count(*)', 'intervals'), ('count(temp_c)', 'with_temperature'))}, {rs(('1e2 * count(temp_c) / count(*)', 'pct_covered'), ('min(temp_c)', 'min_temp_c'), ('max(temp_c)', 'max_temp_c'))}
  FROM (SELECT DISTINCT ts FROM occ) LEFT JOIN wx USING (ts)""", "occ", "wx"))
def _(w):
    return weather.coverage(w.weather, w.occupancy)


@query("a35_monthly_temperature", sql(f"""
  SELECT month(ts)::BIGINT AS month, {rs(('avg(temp_c)', 'mean_c'), ('min(temp_c)', 'min_c'), ('max(temp_c)', 'max_c'))} FROM wx GROUP BY 1""", "wx"))
def _(w):
    return weather.monthly_temperature(w.weather)


PERIOD_SQL = """pt AS (SELECT building, period, count(power_w) AS n, avg(power_w) AS m, avg(temp_c) AS mt,
    count(power_w) FILTER (WHERE temp_c BETWEEN 22 AND 28) AS nm, avg(power_w) FILTER (WHERE temp_c BETWEEN 22 AND 28) AS mm
  FROM buildings WHERE usable AND temp_c IS NOT NULL GROUP BY 1, 2)"""


def _period(w):
    return weather.period_at_matched_temperature(w.buildings.filter("usable"), ["building"], 22, 28)


@query("a34_period_at_matched_temperature", sql(f"SELECT building, period, {is_('n', ('nm', 'n_matched'))}, {rs(('m', 'mean_power_w'), ('mt', 'mean_temp_c'), ('mm', 'mean_power_matched_w'))} FROM pt",
                                                "buildings", extra=PERIOD_SQL))
def _(w):
    return _period(w)


@query("a34_period_gap", sql(f"""SELECT v.building, {rs(('100 * (v.m / s.m - 1)', 'raw_gap_pct'), ('100 * (v.mm / s.mm - 1)', 'matched_gap_pct'))}
  FROM pt v JOIN pt s USING (building) WHERE v.period = 'vacation' AND s.period = 'semester'""", "buildings", extra=PERIOD_SQL))
def _(w):
    return weather.period_gap(_period(w), ["building"])


@query("m12_base_temperature", sql(f"""
  SELECT building, {i('n')}, {rs('base_c', 'r2', ('s', 'slope_w_per_degree_hour'), ('ic', 'intercept_w'))}
  FROM (SELECT *, row_number() OVER (PARTITION BY building ORDER BY r2 DESC, base_c) AS rn FROM (
    SELECT building, b::DOUBLE AS base_c, count(*) AS n, max(x) AS top, regr_r2(power_w, x) AS r2, regr_slope(power_w, x) AS s, regr_intercept(power_w, x) AS ic
    FROM (SELECT building, power_w, b, greatest(temp_c - b, 0e0) / 6e0 AS x FROM buildings, range(16, 31) q(b)
      WHERE usable AND temp_c IS NOT NULL) GROUP BY 1, 2) WHERE top > 0) WHERE rn = 1""", "buildings"))
def _(w):
    return weather.fit_base_temperature(w.buildings.filter("usable"), ["building"], rules=w.rules)


DECOMPOSE_SQL = """lo AS (SELECT b.building, hour, power_w, temp_c FROM buildings b JOIN thr USING (building)
    WHERE usable AND temp_c IS NOT NULL AND occupancy <= round_even(thr, 2)),
ln AS (SELECT building, count(lo.hour) AS n FROM (SELECT DISTINCT building FROM buildings) LEFT JOIN lo USING (building) GROUP BY 1),
fits AS (SELECT building, b::DOUBLE AS base_c, sum(sy) / sum(n) AS my, sum(sx) / sum(n) AS mx, coalesce(sum(xy) / nullif(sum(xx), 0), 0e0) AS s,
    1 - (sum(yy) - coalesce(sum(xy) / nullif(sum(xx), 0), 0e0) * sum(xy)) / (sum(sy2) - sum(sy) * sum(sy) / sum(n)) AS r2, max(top) AS top
  FROM (SELECT building, b, hour, count(*) AS n, sum(power_w) AS sy, sum(power_w * power_w) AS sy2, sum(x) AS sx, max(x) AS top,
      regr_sxx(power_w, x) AS xx, regr_sxy(power_w, x) AS xy, regr_syy(power_w, x) AS yy
    FROM (SELECT building, hour, power_w, b, greatest(temp_c - b, 0e0) / 6e0 AS x FROM lo, range(16, 31) q(b)) GROUP BY 1, 2, 3) GROUP BY 1, 2),
best AS (SELECT * FROM (SELECT f.*, row_number() OVER (PARTITION BY building ORDER BY r2 DESC, base_c) AS rn
  FROM fits f JOIN ln USING (building) WHERE top > 0 AND n >= 100) WHERE rn = 1)"""


@query("m13_decompose_low_occupancy", sql(f"""
  SELECT building, {i('n')}, {rs('base_c', 'r2', ('my / 1e3', 'mean_power_kw'), ('CASE WHEN s > 0 THEN (my - s * mx) / 1e3 END', 'schedule_kw'),
    ('CASE WHEN s > 0 THEN s * mx / 1e3 END', 'weather_kw'), ('CASE WHEN s > 0 THEN 100 * s * mx / my END', 'weather_share_pct'),
    ('s', 'slope_w_per_degree_hour'), ('CASE WHEN s > 0 THEN mx END', 'mean_cdh'))}, coalesce(s > 0, false) AS identifiable
  FROM ln LEFT JOIN best USING (building)""", "buildings", extra=share_sql("25e-2") + ", " + DECOMPOSE_SQL))
def _(w):
    d = experiment.with_low_threshold(w.buildings, w.buildings, FRACTION, w.rules)
    low = F.col("usable") & C.is_low("occupancy", F.col("low_threshold"))
    return weather.decompose_low_occupancy(d, low, ["building"], rules=w.rules, min_rows=100).drop("reason")
