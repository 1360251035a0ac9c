"""Coverage, profiles, drift, ranking, set operations and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import roles as R
from catalog.registry import query
from catalog.sql import d, i, is_, normal_sql, r, rs, sql, t, t_sql
from voltloom.functions import columns as C
from voltloom.operators import blocks, compare, features, profile, samples, stats

METERS = ["click", "error", "purchase", "signup", "view"]
PRICE = "l_extendedprice"


# ------------------------------------------------------------------- coverage
@query("a24_reading_profile", sql(f"""
  SELECT meter, {is_('rows', 'span_days', 'expected_minutes', ('gaps', 'gaps_over_1min'))}, {t('f', 'first')}, {t('l', 'last')},
    {rs('power_min_w', 'power_mean_w', 'power_max_w', 'power_zero_pct', 'power_na_pct', 'pf_negative_pct', 'pf_min', 'pf_max',
        'voltage_out_of_range_pct', 'voltage_min', 'voltage_max', 'current_na_pct', ('1e2 * rows / expected_minutes', 'row_coverage_pct'),
        ('largest / 36e2', 'largest_gap_hours'))}
  FROM (SELECT meter, count(*) AS rows, min(ts) AS f, max(ts) AS l, (max(s) - min(s)) // 86400 + 1 AS span_days,
      round_even((max(s) - min(s)) / 6e1 + 1, 0)::BIGINT AS expected_minutes, count(*) FILTER (WHERE step > 60) AS gaps, max(step) AS largest,
      min(power) AS power_min_w, avg(power) AS power_mean_w, max(power) AS power_max_w,
      1e2 * count(*) FILTER (WHERE power = 0) / count(*) AS power_zero_pct, 1e2 * count(*) FILTER (WHERE power IS NULL) / count(*) AS power_na_pct,
      1e2 * count(*) FILTER (WHERE power_factor < 0) / count(*) AS pf_negative_pct, min(power_factor) AS pf_min, max(power_factor) AS pf_max,
      1e2 * count(*) FILTER (WHERE voltage < 180 OR voltage > 270) / count(*) AS voltage_out_of_range_pct, min(voltage) AS voltage_min,
      max(voltage) AS voltage_max, 1e2 * count(*) FILTER (WHERE current IS NULL) / count(*) AS current_na_pct
    FROM (SELECT *, s - lag(s) OVER (PARTITION BY meter ORDER BY s) AS step FROM (
      SELECT *, epoch(date_trunc('second', ts))::BIGINT AS s FROM readings)) GROUP BY meter)""", "readings"))
def _(w):
    return profile.profile_readings(w.readings, rules=w.rules)


@query("a25_occupancy_profile", sql(f"""
  SELECT building, {is_(('count(*)', 'rows'), ('(max(s) - min(s)) // 600 + 1', 'expected_10min_steps'), ('(max(s) - min(s)) // 86400 + 1', 'span_days'))},
    {t('min(ts)', 'first')}, {t('max(ts)', 'last')},
    {rs(('min(occupancy)', 'occ_min'), ('any_value(p05)', 'occ_p05'), ('any_value(p50)', 'occ_median'), ('avg(occupancy)', 'occ_mean'),
        ('any_value(p95)', 'occ_p95'), ('max(occupancy)', 'occ_max'), ('any_value(5e-2 * p95)', 'low_occ_threshold'),
        ('1e2 * count(*) FILTER (WHERE occupancy <= 5e-2 * p95) / count(*)', 'pct_rows_at_or_below_threshold'),
        ('1e2 * count(*) / ((max(s) - min(s)) // 600 + 1)', 'row_coverage_pct'))}, bool_and(s % 600 = 0) AS aligned_to_10min
  FROM (SELECT *, epoch(ts)::BIGINT AS s FROM occraw) JOIN (SELECT building, quantile_cont(occupancy, 0.05) AS p05,
    quantile_cont(occupancy, 0.5) AS p50, quantile_cont(occupancy, 0.95) AS p95 FROM occraw GROUP BY 1) USING (building) GROUP BY building""", "occ"))
def _(w):
    return profile.profile_occupancy(w.occupancy_raw, rules=w.rules)


def _orders_monthly(w):
    o = w.table("orders").select(F.col("o_orderpriority").alias("source"), F.col("o_orderdate").alias("ts"))
    return profile.monthly_coverage(o, ["source"], 2)


ORDERS_MONTHLY = """om AS (SELECT o_orderpriority AS source, date_trunc('month', o_orderdate)::DATE AS month, count(*) AS readings,
    least(1e2, 1e2 * count(*) / (day(last_day(min(o_orderdate::DATE))) * 2)) AS coverage_pct FROM orders GROUP BY 1, 2)"""


@query("a21_monthly_coverage", sql(f"SELECT source, {d('month')}, {i('readings')}, {r('coverage_pct', 'coverage_pct')} FROM om", extra=ORDERS_MONTHLY))
def _(w):
    return _orders_monthly(w)


# the span of the months, one row per source and month
GRID_SQL = """g AS (SELECT s.source, m.month FROM (SELECT DISTINCT source FROM om) s,
    (SELECT unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH))::DATE AS month FROM om) m),
    gm AS (SELECT g.source, g.month, coverage_pct FROM g LEFT JOIN om ON om.source = g.source AND om.month = g.month)"""


@query("a22_coverage_matrix", sql(f"SELECT source, strftime(month, '%Y-%m') AS month, {r('coverage_pct', 'coverage_pct')} FROM gm", extra=f"{ORDERS_MONTHLY}, {GRID_SQL}"))
def _(w):
    """The matrix over all months, its cells as rows."""
    wide = profile.coverage_matrix(_orders_monthly(w), "source")
    return wide.unpivot(["source"], wide.columns[1:], "month", "coverage_pct")


CUSTOMERS_MONTHLY = ORDERS_MONTHLY.replace("o_orderpriority AS source", "o_custkey::VARCHAR AS source")


@query("a27_blank_months", sql(f"""
  SELECT source, {i('count(*)', 'blank_months')}, {d('min(month)', 'first_blank')}, {d('max(month)', 'last_blank')}
  FROM gm WHERE coverage_pct IS NULL OR coverage_pct < 1 GROUP BY source""", extra=f"{CUSTOMERS_MONTHLY}, {GRID_SQL}"))
def _(w):
    """Months without an order of a customer."""
    o = w.table("orders").select(F.col("o_custkey").cast("string").alias("source"), F.col("o_orderdate").alias("ts"))
    return profile.blank_months(profile.monthly_coverage(o, ["source"], 2), None, "source")


STATUS_SQL = "SELECT {d}, meter, {r} FROM (SELECT ts, meter, present FROM (SELECT ts, " + ", ".join(
    f"(count(power) FILTER (WHERE meter = '{m}') > 0)::INT AS \"{m}\"" for m in METERS) + (
    " FROM (SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS ts, meter, power FROM clean) GROUP BY ts) UNPIVOT (present FOR meter IN (click, error, purchase, signup, \"view\"))) GROUP BY 1, 2")


def _status(w):
    wide = (blocks.invalidate(w.readings, w.rules).groupBy(C.block_start("ts").alias("ts"))
            .pivot("meter", METERS).agg(F.count("power")))
    return wide.select("ts", *[F.coalesce((F.col(m) > 0).cast("int"), F.lit(0)).alias(m) for m in METERS])


@query("a23_status_coverage", sql(STATUS_SQL.format(d=d("date_trunc('month', ts)", "month"), r=r("100 * avg(present)", "coverage_pct")), "clean"))
def _(w):
    return profile.status_coverage(_status(w), METERS)


@query("a23_low_status_months", sql(f"""SELECT month, meter, coverage_pct FROM ({STATUS_SQL.format(d=d("date_trunc('month', ts)", "month"),
    r=r("100 * avg(present)", "coverage_pct"))}) WHERE coverage_pct < 50""", "clean"))
def _(w):
    return profile.low_coverage(profile.status_coverage(_status(w), METERS))


@query("a26_overlap_window", f"""
  SELECT {t('greatest((SELECT min(ts) FROM events), (SELECT min(o_orderdate) FROM orders))', 'start')},
    {t('least((SELECT max(ts) FROM events), (SELECT max(l_shipdate) FROM lineitem))', '"end"')}""")
def _(w):
    span = lambda n, c: w.table(n).agg(F.min(c).alias("first"), F.max(c).alias("last"))
    e = span("events", "ts")
    o = span("orders", "o_orderdate").select("first", F.lit(None).cast("timestamp_ntz").alias("last")).unionByName(
        span("lineitem", "l_shipdate").select(F.lit(None).cast("timestamp_ntz").alias("first"), "last"))
    return profile.overlap_window(e, o)


@query("a36_month_nearest_half", f"""
  SELECT o_orderstatus, {d('month')}, {r('m', 'mean_flag')} FROM (
    SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY abs(m - 5e-1), month) AS rn FROM (
      SELECT o_orderstatus, date_trunc('month', o_orderdate)::DATE AS month,
        avg((month(o_orderdate) % 2 = day(o_orderdate) % 2)::INT::DOUBLE) AS m FROM orders GROUP BY 1, 2)) WHERE rn = 1""")
def _(w):
    flag = F.month("o_orderdate") % 2 == F.dayofmonth("o_orderdate") % 2
    return profile.month_nearest_half(w.table("orders"), ["o_orderstatus"], flag, "o_orderdate")


# ----------------------------------------------------------- profiles and drift
@query("a29_mean_power_by_hour", sql("SELECT hour, " + ", ".join(
    r(f"avg(power_w) FILTER (WHERE building = '{b}')", b) for b in R.BUILDINGS) + " FROM buildings WHERE usable GROUP BY hour", "buildings"))
def _(w):
    return profile.mean_by(w.buildings, "hour", "building", list(R.BUILDINGS))


@query("a29_mean_power_by_weekday_period", sql("SELECT weekday, " + ", ".join(
    r(f"avg(power_w) FILTER (WHERE period = '{p}')", p) for p in ("semester", "vacation")) + " FROM buildings WHERE usable GROUP BY weekday", "buildings"))
def _(w):
    return profile.mean_by(w.buildings, "weekday", "period", ["semester", "vacation"])


@query("a29_building_summary", sql(f"""
  SELECT building, {i('count(*)', 'intervals')}, {rs(('avg(power_w)', 'mean_power_w'), ('quantile_cont(power_w, 0.5)', 'median_power_w'),
    ('sum(kwh)', 'total_kwh'), ('avg(occupancy)', 'mean_occupancy'))} FROM buildings WHERE usable GROUP BY building""", "buildings"))
def _(w):
    return profile.summary_by(w.buildings, ["building"])


@query("a30_daily_energy", sql(f"SELECT building, {d('date')}, {r('sum(kwh)', 'kwh')} FROM buildings WHERE usable GROUP BY building, buildings.date", "buildings"))
def _(w):
    return profile.daily_energy(w.buildings)


@query("a30_mean_daily_energy", sql(f"""SELECT building, {r('avg(k)', 'mean_daily_kwh')} FROM (
  SELECT building, date, sum(kwh) AS k FROM buildings WHERE usable GROUP BY 1, 2) GROUP BY 1""", "buildings"))
def _(w):
    return profile.mean_daily_energy(w.buildings)


@query("a30_energy_share", sql(f"""SELECT building, {rs(('sum(kwh)', 'kwh'), ('100 * sum(kwh) / sum(sum(kwh)) OVER ()', 'share_pct'))}
  FROM buildings WHERE usable GROUP BY building""", "buildings"))
def _(w):
    return profile.energy_share(w.buildings)


DRIFT_SQL = f"""dr AS (SELECT l_returnflag, year(l_shipdate)::BIGINT AS year, count({PRICE}) AS n, avg({PRICE}) AS m, corr({PRICE}, l_quantity) AS rr
  FROM lineitem GROUP BY 1, 2)"""


def _drift(w):
    return profile.drift(w.table("lineitem"), ["l_returnflag"], PRICE, F.year("l_shipdate"), "l_quantity")


@query("a28_yearly_drift", sql(f"""SELECT l_returnflag, year, {i('n')}, {rs(('m', 'mean'), ('rr', 'r'),
  ('100 * (m / first_value(m) OVER (PARTITION BY l_returnflag ORDER BY year) - 1)', 'vs_first_year_pct'))} FROM dr""", extra=DRIFT_SQL))
def _(w):
    return _drift(w)


@query("a28_drift_side_by_side", sql("SELECT l_returnflag, " + rs(*[(f"max(m) FILTER (WHERE year = {y})", f"mean_{y}") for y in range(1995, 2002)],
    ("100 * (arg_max(m, year) / arg_min(m, year) - 1)", "growth_pct"), ("max(rr) FILTER (WHERE year = 1995)", "r_1995"),
    ("max(rr) FILTER (WHERE year = 2001)", "r_2001")) + " FROM dr GROUP BY 1", extra=DRIFT_SQL))
def _(w):
    return profile.drift_wide(_drift(w), ["l_returnflag"], list(range(1995, 2002)))


@query("a32_semester_check", f"""
  SELECT o_orderpriority, {rs(('ms', 'median_semester'), ('mv', 'median_vacation'), ('mv / ms', 'ratio'))}, {is_(('ns', 'n_semester'), ('nv', 'n_vacation'))}
  FROM (SELECT o_orderpriority, quantile_cont(occ, 0.5) FILTER (WHERE NOT v) AS ms, quantile_cont(occ, 0.5) FILTER (WHERE v) AS mv,
      count(*) FILTER (WHERE NOT v) AS ns, count(*) FILTER (WHERE v) AS nv
    FROM (SELECT o_orderpriority, (o_custkey % 50)::DOUBLE AS occ, ((month(o_orderdate)*100+day(o_orderdate)) BETWEEN 516 AND 731
      OR (month(o_orderdate)*100+day(o_orderdate)) BETWEEN 1216 AND 1231 OR (month(o_orderdate)*100+day(o_orderdate)) = 101) AS v FROM orders) GROUP BY 1)""")
def _(w):
    o = w.table("orders").select("o_orderpriority", F.col("o_orderdate").alias("ts"), (F.col("o_custkey") % 50).cast("double").alias("occupancy"))
    return features.semester_check(o, ["o_orderpriority"])


@query("a32_monthly_occupancy", f"""
  SELECT o_orderpriority, month(o_orderdate)::BIGINT AS month, {r('quantile_cont((o_custkey % 50)::DOUBLE, 0.5)', 'median_occupancy')} FROM orders GROUP BY 1, 2""")
def _(w):
    o = w.table("orders").select("o_orderpriority", F.col("o_orderdate").alias("ts"), (F.col("o_custkey") % 50).cast("double").alias("occupancy"))
    return features.monthly_occupancy(o, ["o_orderpriority"])


@query("a33_calendar_agreement", f"""
  SELECT {i('count(*)', 'days_compared')}, {rs(('1e2 * avg((low = vac)::INT)', 'agreement_pct'), ('1e2 * avg(low::INT)', 'official_low_activity_pct'),
    ('1e2 * avg(vac::INT)', 'approximated_vacation_pct'))}
  FROM (SELECT DISTINCT o_orderdate::DATE, isodow(o_orderdate) >= 6 OR month(o_orderdate) IN (6, 7) AS low,
    ((month(o_orderdate)*100+day(o_orderdate)) BETWEEN 516 AND 731 OR (month(o_orderdate)*100+day(o_orderdate)) BETWEEN 1216 AND 1231
      OR (month(o_orderdate)*100+day(o_orderdate)) = 101) AS vac FROM orders)""")
def _(w):
    o = w.table("orders")
    day = F.to_date("o_orderdate")
    low = (F.weekday(day) >= 5) | F.month(day).isin(6, 7)
    cal = o.select(day.alias("date"), F.when(low, "L").otherwise("H").alias("activity")).distinct()
    return features.calendar_agreement(o, cal, "o_orderdate")


@query("a37_histogram", f"""
  SELECT l_returnflag, least(59, floor((x - a) / ((b - a) / 6e1)))::BIGINT AS bin, {i('count(*)', 'n')},
    {r('any_value(a) + least(59, floor((x - a) / ((b - a) / 6e1))) * any_value((b - a) / 6e1)', 'left_edge')}
  FROM (SELECT l_returnflag, {PRICE} AS x, min({PRICE}) OVER (PARTITION BY l_returnflag) AS a, max({PRICE}) OVER (PARTITION BY l_returnflag) AS b FROM lineitem)
  GROUP BY 1, 2, least(59, floor((x - a) / ((b - a) / 6e1)))""")
def _(w):
    return profile.histogram(w.table("lineitem"), ["l_returnflag"], PRICE)


BOX = f"""bx AS (SELECT l_returnflag, quantile_cont({PRICE}, 0.25) AS q1, quantile_cont({PRICE}, 0.5) AS q2, quantile_cont({PRICE}, 0.75) AS q3 FROM lineitem GROUP BY 1)"""


@query("a37_box_statistics", sql(f"""
  SELECT l_returnflag, {rs(('any_value(q1)', 'q1'), ('any_value(q2)', 'median'), ('any_value(q3)', 'q3'),
    (f'min({PRICE}) FILTER (WHERE {PRICE} >= q1 - 15e-1 * (q3 - q1))', 'low_whisker'), (f'max({PRICE}) FILTER (WHERE {PRICE} <= q3 + 15e-1 * (q3 - q1))', 'high_whisker'))},
    {i(f'count(*) FILTER (WHERE {PRICE} < q1 - 15e-1 * (q3 - q1) OR {PRICE} > q3 + 15e-1 * (q3 - q1))', 'outside')}
  FROM lineitem JOIN bx USING (l_returnflag) GROUP BY 1""", extra=BOX))
def _(w):
    return profile.box_statistics(w.table("lineitem"), ["l_returnflag"], PRICE)


def _hash_order(text: str, key: str) -> str:
    return f"substring(md5(concat('42|', {text})), 1, 15), {key}"


@query("a37_plot_sample", f"""
  SELECT event_id, {r('value', 'value')} FROM events ORDER BY {_hash_order('event_id', 'event_id')} LIMIT 6000""")
def _(w):
    return profile.plot_sample(w.table("events"), "event_id", 6000).select("event_id", "value")


@query("a37_keyed_sample", f"""
  SELECT event_type, event_id, {r('value', 'value')} FROM events
  QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY {_hash_order('event_id', 'event_id')}) <= 500""")
def _(w):
    """500 events of each type, from the samples of each weekday's events."""
    e = w.table("events").select("event_type", "event_id", "value", F.weekday("ts").alias("day"))
    days = [samples.sample(e.filter(F.col("day") == n), ["event_id"], 500, ["event_type"]) for n in range(7)]
    return samples.merge_samples(days, ["event_id"], 500, ["event_type"]).drop("day")


@query("f18_clip_for_display", f"""
  SELECT l_returnflag, {i(f'count(*) FILTER (WHERE {PRICE} > cap)', 'above')}, {rs(('max(cap)', 'cap'), (f'avg(least({PRICE}, cap))', 'mean_clipped'))}
  FROM lineitem JOIN (SELECT l_returnflag, quantile_cont({PRICE}, 0.999) AS cap FROM lineitem GROUP BY 1) USING (l_returnflag) GROUP BY 1""")
def _(w):
    c = profile.clip_at(w.table("lineitem"), ["l_returnflag"], PRICE)
    return c.groupBy("l_returnflag").agg(F.count_if("above").alias("above"), F.max("cap").alias("cap"),
                                         F.avg(f"{PRICE}_clipped").alias("mean_clipped"))


@query("a38_value_counts", sql(f"SELECT building, hour, {i('count(*)', 'n')} FROM buildings WHERE usable GROUP BY 1, 2", "buildings"))
def _(w):
    return profile.value_counts(w.buildings.filter("usable"), "building", "hour")


@query("a38_weekday_counts", sql(f"SELECT weekday, {i('count(*)', 'n')}, {i('max(day_of_week) + 1', 'day_order')} FROM buildings GROUP BY 1", "buildings"))
def _(w):
    return profile.weekday_counts(w.buildings)


@query("a43_meter_summary", sql(f"""SELECT meter, {i('count(power_w)', 'n')}, {rs(('avg(power_w)', 'mean'), ('stddev_samp(power_w)', 'std'),
  ('min(power_w)', 'min'), ('max(power_w)', 'max'))} FROM blocks GROUP BY meter""", "blocks"))
def _(w):
    p = "power_w"
    return w.blocks.groupBy("meter").agg(F.count(p).alias("n"), F.avg(p).alias("mean"), F.stddev_samp(p).alias("std"),
                                         F.min(p).alias("min"), F.max(p).alias("max"))


@query("a46_power_factor_check", sql(f"""SELECT meter, {i('count(power_factor)', 'n')}, {rs(('min(r.power_factor)', 'min_before'), ('avg(r.power_factor)', 'mean_before'),
  ('min(abs(r.power_factor))', 'min_after'), ('avg(abs(r.power_factor))', 'mean_after'))} FROM readings r GROUP BY meter""", "readings"))
def _(w):
    p = F.col("power_factor")
    return w.readings.groupBy("meter").agg(F.count(p).alias("n"), F.min(p).alias("min_before"), F.avg(p).alias("mean_before"),
                                           F.min(F.abs(p)).alias("min_after"), F.avg(F.abs(p)).alias("mean_after"))


@query("f14_date_slice", f"""
  SELECT event_type, {i('count(*)', 'n')}, {r('sum(value)', 'total')} FROM events
  WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 00:00:00' GROUP BY 1""")
def _(w):
    b = lambda s: F.lit(s).cast("timestamp_ntz")
    e = profile.time_slice(w.table("events"), b("2024-01-05 00:00:00"), b("2024-01-12 00:00:00"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("f14_padded_slice", sql(f"""
  SELECT building, {t('b.ts', 'ts')}, {r('power_w', 'power_w')}, {t('start')}
  FROM buildings b JOIN win USING (building) WHERE b.ts BETWEEN start - INTERVAL 12 HOUR AND "end" + INTERVAL 12 HOUR""", "buildings", extra="""win AS (
  SELECT building, arg_max(ts, (power_w, ts)) AS start, arg_max(ts, (power_w, ts)) + INTERVAL 1 HOUR AS "end" FROM buildings WHERE usable GROUP BY 1)"""))
def _(w):
    top = w.buildings.filter("usable").groupBy("building").agg(F.max_by("ts", F.struct("power_w", "ts")).alias("start"))
    win = top.withColumn("end", F.col("start") + F.make_dt_interval(hours=F.lit(1)))
    out = profile.padded_slice(w.buildings.select("building", "ts", "power_w"), win, "building", 12)
    return out.join(top, "building")


# ------------------------------------------------------- sorts, sets and diffs
@query("t03_busiest_blocks", sql(f"""SELECT building, {t('ts')}, {rs('power_w', 'occupancy')} FROM buildings WHERE usable
  ORDER BY buildings.power_w DESC, buildings.ts, building LIMIT 10""", "buildings"))
def _(w):
    return (w.buildings.filter("usable").orderBy(F.col("power_w").desc(), "ts", "building").limit(10)
            .select("building", "ts", "power_w", "occupancy"))


@query("t04_extreme_rows", sql(f"""SELECT building, {t('arg_max(ts, (power_w, ts))', 'busiest')}, {t('arg_min(ts, (power_w, ts))', 'quietest')}
  FROM buildings WHERE usable GROUP BY building""", "buildings"))
def _(w):
    o = F.struct("power_w", "ts")
    return w.buildings.filter("usable").groupBy("building").agg(F.max_by("ts", o).alias("busiest"), F.min_by("ts", o).alias("quietest"))


@query("s13_head_tail", f"""
  SELECT part, {t('ts')}, event_id FROM (SELECT * FROM (SELECT 'head' AS part, ts, event_id FROM events ORDER BY ts, event_id LIMIT 5)
    UNION ALL SELECT * FROM (SELECT 'tail', ts, event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 5))""")
def _(w):
    from voltloom.sources.readers import head_tail
    head, tail = head_tail(w.table("events"), 5, "ts", "event_id")
    pick = lambda f, n: f.select(F.lit(n).alias("part"), "ts", "event_id")
    return pick(head, "head").unionByName(pick(tail, "tail"))


@query("u03_keep_first", f"""
  SELECT user_id, {t('min(ts)', 'ts')}, {i('arg_min(event_id, ts)', 'event_id')} FROM events GROUP BY user_id""")
def _(w):
    return (w.table("events").groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("e"))
            .select("user_id", "e.ts", "e.event_id"))


@query("u04_u05_union_and_distinct_days", f"""
  SELECT {d('day')}, {i('count(*)', 'sources')} FROM (SELECT DISTINCT o_orderdate::DATE AS day, 'o' AS s FROM orders
    UNION SELECT DISTINCT l_shipdate::DATE, 'l' FROM lineitem) GROUP BY day""")
def _(w):
    a = w.table("orders").select(F.to_date("o_orderdate").alias("day"), F.lit("o").alias("s"))
    b = w.table("lineitem").select(F.to_date("l_shipdate").alias("day"), F.lit("l").alias("s"))
    return a.unionByName(b).distinct().groupBy("day").agg(F.count(F.lit(1)).alias("sources"))


@query("j07_semi_and_anti", f"""
  SELECT o_orderpriority, {is_(('count(*) FILTER (WHERE c_mktsegment IS NOT NULL)', 'inside'), ('count(*) FILTER (WHERE c_mktsegment IS NULL)', 'outside'))}
  FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) ON o_custkey = c_custkey GROUP BY 1""")
def _(w):
    rich = w.table("customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    o = w.table("orders")
    n = lambda how, a, b: (o.join(rich, "o_custkey", how).groupBy("o_orderpriority")
                           .agg(F.count(F.lit(1)).alias(a)).withColumn(b, F.lit(0).cast("bigint")))
    both = n("left_semi", "inside", "outside").unionByName(n("left_anti", "outside", "inside"))
    return both.groupBy("o_orderpriority").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))


@query("u07_table_diff", sql(f"""
  SELECT 'power_w' AS "column", {is_(('count(*) FILTER (WHERE b.meter IS NULL)', 'only_left'), ('count(*) FILTER (WHERE a.meter IS NULL)', 'only_right'),
    ('count(*) FILTER (WHERE a.meter IS NOT NULL AND b.meter IS NOT NULL AND (a.power_w IS NULL) <> (b.power_w IS NULL))', 'null_mismatches'))},
    {r('max(abs(a.power_w - b.power_w))', 'max_abs_diff')}, 0::BIGINT AS text_mismatches, false AS same
  FROM (SELECT meter, ts, power_w FROM blocks) a FULL JOIN (SELECT meter, CASE WHEN hour(ts) < 20 THEN ts ELSE ts + INTERVAL 1 SECOND END AS ts, power_filled_w AS power_w FROM filled) b
    ON a.meter = b.meter AND a.ts = b.ts""", "filled"))
def _(w):
    """The evening's rows are shifted by a second, so both sides have rows of their own."""
    ts = F.when(F.hour("ts") < 20, F.col("ts")).otherwise(F.expr("ts + INTERVAL 1 SECOND"))
    right = w.cleaned.select("meter", ts.alias("ts"), F.col("power_filled_w").alias("power_w"))
    return compare.table_diff(w.blocks.select("meter", "ts", "power_w"), right, ["meter", "ts"])


# ------------------------------------------------------------------- statistics
# ten digits or so of each, as sums of squares differ in the last bits
PLACES = {"variance": 0, "std": 5, "mean": 5, "skew": 6}


@query("a17_describe", f"""
  SELECT l_returnflag, {i('count(*)', 'n')}, {i('mode_count')}, {rs(*[(f'round({e}, {PLACES.get(n, 3)})', n) for e, n in (
    (f'avg({PRICE})', 'mean'), (f'min({PRICE})', 'min'), (f'max({PRICE})', 'max'), (f'max({PRICE}) - min({PRICE})', 'range'),
    (f'stddev_samp({PRICE})', 'std'), (f'var_samp({PRICE})', 'variance'), (f'skewness({PRICE})', 'skew'), (f'quantile_cont({PRICE}, 0.25)', 'q1'), (f'quantile_cont({PRICE}, 0.5)', 'median'),
    (f'quantile_cont({PRICE}, 0.75)', 'q3'), (f'quantile_cont({PRICE}, 0.75) - quantile_cont({PRICE}, 0.25)', 'iqr'), ('mode', 'mode'))])}
  FROM lineitem JOIN (SELECT l_returnflag, mode, mode_count FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY mode_count DESC, mode) AS rn FROM (
      SELECT l_returnflag, round_even({PRICE} / 1e3, 0) * 1e3 AS mode, count(*) AS mode_count FROM lineitem GROUP BY 1, 2)) WHERE rn = 1) USING (l_returnflag)
  GROUP BY l_returnflag, mode, mode_count""")
def _(w):
    s = stats.describe(w.table("lineitem"), ["l_returnflag"], PRICE, 1000.0)
    return s.select(*[F.round(c, PLACES.get(c, 3)).alias(c) if k == "double" else c for c, k in s.dtypes])


# Ranks depend on which values are equal, and means that agree to the last bit in one engine
# may not in the other; ranked power is therefore rounded first, in both.
RANKED_SQL = "rb AS (SELECT * REPLACE (round(power_w, 6) AS power_w) FROM buildings WHERE usable)"


def _ranked(w):
    return w.buildings.filter("usable").withColumn("power_w", F.round("power_w", 6))


SPEARMAN_SQL = RANKED_SQL + """, sp AS (SELECT building, power_w, occupancy,
    rank() OVER (PARTITION BY building ORDER BY power_w) + (count(*) OVER (PARTITION BY building, power_w) - 1) / 2e0 AS rx,
    rank() OVER (PARTITION BY building ORDER BY occupancy) + (count(*) OVER (PARTITION BY building, occupancy) - 1) / 2e0 AS ry
  FROM rb)"""


@query("a19_power_occupancy_correlation", sql(f"""
  SELECT building, {i('count(*)', 'n')}, {rs(('corr(power_w, occupancy)', 'pearson_r'), ('corr(rx, ry)', 'spearman_r'), ('corr(power_w, occupancy) * corr(power_w, occupancy)', 'r_squared'))}, NULL::VARCHAR AS reason
  FROM sp GROUP BY building HAVING count(*) >= 100
  UNION ALL SELECT building, {i('count(*)', 'n')}, NULL, NULL, NULL, 'fewer than 100 complete rows' FROM sp GROUP BY building HAVING count(*) < 100""", "buildings", extra=SPEARMAN_SQL))
def _(w):
    return stats.correlation(_ranked(w), ["building"], "power_w", "occupancy")


@query("w02_average_ranks", f"""
  SELECT l_returnflag, {r('v', '_v')}, {i('count(*)', '_count')}, {r('any_value(rk)', 'rank')} FROM (
    SELECT l_returnflag, l_quantity AS v, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity)
      + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2e0 AS rk FROM lineitem) GROUP BY 1, v""")
def _(w):
    from voltloom.operators.ranks import average_ranks
    return average_ranks(w.table("lineitem"), ["l_returnflag"], "l_quantity")


CORR_COLS = ["power_w", "occupancy", "temp_c", "relh", "cdh", "hour", "voltage", "power_factor", "power_lag_1h", "power_roll24h_mean"]


@query("a20_correlation_matrix", sql(" UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})', 'r')} FROM cm" for n, a in enumerate(CORR_COLS) for b in CORR_COLS[n + 1:]), "buildings",
    extra="cm AS (SELECT " + ", ".join(CORR_COLS) + " FROM buildings WHERE usable AND " + " AND ".join(f"{c} IS NOT NULL" for c in CORR_COLS) + ")"))
def _(w):
    return stats.correlation_matrix(w.buildings.filter("usable"), CORR_COLS)


GROUPS_SQL = RANKED_SQL + """, gx AS (SELECT building, power_w AS x, NOT is_weekend AS a,
    rank() OVER (PARTITION BY building ORDER BY power_w) + (count(*) OVER (PARTITION BY building, power_w) - 1) / 2e0 AS rk
  FROM rb),
gs AS (SELECT building, (count(*) FILTER (WHERE a))::DOUBLE AS na, (count(*) FILTER (WHERE NOT a))::DOUBLE AS nb, avg(x) FILTER (WHERE a) AS ma, avg(x) FILTER (WHERE NOT a) AS mb,
    var_samp(x) FILTER (WHERE a) AS va, var_samp(x) FILTER (WHERE NOT a) AS vb, quantile_cont(x, 0.5) FILTER (WHERE a) AS qa,
    quantile_cont(x, 0.5) FILTER (WHERE NOT a) AS qb, sum(rk) FILTER (WHERE a) AS ra FROM gx GROUP BY building),
gd AS (SELECT *, (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) AS cd FROM gs)"""
EFFECT = "CASE WHEN abs(cd) < 2e-1 THEN 'negligible' WHEN abs(cd) < 5e-1 THEN 'small' WHEN abs(cd) < 8e-1 THEN 'medium' ELSE 'large' END"


@query("h01_h02_compare_groups", sql(f"""
  SELECT building, {is_(('na', 'n_a'), ('nb', 'n_b'))}, {rs(('ma', 'mean_a'), ('mb', 'mean_b'), ('qa', 'median_a'), ('qb', 'median_b'), ('ma - mb', 'difference_in_means'),
    ('100 * (ma - mb) / mb', 'percent_difference'), ('(ma - mb) / sqrt(va / na + vb / nb)', 't_statistic'),
    ('(va/na + vb/nb) * (va/na + vb/nb) / (va/na * va/na / (na - 1) + vb/nb * vb/nb / (nb - 1))', 't_dof'),
    ('ra - na * (na + 1) / 2', 'u_statistic'), ('cd', 'cohens_d'))}, {EFFECT} AS effect_size_label FROM gd""", "buildings", extra=GROUPS_SQL))
def _(w):
    return stats.compare_groups(_ranked(w), ["building"], "power_w", ~F.col("is_weekend"))


# the larger U, corrected for continuity and ties, against the normal tail
PVALUE_SQL = GROUPS_SQL.replace("NOT is_weekend AS a", "NOT is_vacation AS a") + """, ti AS (SELECT building, sum(c * c * c - c) AS ties FROM
    (SELECT building, power_w, count(*)::DOUBLE AS c FROM rb GROUP BY 1, 2) GROUP BY 1),
gp AS (SELECT gd.*, (ma - mb) / sqrt(va / na + vb / nb) AS t, (va/na + vb/nb) * (va/na + vb/nb) / (va/na * va/na / (na - 1) + vb/nb * vb/nb / (nb - 1)) AS dof,
    ra - na * (na + 1) / 2 AS u, sqrt(na * nb / 12 * (na + nb + 1 - ties / ((na + nb) * (na + nb - 1)))) AS su FROM gd JOIN ti USING (building)),
gz AS (SELECT *, (greatest(u, na * nb - u) - na * nb / 2 - 5e-1) / su AS z FROM gp)"""


@query("h02_group_p_values", sql(f"""
  SELECT building, {is_(('na', 'n_a'), ('nb', 'n_b'))}, {rs(('ma', 'mean_a'), ('mb', 'mean_b'), ('qa', 'median_a'), ('qb', 'median_b'), ('ma - mb', 'difference_in_means'),
    ('100 * (ma - mb) / mb', 'percent_difference'), ('t', 't_statistic'), ('dof', 't_dof'), ('u', 'u_statistic'), ('cd', 'cohens_d'),
    (t_sql('t', 'dof'), 't_pvalue'), (f"least(1e0, CASE WHEN z > 0 THEN 2 - 2 * {normal_sql('z', 2000)} ELSE 1 END)", 'mannwhitney_pvalue'))}, {EFFECT} AS effect_size_label
  FROM gz""", "buildings", extra=PVALUE_SQL))
def _(w):
    return stats.compare_groups(_ranked(w), ["building"], "power_w", ~F.col("is_vacation"), p_values=True)


@query("a19_correlation_p_values", sql(f"""
  SELECT building, {i('n')}, {rs(('p', 'pearson_r'), ('s', 'spearman_r'), ('p * p', 'r_squared'), (t_sql('tp', '(n - 2)'), 'pearson_p'), (t_sql('ts', '(n - 2)'), 'spearman_p'))}, NULL::VARCHAR AS reason
  FROM (SELECT *, p * sqrt((n - 2) / (1 - p * p)) AS tp, s * sqrt((n - 2) / (1 - s * s)) AS ts FROM
    (SELECT building, count(*) AS n, corr(power_w, occupancy) AS p, corr(rx, ry) AS s FROM sp GROUP BY building HAVING count(*) >= 100))
  UNION ALL SELECT building, {i('count(*)', 'n')}, NULL, NULL, NULL, NULL, NULL, 'fewer than 100 complete rows' FROM sp GROUP BY building HAVING count(*) < 100""", "buildings", extra=SPEARMAN_SQL))
def _(w):
    return stats.correlation(_ranked(w), ["building"], "power_w", "occupancy", p_values=True)


KS_SQL = f"""lx AS (SELECT l_returnflag, {PRICE} AS x FROM lineitem WHERE {PRICE} > 0),
lm AS (SELECT l_returnflag, count(*) AS n, avg(x) AS mu, stddev_pop(x) AS sd, avg(ln(x)) AS log_mu, stddev_pop(ln(x)) AS log_sd FROM lx GROUP BY 1),
ls AS (SELECT l_returnflag, avg(pow((x - mu) / sd, 3)) AS skew, avg(pow((x - mu) / sd, 4)) - 3 AS kurtosis FROM lx JOIN lm USING (l_returnflag) GROUP BY 1),
lv AS (SELECT l_returnflag, x, count(*) AS c, sum(count(*)) OVER (PARTITION BY l_returnflag ORDER BY x) AS upto FROM lx GROUP BY 1, 2),
lz AS (SELECT l_returnflag, n, c, upto, (x - mu) / sd AS z, (ln(x) - log_mu) / log_sd AS lz FROM lv JOIN lm USING (l_returnflag)),
lp AS (SELECT l_returnflag, n, c, upto, {normal_sql('z')} AS p, {normal_sql('lz')} AS lp FROM lz),
lk AS (SELECT l_returnflag, max(greatest(abs(p - (upto - c) / n), abs(upto / n - p))) AS ks_normal, max(greatest(abs(lp - (upto - c) / n), abs(upto / n - lp))) AS ks_lognormal FROM lp GROUP BY 1)"""


@query("h03_normal_and_lognormal", f"""WITH {KS_SQL} SELECT l_returnflag, {i('n')}, {rs('mu', 'sd', 'log_mu', 'log_sd', 'skew', 'kurtosis', 'ks_normal', 'ks_lognormal')},
  CASE WHEN ks_lognormal < ks_normal THEN 'log-normal' ELSE 'normal' END AS better_fit FROM lm JOIN ls USING (l_returnflag) JOIN lk USING (l_returnflag)""")
def _(w):
    return stats.fit_normal_and_lognormal(w.table("lineitem"), PRICE, ["l_returnflag"])


@query("h03_moments", f"""
  SELECT {i('count(*)', 'n')}, {rs(('round(avg(value), 4)', 'mu'), ('round(stddev_pop(value), 4)', 'sd'), ('avg(ln(value))', 'log_mu'), ('stddev_pop(ln(value))', 'log_sd'))}
  FROM events WHERE value > 0""")
def _(w):
    s = stats.fit_normal_and_lognormal(w.table("events"), "value")
    return s.select("n", F.round("mu", 4).alias("mu"), F.round("sd", 4).alias("sd"), "log_mu", "log_sd")


SAMPLE_SQL = """dk AS (SELECT building || '|' || date AS k, sum(kwh) AS x FROM buildings WHERE usable GROUP BY building, date),
nu AS (SELECT row_number() OVER (ORDER BY md5(k), k) - 1 AS at, x FROM dk),
sz AS (SELECT count(*) AS N, least(30, count(*)) AS m FROM nu),
sa AS (SELECT s AS sample, N, m FROM sz, generate_series(1, 1000) q(s)),
dr AS (SELECT sample, unnest(list_reduce(list_transform(range(N - m, N), lambda l: [l, ('0x' || substr(md5('42|' || sample || '|' || (l - (N - m))), 1, 15))::BIGINT % (l + 1)]),
    lambda a, x: CASE WHEN list_contains(a, x[2]) THEN list_append(a, x[1]) ELSE list_append(a, x[2]) END, []::BIGINT[])) AS at FROM sa),
me AS (SELECT sample, avg(x) AS m FROM dr JOIN nu ON nu.at = dr.at GROUP BY 1)"""


@query("h04_sampling_distribution", sql(f"""SELECT {is_(('(SELECT count(*) FROM nu)', 'population_n'), ('count(*)', 'n_samples'), ('30', 'sample_size'))},
  {rs(('avg(m)', 'mean_of_sample_means'), ('stddev_samp(m)', 'sd_of_sample_means'), ('(SELECT avg(x) FROM nu)', 'population_mean'),
      ('(SELECT stddev_samp(x) FROM nu)', 'population_sd'), ('(SELECT stddev_samp(x) FROM nu) / sqrt(30)', 'predicted_standard_error'), ('avg(m) - (SELECT avg(x) FROM nu)', 'bias'))}
  FROM me""", "buildings", extra=SAMPLE_SQL))
def _(w):
    daily = profile.daily_energy(w.buildings).withColumn("k", F.concat_ws("|", "building", "date"))
    return stats.sampling_distribution(daily, "k", "kwh", 30, 1000)


@query("f15_scaling", sql(f"""
  SELECT c AS "column", f AS form, {i('count(x)', 'n')}, {rs(('avg(x)', 'mean'), ('stddev_samp(x)', 'std'), ('min(x)', 'min'), ('max(x)', 'max'))}
  FROM (SELECT c, unnest(['original', 'minmax', 'standard']) AS f, unnest([v, (v - lo) / (hi - lo), (v - mu) / sd]) AS x FROM (
    SELECT c, v, min(v) OVER p AS lo, max(v) OVER p AS hi, avg(v) OVER p AS mu, stddev_pop(v) OVER p AS sd
    FROM (SELECT 'power_w' AS c, power_w AS v FROM buildings WHERE usable UNION ALL SELECT 'occupancy', occupancy FROM buildings WHERE usable)
    WINDOW p AS (PARTITION BY c))) GROUP BY 1, 2""", "buildings"))
def _(w):
    return stats.scaling_check(w.buildings.filter("usable"), ["power_w", "occupancy"])


@query("f15_log_transform", f"""
  SELECT l_returnflag, {rs((f'skewness({PRICE})', 'skew_before'), (f'skewness(ln(1 + {PRICE}))', 'skew_after'))} FROM lineitem GROUP BY 1""")
def _(w):
    return stats.log_transform_check(w.table("lineitem"), ["l_returnflag"], PRICE)


@query("m01_price_on_quantity", f"""
  SELECT l_returnflag, {rs((f'round(regr_intercept({PRICE}, l_quantity), 3)', 'a_base_load_w'), (f'round(regr_slope({PRICE}, l_quantity), 4)', 'b_watts_per_occupant'),
    (f'regr_r2({PRICE}, l_quantity)', 'r2_in_sample'))} FROM lineitem GROUP BY 1""")
def _(w):
    from voltloom.operators.models import fit_model_a
    m = fit_model_a(w.table("lineitem"), ["l_returnflag"], PRICE, "l_quantity")
    return m.select("l_returnflag", F.round("a_base_load_w", 3).alias("a_base_load_w"),
                    F.round("b_watts_per_occupant", 4).alias("b_watts_per_occupant"), "r2_in_sample")


@query("a40_versus_peers", f"""
  SELECT n_name, {rs('v', ('median(v) OVER ()', 'peer_median'), ('100 * (v - median(v) OVER ())', 'vs_median_pts'))}
  FROM (SELECT n_name, round(avg(c_acctbal), 3) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)""")
def _(w):
    t_ = (w.table("customer").join(w.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
          .groupBy("n_name").agg(F.round(F.avg("c_acctbal"), 3).alias("v")))
    return profile.versus_peers(t_, "v")
