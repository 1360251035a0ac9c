"""Readings, blocks, grid, run-length rules and the building table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog import roles as R
from catalog.registry import query
from catalog.sql import VAC, d, i, is_, r, rs, sql, t, RUNS_SQL
from voltloom.functions import columns as C
from voltloom.operators import assemble, blocks, features, ordered, profile, runs, weather
from voltloom.session import shared_folder
from voltloom.streaming import incremental


# ------------------------------------------------------------ values and blocks
@query("f01_reading_counters", sql(f"""
  SELECT meter, {is_(('count(*)', 'rows_read'), ('count(*) - count(power_raw)', 'power_missing_in_source'),
    ('count(power_raw) - count(power)', 'power_invalid'), ('count(*) - count(power)', 'power_missing'),
    ('count(*) FILTER (WHERE power = 0)', 'power_zero'), ('count(*) FILTER (WHERE voltage_bad)', 'voltage_invalid'),
    ('count(*) FILTER (WHERE pf_negative)', 'pf_negative'), ('count(*) - count(current)', 'current_missing'))}
  FROM clean GROUP BY meter""", "clean"))
def _(w):
    return blocks.reading_counters(blocks.invalidate(w.readings, w.rules))


@query("f01_invalidated_readings", sql(f"""
  SELECT meter, {t('ts')}, {rs('power', 'voltage', 'power_factor')}, voltage_bad, pf_negative FROM clean""", "clean"))
def _(w):
    return blocks.invalidate(w.readings, w.rules).select(
        "meter", "ts", "power", "voltage", "power_factor", "voltage_bad", "pf_negative")


@query("a01_blocks_on_grid", sql(f"""
  SELECT meter, {t('ts')}, {rs('power_w', 'power_min_w', 'power_max_w', 'voltage', 'current', 'frequency', 'power_factor', 'pf_neg_frac')},
    {i('n_readings')} FROM blocks""", "blocks"))
def _(w):
    return blocks.meter_blocks(w.readings, rules=w.rules)


@query("a01_incremental_blocks", sql(f"""
  SELECT meter, {t('ts')}, {rs('power_w', 'power_min_w', 'power_max_w', 'voltage', 'current', 'frequency', 'power_factor', 'pf_neg_frac')},
    {i('n_readings')} FROM agg""", "blocks"))
def _(w):
    """The same blocks from a file stream, batch by batch."""
    home = f"{shared_folder(w.spark)}/voltloom/ingest-{uuid.uuid4().hex}"
    stream = (w.spark.readStream.schema(w.table("events").schema).option("pathGlobFilter", "events.parquet")
              .parquet(w.sf_dir))
    q = incremental.ingest(R.as_readings(R.with_k(stream)), f"{home}/blocks", f"{home}/state", w.rules)
    q.awaitTermination()
    return incremental.stored_blocks(w.spark, f"{home}/blocks")


@query("a01_compacted_blocks", sql(f"""
  SELECT meter, {t('ts')}, {rs('power_w', 'power_min_w', 'power_max_w', 'voltage', 'current', 'frequency', 'power_factor', 'pf_neg_frac')},
    {i('n_readings')} FROM agg""", "blocks"))
def _(w):
    """The same blocks from nine batches, cut across blocks and in no order of time, whose parts
    are merged on the way: three parts are read."""
    home = f"{shared_folder(w.spark)}/voltloom/parts-{uuid.uuid4().hex}"
    e = R.events(w.spark, w.sf_dir)
    for number in range(9):
        batch = R.as_readings(e.filter(F.pmod(F.xxhash64("event_id"), F.lit(9)) == number))
        incremental.store_batch(incremental.partial_blocks(batch, w.rules), home, number)
    incremental.remove_unused(w.spark, home, keep=1)
    return incremental.stored_blocks(w.spark, home)


@query("a02_block_counters", sql(f"""
  SELECT meter, {is_(('count(*)', 'blocks_10min'), ('count(*) FILTER (WHERE n_readings = 0)', 'blocks_missing'),
    ('count(*) FILTER (WHERE n_readings BETWEEN 1 AND 9)', 'blocks_partial'))},
    {t('min(ts)', 'first_ts')}, {t('max(ts)', 'last_ts')} FROM blocks GROUP BY meter""", "blocks"))
def _(w):
    return blocks.block_counters(w.blocks)


@query("g01_complete_grid", sql(f"""
  SELECT meter, {t('ts')}, {r('power_w', 'power_w')}, {i('n_readings')}
  FROM blocks""", "blocks"))
def _(w):
    agg = blocks.aggregate_blocks(blocks.invalidate(w.readings, w.rules))
    return blocks.complete_grid(agg).select("meter", "ts", "power_w", "n_readings")


@query("s04_occupancy_grid", sql(f"SELECT building, {t('ts')}, {r('occupancy', 'occupancy')} FROM occ", "occ"))
def _(w):
    return blocks.occupancy_blocks(w.occupancy_raw)


@query("s04_moved_rows", sql(f"""
  SELECT event_type AS meter, {i("count(*) FILTER (WHERE ts <> time_bucket(INTERVAL 10 MINUTE, ts))", 'moved')},
    {i('count(*)', 'rows_read')} FROM events GROUP BY 1"""))
def _(w):
    return blocks.moved_rows(w.readings, ("meter",))


@query("s05_station_rows", sql(f"""
  SELECT {t("strptime(valid, '%Y-%m-%d %H:%M')", 'ts')}, {rs(('try_cast(tmpc AS DOUBLE)', 'temp_c'), ('try_cast(relh AS DOUBLE)', 'relh'))}
  FROM wxraw""", "wxraw"))
def _(w):
    return weather.parse_station(R.weather_rows(w.spark, w.sf_dir))


@query("g04_weather_grid", sql(f"SELECT {t('ts')}, {rs('temp_c', 'relh')} FROM wx", "wx"))
def _(w):
    return weather.weather_grid(weather.parse_station(R.weather_rows(w.spark, w.sf_dir)), w.rules)


@query("s14_epoch_seconds", sql(f"""
  SELECT event_type AS meter, {i('min(epoch(date_trunc(\'second\', ts)))', 'first_s')}, {i('max(epoch(date_trunc(\'second\', ts)))', 'last_s')},
    {i('sum(epoch(date_trunc(\'second\', ts))::BIGINT % 86400)', 'day_seconds')} FROM events GROUP BY 1"""))
def _(w):
    s = C.wall_seconds("ts")
    return w.readings.groupBy("meter").agg(F.min(s).alias("first_s"), F.max(s).alias("last_s"),
                                           F.sum(s % 86400).alias("day_seconds"))


# ------------------------------------------------------------------ run lengths
@query("g02_gap_runs", sql(f"""
  SELECT meter, {t('ts')}, {i("count(*) OVER (PARTITION BY meter, miss, g)", 'run_rows')} FROM z""", "off"))
def _(w):
    return runs.gap_runs(w.blocks, ["meter"], "power_max_w", rules=w.rules).select("meter", "ts", "run_rows")


@query("g03_short_gap_fill", sql(f"""
  SELECT meter, {t('ts')}, {r('power_filled_w', 'power_filled_w')}, was_interpolated FROM filled""", "filled"))
def _(w):
    d = runs.flag_meter_off(w.blocks, ["meter"], rules=w.rules)
    return runs.fill_short_gaps(
        d, ["meter"], "power_w", "power_filled_w", "was_interpolated", rules=w.rules,
        source=F.when(~F.col("meter_off"), F.col("power_w"))).select(
        "meter", "ts", "power_filled_w", "was_interpolated")


@query("g05_meter_off", sql(f"SELECT meter, {t('ts')}, meter_off FROM off", "off"))
def _(w):
    return runs.flag_meter_off(w.blocks, ["meter"], rules=w.rules).select("meter", "ts", "meter_off")


ZERO_RUNS_SQL = """zr AS (SELECT meter, min(ts) AS start, max(ts) AS "end", count(*) AS rows, count(*) / 6e0 AS hours
  FROM (SELECT meter, ts, zero, row_number() OVER (PARTITION BY meter ORDER BY ts)
      - row_number() OVER (PARTITION BY meter, zero ORDER BY ts) AS zg FROM z) WHERE zero GROUP BY meter, zg)"""
# lengths in hours, right-closed; scaled so that short runs fall into several buckets
BUCKET_SQL = ("CASE WHEN h <= 6 THEN '< 6 h' WHEN h <= 18 THEN '6-18 h' WHEN h <= 24 THEN '18-24 h' "
              "WHEN h <= 48 THEN '1-2 days' WHEN h <= 168 THEN '2-7 days' WHEN h <= 8760 THEN 'over a week' ELSE 'beyond' END")


def _zero_runs(w):
    return runs.zero_runs(w.blocks, ["meter"], rules=w.rules)


def _gap_hours(w):
    """Lengths of the gaps, which spread over the buckets better than the zero runs do."""
    miss = ordered.run_table(w.blocks, ["meter"], "ts", F.col("power_max_w").isNull(), w.rules.segment_days)
    return miss.filter("state").select("meter", "rows", (F.col("rows") * 3.0).alias("hours"))


GAP_SQL = "gr AS (SELECT meter, count(*) * 3e0 AS h FROM z WHERE miss GROUP BY meter, g)"


@query("g06_zero_runs", sql(f"""SELECT meter, {t('start')}, {t('"end"')}, {i('rows')}, {r('hours', 'hours')} FROM zr""", "off",
                            extra=ZERO_RUNS_SQL))
def _(w):
    return _zero_runs(w)


@query("g06_zero_hours_split", sql(f"""SELECT meter, {rs(("coalesce(sum(hours) FILTER (WHERE hours <= 3e-1), 0e0)", 'short_hours'),
    ("coalesce(sum(hours) FILTER (WHERE hours > 3e-1), 0e0)", 'long_hours'))} FROM zr GROUP BY meter""", "off", extra=ZERO_RUNS_SQL))
def _(w):
    return runs.zero_hours_split(_zero_runs(w), ["meter"], 0.3)


@query("f12_run_length_buckets", sql(f"""SELECT meter, {BUCKET_SQL} AS bucket, {i('count(*)', 'runs')}, {rs(('sum(h)', 'total_hours'),
    ('100 * sum(h) / sum(sum(h)) OVER (PARTITION BY meter)', 'share_pct'))} FROM gr GROUP BY 1, 2""", "off", extra=GAP_SQL))
def _(w):
    return runs.zero_run_buckets(_gap_hours(w), ["meter"])


@query("a16_outlier_flags", sql(f"""SELECT meter, {t('ts')}, outlier_iqr, outlier_zscore FROM cleaned""", "cleaned"))
def _(w):
    return w.cleaned.select("meter", "ts", "outlier_iqr", "outlier_zscore")


@query("a16_fences", sql(f"""SELECT meter, {rs('q1', 'q3', ('q1 - 15e-1*(q3-q1)', 'low_fence'), ('q3 + 15e-1*(q3-q1)', 'high_fence'))}
  FROM lim""", "cleaned"))
def _(w):
    return runs.fences(w.cleaned.filter(runs.live_rows()), ["meter"], "power_w")


@query("a03_cleaning_stats", sql(f"""
  SELECT meter, {is_(('count(*)', 'blocks'), ('count(*) FILTER (WHERE is_missing)', 'blocks_missing'),
    ('count(*) FILTER (WHERE meter_off)', 'blocks_meter_off'), ('count(*) FILTER (WHERE was_interpolated)', 'blocks_interpolated'),
    ('count(*) FILTER (WHERE outlier_iqr)', 'outliers_iqr'), ('count(*) FILTER (WHERE outlier_zscore)', 'outliers_zscore'))},
    {rs(('count(*) FILTER (WHERE meter_off) / 6e0', 'hours_meter_off'), ('100 * avg((NOT is_missing AND NOT meter_off)::INT::DOUBLE)', 'pct_usable'),
    ('max(q1 - 15e-1*(q3-q1))', 'iqr_low_fence_w'), ('max(q3 + 15e-1*(q3-q1))', 'iqr_high_fence_w'))}
  FROM cleaned LEFT JOIN lim USING (meter) GROUP BY meter""", "cleaned"))
def _(w):
    return runs.cleaning_stats(w.cleaned, rules=w.rules)


# -------------------------------------------------------------------- buildings
@query("j01_combined_meters", sql(f"""
  SELECT building, {t('ts')}, {rs('power_w', 'power_raw_w', 'voltage', 'power_factor', 'power_w_mains', 'power_w_ups', 'power_filled_w_ups')},
    meter_off, is_missing, was_interpolated, outlier_iqr, outlier_zscore, {i('meter_off_ups::INT', 'meter_off_ups')} FROM combined""", "combined"))
def _(w):
    return assemble.combine_meters(w.cleaned, w.registry).select(
        "building", "ts", "power_w", "power_raw_w", "voltage", "power_factor", "power_w_mains", "power_w_ups",
        "power_filled_w_ups", *assemble.FLAGS, F.col("meter_off_ups").cast("int").alias("meter_off_ups"))


@query("j02_occupancy_join", sql(f"""SELECT building, {t('ts')}, {rs('power_w', 'occupancy')}
  FROM combined JOIN occ USING (building, ts)""", "combined", "occ"))
def _(w):
    return assemble.join_occupancy(assemble.combine_meters(w.cleaned, w.registry), w.occupancy).select(
        "building", "ts", "power_w", "occupancy")


@query("j03_weather_join", sql(f"""SELECT building, {t('ts')}, {rs('temp_c', 'relh', 'cdh')} FROM merged""", "buildings"))
def _(w):
    merged = assemble.join_occupancy(assemble.combine_meters(w.cleaned, w.registry), w.occupancy)
    return assemble.join_weather(merged, w.weather, w.rules).select("building", "ts", "temp_c", "relh", "cdh")


@query("f07_calendar_features", sql(f"""
  SELECT building, {t('ts')}, hour, minute_of_day, month, year, {d('date')}, weekday, day_of_week, is_weekend, is_vacation,
    is_working_day, calendar_source, is_semester, period FROM buildings""", "buildings"))
def _(w):
    return features.add_calendar_features(w.occupancy.join(
        w.buildings.select("building", "ts"), ["building", "ts"]), w.calendar).select(
        "building", "ts", "hour", "minute_of_day", "month", "year", "date", "weekday", "day_of_week", "is_weekend",
        "is_vacation", "is_working_day", "calendar_source", "is_semester", "period")


@query("w03_w04_history_features", sql(f"""
  SELECT building, {t('ts')}, {rs('power_lag_1h', 'power_lag_1d', 'power_roll24h_mean', 'power_roll24h_std')} FROM hist""", "buildings"))
def _(w):
    merged = assemble.join_occupancy(assemble.combine_meters(w.cleaned, w.registry), w.occupancy)
    return features.add_history_features(merged, rules=w.rules).select(
        "building", "ts", "power_lag_1h", "power_lag_1d", "power_roll24h_mean", "power_roll24h_std")


@query("f04_f06_energy_and_usable", sql(f"""
  SELECT building, {t('ts')}, {rs('kwh', 'cdh')}, usable FROM buildings""", "buildings"))
def _(w):
    return w.buildings.select("building", "ts", "kwh", "cdh", "usable")


@query("u01_long_table", sql(f"""
  SELECT building, building_kind, {rs('power_w', 'occupancy', 'kwh', 'power_lag_1h', 'power_lag_1d', 'power_roll24h_mean',
    'power_roll24h_std', 'voltage', 'power_factor', 'temp_c', 'relh', 'cdh')}, {d('date')}, hour, weekday, month, year, is_weekend,
    is_vacation, is_semester, period, is_working_day, calendar_source, meter_off, is_missing, usable, outlier_iqr, outlier_zscore
  FROM buildings""", "buildings"))
def _(w):
    return assemble.require_columns(w.buildings).select(*assemble.LONG_COLUMNS)


@query("a04_building_stats", sql(f"""
  SELECT building, {is_(('count(*)', 'rows'), ('count(*) FILTER (WHERE usable)', 'usable_rows'),
    ('count(*) FILTER (WHERE was_interpolated)', 'blocks_interpolated'), ('count(*) FILTER (WHERE outlier_iqr)', 'outliers_iqr'),
    ('count(*) FILTER (WHERE outlier_zscore)', 'outliers_zscore'))}, {t('min(ts)', 'first')}, {t('max(ts)', 'last')},
    {rs(('100 * avg(usable::INT::DOUBLE)', 'pct_usable'), ('100 * avg((power_w IS NULL)::INT::DOUBLE)', 'pct_power_missing'),
    ('100 * avg((occupancy IS NULL)::INT::DOUBLE)', 'pct_occupancy_missing'), ('count(*) FILTER (WHERE meter_off) / 6e0', 'hours_meter_off'),
    ('sum(kwh) FILTER (WHERE usable)', 'total_kwh'), ('avg(power_w) FILTER (WHERE usable)', 'mean_power_w'))}
  FROM buildings GROUP BY building""", "buildings"))
def _(w):
    return assemble.building_stats(w.buildings)


@query("a42_data_quality", sql(f"""
  SELECT building, {is_(('max(meters)', 'meters'), ('count(*)', 'rows'), ('max(vi)', 'voltage_invalid'), ('max(pn)', 'pf_negative'))},
    {rs(('100 * avg(usable::INT::DOUBLE)', 'pct_usable'), ('sum(kwh) FILTER (WHERE usable)', 'total_kwh'))}
  FROM buildings JOIN (SELECT building, count(DISTINCT meter) AS meters, count(*) FILTER (WHERE voltage_bad) AS vi,
      count(*) FILTER (WHERE pf_negative) AS pn FROM clean JOIN registry USING (meter) GROUP BY building) USING (building)
  GROUP BY building""", "buildings", "clean", "registry"))
def _(w):
    counters = blocks.reading_counters(blocks.invalidate(w.readings, w.rules))
    return assemble.data_quality(w.buildings, counters, w.registry).select(
        "building", "meters", "rows", "voltage_invalid", "pf_negative", "pct_usable", "total_kwh")


WIDE = {"A": ["click", "error"], "B": ["view"], "C": ["purchase"], "D": ["signup"]}


@query("a05_cross_check", sql(f"""
  SELECT a.building, {rs('wide_mean_w', 'our_mean_w', ('100 * abs(our_mean_w - wide_mean_w) / wide_mean_w', 'difference_pct'))},
    100 * abs(our_mean_w - wide_mean_w) / wide_mean_w < 1 AS agrees
  FROM (SELECT building, avg(w) AS our_mean_w FROM (
      SELECT building, ts, CASE WHEN count(power_w) = max(n_meters) THEN sum(power_w) END AS w
      FROM blocks JOIN registry USING (meter) JOIN nm USING (building) GROUP BY 1, 2) GROUP BY 1) a
  JOIN (SELECT 'A' AS building, avg(click + error) AS wide_mean_w FROM wide UNION ALL SELECT 'B', avg("view") FROM wide
    UNION ALL SELECT 'C', avg(purchase) FROM wide UNION ALL SELECT 'D', avg(signup) FROM wide) b USING (building)""",
    "blocks", "registry", extra="""nm AS (SELECT building, count(*) AS n_meters FROM registry GROUP BY building),
    wide AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS ts, avg(power) FILTER (WHERE meter = 'click') AS click,
      avg(power) FILTER (WHERE meter = 'error') AS error, avg(power) FILTER (WHERE meter = 'view') AS "view",
      avg(power) FILTER (WHERE meter = 'purchase') AS purchase, avg(power) FILTER (WHERE meter = 'signup') AS signup
      FROM clean GROUP BY 1)"""))
def _(w):
    wide = (blocks.invalidate(w.readings, w.rules).groupBy(C.block_start("ts", 30).alias("ts"))
            .pivot("meter", ["click", "error", "view", "purchase", "signup"]).agg(F.avg("power")))
    return assemble.cross_check(wide, WIDE, w.blocks, w.registry)


@query("a44_all_checks_agree", sql("""SELECT bool_and(abs(our_mean_w - wide_mean_w) / wide_mean_w < 5e-1) AS all_agree
  FROM (SELECT meter, avg(power_w) AS our_mean_w FROM blocks GROUP BY 1) JOIN (SELECT meter, avg(power) AS wide_mean_w FROM clean GROUP BY 1) USING (meter)""", "blocks"))
def _(w):
    wide = blocks.invalidate(w.readings, w.rules).groupBy("ts").pivot("meter", ["click", "error", "view", "purchase", "signup"]).agg(F.avg("power"))
    reg = w.registry.withColumn("building", F.col("meter"))
    c = assemble.cross_check(wide, {m: [m] for m in ("click", "error", "view", "purchase", "signup")}, w.blocks, reg, 50.0)
    return c.agg(F.bool_and("agrees").alias("all_agree"))


@query("g08_dead_meter_rule", sql(f"""
  SELECT building, {i('count(*)', 'rows')}, {i('count(*) FILTER (WHERE u)', 'usable_rows')}, {r('sum(CASE WHEN u THEN p / 1e3 * (10e0/60e0) END)', 'kwh')}
  FROM (SELECT building, p, p IS NOT NULL AND NOT mo AND occupancy IS NOT NULL AS u
    FROM (SELECT building, ts, CASE WHEN count(power_w) = max(n_meters) THEN sum(power_w) END AS p, bool_or(meter_off) AS mo
      FROM off JOIN registry USING (meter) JOIN (SELECT building, count(*) AS n_meters FROM registry GROUP BY 1) USING (building)
      GROUP BY 1, 2) JOIN occ USING (building, ts)) GROUP BY building""", "blocks", "registry", "occ",
    extra=RUNS_SQL.format(need=4)))
def _(w):
    d = assemble.with_dead_meter_rule(w.blocks, w.registry, w.occupancy, 4 / 6, w.rules)
    return d.groupBy("building").agg(F.count(F.lit(1)).alias("rows"), F.count_if("usable").alias("usable_rows"),
                                     F.sum(F.when(F.col("usable"), F.col("kwh"))).alias("kwh"))


@query("f08_vacation_windows", f"""
  SELECT {d('o_orderdate::DATE', 'day')}, {VAC.format(d='o_orderdate')} AS is_vacation, {i('count(*)', 'n')} FROM orders GROUP BY o_orderdate::DATE, 2""")
def _(w):
    o = w.table("orders").select(F.to_date("o_orderdate").alias("day"))
    return o.groupBy("day", C.in_vacation_window("day").alias("is_vacation")).agg(F.count(F.lit(1)).alias("n"))


@query("f08_wrapped_window", f"""
  SELECT year(o_orderdate)::BIGINT AS year, {i("count(*) FILTER (WHERE month(o_orderdate)*100+day(o_orderdate) >= 1120 OR month(o_orderdate)*100+day(o_orderdate) <= 110)", 'inside')},
    {i('count(*)', 'n')} FROM orders GROUP BY 1""")
def _(w):
    inside = C.in_vacation_window("o_orderdate", [((11, 20), (1, 10))])
    return w.table("orders").groupBy(F.year("o_orderdate").alias("year")).agg(
        F.count_if(inside).alias("inside"), F.count(F.lit(1)).alias("n"))


@query("f02_f03_low_and_corrected", sql(f"""
  SELECT building, {t('ts')}, coalesce(occupancy <= 1, false) AS is_low,
    {r("CASE WHEN occupancy IS NOT NULL THEN greatest(occupancy - CASE building WHEN 'A' THEN 2e0 ELSE 1e0 END, 0e0) END", 'corrected')} FROM occ""", "occ"))
def _(w):
    base = F.when(F.col("building") == "A", 2.0).otherwise(1.0)
    return w.occupancy.select("building", "ts", C.is_low("occupancy", F.lit(1.0)).alias("is_low"),
                              C.corrected_occupancy("occupancy", base).alias("corrected"))


@query("f09_cooling_degree_hours", sql(f"""
  SELECT {t('ts')}, {rs(("CASE WHEN temp_c IS NOT NULL THEN greatest(temp_c - 24e0, 0e0) / 6e0 END", 'cdh_24'),
    ("CASE WHEN temp_c IS NOT NULL THEN greatest(temp_c - 18e0, 0e0) / 6e0 END", 'cdh_18'))} FROM wx""", "wx"))
def _(w):
    return w.weather.select("ts", C.cooling_degree_hours("temp_c", 24.0).alias("cdh_24"),
                            C.cooling_degree_hours("temp_c", 18.0).alias("cdh_18"))


@query("g09_step_gaps", sql(f"""
  SELECT event_type AS meter, {is_(('count(*) FILTER (WHERE s > 3600)', 'gaps'), ('max(s)', 'largest_gap_s'))}
  FROM (SELECT event_type, s0 - lag(s0) OVER (PARTITION BY event_type ORDER BY s0) AS s
    FROM (SELECT event_type, epoch(date_trunc('second', ts))::BIGINT AS s0 FROM events)) GROUP BY 1"""))
def _(w):
    return profile.step_gaps(w.readings, ["meter"], C.wall_seconds("ts"), w.rules, 3600)
