"""Readers and sinks on files that Spark writes from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog import roles as R
from catalog.registry import query
from catalog.share_queries import SHARE_COLS, share_sql
from catalog.sql import d, i, is_, r, rs, sql, t
from voltloom.functions import columns as C
from voltloom.operators import assemble, blocks, waste, weather
from voltloom.session import shared_folder
from voltloom.sources import readers, sinks

METERS = ["click", "error", "purchase", "signup", "view"]


def _path(w, name: str) -> str:
    return f"{shared_folder(w.spark)}/voltloom/{name}-{uuid.uuid4().hex}"


ZONE = readers.DEFAULT_RULES.timezone


def _unix(ts: str = "ts"):
    """The instant at which the site's clocks show the stamp."""
    return F.unix_timestamp(F.convert_timezone(F.lit(ZONE), F.current_timezone(), F.col(ts)).cast("timestamp"))


@query("s01_s03_meter_files", sql(f"""
  SELECT meter, {is_(('count(*)', 'rows_read'), ('count(power)', 'power_n'), ('count(voltage)', 'voltage_n'))}, {t("date_trunc('second', min(ts))", 'first')},
    {rs(('sum(power)', 'power_sum'), ('sum(voltage)', 'voltage_sum'))}
  FROM (SELECT meter, ts, power, CASE WHEN meter <> 'error' THEN voltage END AS voltage FROM readings) GROUP BY meter""", "readings"))
def _(w):
    """One CSV folder per meter, one of them without a voltage column, in one read."""
    home, paths = _path(w, "meters"), {}
    for m in METERS:
        cols = ["power", "voltage"] if m != "error" else ["power"]
        part = w.readings.filter(F.col("meter") == m).select(_unix().alias("timestamp"), *cols)
        part.write.option("header", True).option("nullValue", "NA").csv(f"{home}/{m}")
        paths[m] = f"{home}/{m}"
    d_ = readers.read_meters(w.spark, list(paths.values()), folder_names=True)
    return d_.groupBy("meter").agg(F.count(F.lit(1)).alias("rows_read"), F.count("power").alias("power_n"), F.count("voltage").alias("voltage_n"),
                                   F.min("ts").alias("first"), F.sum("power").alias("power_sum"), F.sum("voltage").alias("voltage_sum"))


@query("s04_occupancy_files", sql(f"SELECT building, {t('ts')}, {r('occupancy', 'occupancy')} FROM occraw", "occ"))
def _(w):
    """One folder of head counts per building, the columns of one of them swapped."""
    home, raw = _path(w, "occupancy"), w.occupancy_raw
    for code, b in (("x1", "A"), ("x2", "B"), ("x3", "C"), ("x4", "D")):
        cols = ["timestamp", "occupancy_count"] if b != "B" else ["occupancy_count", "timestamp"]
        part = raw.filter(F.col("building") == b).select(_unix().alias("timestamp"), F.col("occupancy").alias("occupancy_count"))
        part.select(*cols).write.option("header", True).csv(f"{home}/{code}")
    names = {"x1": "A", "x2": "B", "x3": "C", "x4": "D"}
    return readers.read_occupancy(w.spark, [f"{home}/{c}" for c in names], names, folder_names=True)


@query("s05_station_file", sql(f"SELECT {t('ts')}, {rs('temp_c', 'relh')} FROM wxp", "wx"))
def _(w):
    p = _path(w, "station")
    R.weather_rows(w.spark, w.sf_dir).write.option("header", True).csv(p)
    return weather.parse_station(readers.read_station(w.spark, p))


@query("s06_calendar_files", sql(f"SELECT {d('k.date', 'date')}, {i('working_day')}, activity FROM calendar k", "calendar"))
def _(w):
    p = _path(w, "calendar")
    cal = w.calendar.select(F.col("date").alias("Date"), "working_day", "activity")
    cal.write.option("header", True).csv(f"{p}/calender_year_a")
    cal.filter("working_day = 1").write.option("header", True).csv(f"{p}/calendar_year_b")   # dates seen twice
    return readers.read_calendar(w.spark, [f"{p}/calender_year_*", f"{p}/calendar_year_*"])


@query("s07_wide_power_file", sql(f"""
  SELECT {is_(('count(*)', 'rows_read'), ('count(click + error)', 'both'))}, {rs(('avg(click + error)', 'mean_both'), ('avg("view")', 'mean_view'))}
  FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS ts, avg(power) FILTER (WHERE meter = 'click') AS click, avg(power) FILTER (WHERE meter = 'error') AS error,
    avg(power) FILTER (WHERE meter = 'view') AS "view" FROM clean GROUP BY 1)""", "clean"))
def _(w):
    p = _path(w, "wide")
    wide = (blocks.invalidate(w.readings, w.rules).groupBy(C.block_start("ts", 30).alias("ts"))
            .pivot("meter", METERS).agg(F.avg("power")))
    wide.select(_unix().alias("timestamp"), *METERS).write.option("header", True).option("nullValue", "NA").csv(p)
    x = readers.read_wide_power(w.spark, p, ["click", "error", "view"])
    both = F.col("click") + F.col("error")
    return x.agg(F.count(F.lit(1)).alias("rows_read"), F.count(both).alias("both"), F.avg(both).alias("mean_both"), F.avg("view").alias("mean_view"))


@query("s08_status_file", sql(f"""
  SELECT {d("date_trunc('month', ts)", 'month')}, meter, {r('1e2 * avg((n > 0)::INT)', 'coverage_pct')} FROM (
    SELECT b.ts, m.meter, count(c.power) AS n FROM (SELECT DISTINCT time_bucket(INTERVAL 10 MINUTE, ts) AS ts FROM clean) b CROSS JOIN (SELECT DISTINCT meter FROM clean) m
      LEFT JOIN clean c ON c.meter = m.meter AND time_bucket(INTERVAL 10 MINUTE, c.ts) = b.ts GROUP BY 1, 2) GROUP BY 1, 2""", "clean"))
def _(w):
    p = _path(w, "status")
    wide = blocks.invalidate(w.readings, w.rules).groupBy(C.block_start("ts").alias("ts")).pivot("meter", METERS).agg(F.count("power"))
    wide.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), *[
        F.coalesce((F.col(m) > 0).cast("int"), F.lit(0)).alias(m) for m in METERS]).write.option("header", True).csv(p)
    long = readers.read_status(w.spark, p)
    return long.groupBy(C.month_start("ts").alias("month"), "meter").agg((100 * F.avg("present")).alias("coverage_pct"))


@query("s11_tab_separated", f"SELECT n_name, {i('n_nationkey')} FROM nation")
def _(w):
    p = _path(w, "tsv")
    w.table("nation").select("n_name", "n_nationkey").write.option("header", True).option("sep", "\t").csv(p)
    return readers.read_tsv(w.spark, p).select("n_name", F.col("n_nationkey").cast("bigint").alias("n_nationkey"))


@query("s12_file_inventory")
def _(w):
    return readers.file_inventory(w.spark, w.sf_dir)


@query("k01_k04_stage_roundtrip", sql(f"""SELECT building, {i('count(*)', 'rows')}, {r('sum(kwh)', 'kwh')} FROM buildings GROUP BY 1""", "buildings"))
def _(w):
    p = _path(w, "stage")
    sinks.write_stage(w.buildings, p)
    back = readers.read_stage(w.spark, p, assemble.LONG_COLUMNS)
    return back.groupBy("building").agg(F.count(F.lit(1)).alias("rows"), F.sum("kwh").alias("kwh"))


@query("k02_s10_result_file", sql(f"SELECT building, {SHARE_COLS} FROM share", "buildings", extra=share_sql("25e-2")))
def _(w):
    p, share = _path(w, "result"), waste.low_occupancy_share(w.buildings, fraction=0.25, rules=w.rules)
    sinks.write_result(share, p, ["building"])
    return readers.read_results(w.spark, p, ", ".join(f"{c} {k}" for c, k in share.dtypes))


@query("k03_counter_file", sql(f"SELECT meter, {is_(('count(*)', 'rows_read'), ('count(power_raw) - count(power)', 'power_invalid'))} FROM clean GROUP BY 1", "clean"))
def _(w):
    p = _path(w, "counters")
    sinks.write_counters(blocks.reading_counters(blocks.invalidate(w.readings, w.rules)), p)
    return w.spark.read.json(p).select("meter", "rows_read", "power_invalid")
