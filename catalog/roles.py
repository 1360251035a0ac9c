"""The given tables in the roles of the energy pipeline, on Spark and as DuckDB CTEs.

`events` plays the meters (one per event type), the occupancy counter (distinct users),
the weather station and the calendar. Every role reads the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltloom.config import Rules
from voltloom.functions.columns import block_start

# the stand-in data are small numbers, sparse and one month long
RULES = Rules(power_max_w=300.0, dead_meter_hours=1 / 3, segment_days=7)
BUILDINGS = ("A", "B", "C", "D")
REGISTRY = (("click", "A", "mains", "commercial"), ("error", "A", "ups", "commercial"),
            ("view", "B", "mains", "residential"), ("purchase", "C", "mains", "commercial"),
            ("signup", "D", "mains", "residential"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_k(events: DataFrame) -> DataFrame:
    return events.withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))


def events(spark, sf_dir) -> DataFrame:
    return with_k(table(spark, sf_dir, "events"))


def registry(spark) -> DataFrame:
    return spark.createDataFrame(list(REGISTRY), "meter string, building string, role string, kind string")


def readings(spark, sf_dir) -> DataFrame:
    return as_readings(events(spark, sf_dir))


def as_readings(events: DataFrame) -> DataFrame:
    k, v = F.col("k"), F.col("value")
    return events.select(
        F.col("event_type").alias("meter"), "ts",
        F.when(k % 25 == 7, F.lit(None)).when(k == 99, -1.0).when(v < 5, 0.0).otherwise(v)
        .alias("power"),
        F.when(k % 10 != 3, v / 230.0).alias("current"),
        (150.0 + 1.5 * k).alias("voltage"),
        (49.0 + k / 50.0).alias("frequency"),
        ((k - 20) / 80.0).alias("power_factor"))


def occupancy(spark, sf_dir) -> DataFrame:
    """Distinct users per building and block; a user frequents three of the buildings."""
    home = F.array(*[F.lit(b) for b in BUILDINGS])
    visits = events(spark, sf_dir).select(
        "user_id", block_start("ts").alias("ts"),
        F.explode(F.array_remove(home, F.element_at(home, (F.col("user_id") % 4 + 1).cast("int"))))
        .alias("building"))
    return visits.groupBy("building", "ts").agg(
        F.count_distinct("user_id").cast("double").alias("occupancy"))


def weather_rows(spark, sf_dir) -> DataFrame:
    """Text rows as a station reports them: irregular stamps, 'M' for a missing value."""
    half = events(spark, sf_dir).groupBy(block_start("ts", 30).alias("half")).agg(
        F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm").alias("valid"),
        (F.sum("k") * 5).alias("s"), F.count("k").alias("n"), F.max("k").alias("relh"),
        F.min("k").alias("low"))
    tenth = F.expr("s div n")
    return half.select(
        "valid",
        F.when(F.col("low") % 9 == 4, "M")
        .otherwise(F.concat(F.expr("(s div n) div 10").cast("string"), F.lit("."),
                            (tenth % 10).cast("string"))).alias("tmpc"),
        F.when(F.col("relh") % 11 == 3, "T").otherwise(F.col("relh").cast("string")).alias("relh"))


def calendar(spark, sf_dir) -> DataFrame:
    """One row per day seen, some days left out."""
    d = events(spark, sf_dir).select(F.to_date("ts").alias("date")).distinct()
    dom, wd = F.dayofmonth("date"), F.weekday("date")
    working = (wd < 5) & ~dom.isin(1, 26)
    return d.filter(dom % 7 != 3).select(
        "date", working.cast("int").alias("working_day"),
        F.when(working & (dom > 8), "H").otherwise("L").alias("activity"))


# ------------------------------------------------------------------ DuckDB
REGISTRY_SQL = """registry(meter, building, role, kind) AS (VALUES
  ('click','A','mains','commercial'), ('error','A','ups','commercial'),
  ('view','B','mains','residential'), ('purchase','C','mains','commercial'),
  ('signup','D','mains','residential'))"""

EV_SQL = """ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""

READINGS_SQL = """readings AS (
  SELECT event_type AS meter, ts,
    CASE WHEN k % 25 = 7 THEN NULL WHEN k = 99 THEN -1e0 WHEN value < 5 THEN 0e0 ELSE value END AS power,
    CASE WHEN k % 10 <> 3 THEN value / 230e0 END AS current,
    150e0 + 15e-1 * k AS voltage, 49e0 + k / 50e0 AS frequency, (k - 20) / 80e0 AS power_factor
  FROM ev)"""

CLEAN_SQL = """clean AS (
  SELECT meter, ts, power AS power_raw, CASE WHEN power >= 0 AND power <= 300 THEN power END AS power,
    current, frequency, CASE WHEN voltage BETWEEN 180 AND 270 THEN voltage END AS voltage,
    voltage NOT BETWEEN 180 AND 270 AS voltage_bad, power_factor < 0 AS pf_negative,
    abs(power_factor) AS power_factor
  FROM readings)"""

BLOCKS_SQL = """agg AS (
  SELECT meter, time_bucket(INTERVAL 10 MINUTE, ts) AS ts, avg(power) AS power_w,
    min(power) AS power_min_w, max(power) AS power_max_w, count(power) AS n_readings,
    avg(voltage) AS voltage, avg(current) AS current, avg(frequency) AS frequency,
    avg(power_factor) AS power_factor,
    count(*) FILTER (WHERE pf_negative) / nullif(count(power_factor), 0)::DOUBLE AS pf_neg_frac
  FROM clean GROUP BY 1, 2),
mgrid AS (
  SELECT meter, unnest(generate_series(min(ts), max(ts), INTERVAL 10 MINUTE)) AS ts FROM agg GROUP BY meter),
blocks AS (
  SELECT meter, ts, power_w, power_min_w, power_max_w, coalesce(n_readings, 0) AS n_readings,
    voltage, current, frequency, power_factor, pf_neg_frac
  FROM mgrid LEFT JOIN agg USING (meter, ts))"""

OCC_SQL = """occraw AS (
  SELECT b.building, time_bucket(INTERVAL 10 MINUTE, ts) AS ts,
    count(DISTINCT user_id)::DOUBLE AS occupancy
  FROM ev, (VALUES ('A',0),('B',1),('C',2),('D',3)) b(building, i)
  WHERE user_id % 4 <> i GROUP BY 1, 2),
occ AS (
  SELECT g.building, g.ts, o.occupancy FROM (
    SELECT building, unnest(generate_series(min(ts), max(ts), INTERVAL 10 MINUTE)) AS ts
    FROM occraw GROUP BY building) g LEFT JOIN occraw o USING (building, ts))"""

WEATHER_RAW_SQL = """wxraw AS (
  SELECT strftime(min(ts), '%Y-%m-%d %H:%M') AS valid,
    CASE WHEN min(k) % 9 = 4 THEN 'M' ELSE
      concat((((sum(k) * 5) // count(k)) // 10)::VARCHAR, '.', (((sum(k) * 5) // count(k)) % 10)::VARCHAR) END AS tmpc,
    CASE WHEN max(k) % 11 = 3 THEN 'T' ELSE max(k)::VARCHAR END AS relh
  FROM ev GROUP BY time_bucket(INTERVAL 30 MINUTE, ts))"""

CALENDAR_SQL = """calendar AS (
  SELECT date, CASE WHEN w THEN 1 ELSE 0 END AS working_day,
    CASE WHEN w AND day(date) > 8 THEN 'H' ELSE 'L' END AS activity
  FROM (SELECT DISTINCT ts::DATE AS date, isodow(ts) <= 5 AND day(ts) NOT IN (1, 26) AS w FROM events)
  WHERE day(date) % 7 <> 3)"""
