"""Readers, sinks, the whole build from files, and the incremental ingest."""

import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import column
from voltloom.operators import assemble, blocks, waste, weather
from voltloom.plans.building_table import build_meters, build_table
from voltloom.sources import readers, sinks
from voltloom.streaming import incremental

T0 = 1433097000   # 2015-06-01 00:00 in India


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("raw")
    head = "timestamp,power,current,voltage,frequency,power_factor\n"
    mains = "".join(f"{T0 + 60 * i},{1000 + (i // 10) % 144},NA,{230 if i % 50 else 300},50,{-0.9 if i % 2 else 0.9}\n"
                    for i in range(2880) if not 500 <= i < 520)
    (d / "boys_hostel_mains.csv").write_text(head + mains)
    (d / "boys_hostel_ups.csv").write_text("timestamp,power\n" + "".join(
        f"{T0 + 60 * i},{'NA' if i == 5 else 50}\n" for i in range(2880)))
    (d / "BH.csv").write_text("timestamp,occupancy_count\n" + "".join(f"{T0 + 600 * i},{i % 100}\n" for i in range(288)))
    (d / "vidp_metar.csv").write_text("station,valid,tmpc,relh\n" + "".join(
        f"VIDP,2015-06-0{1 + i // 48} {(i // 2) % 24:02d}:{30 * (i % 2):02d},{'M' if i == 4 else 20 + i % 20},50\n" for i in range(96)))
    (d / "calender_year_2015.csv").write_text("Date,working_day,activity\n2015-06-01,1,H\n2015-06-02,0,L\n")
    (d / "calendar_year_2015.csv").write_text("Date,working_day,activity\n2015-06-02,0,L\n")
    (d / "wide.csv").write_text("timestamp,Boys_main,Boys_backup,Mess\n" + "".join(f"{T0 + 60 * i},100,{'NA' if i == 1 else 50},1\n" for i in range(4)))
    (d / "status.csv").write_text("timestamp,a,b\n2015-06-01 00:00:00,1,0\n2015-06-01 00:01:00,1,1\n")
    (d / "s.tsv").write_text("Sample\tSource\nx\ty\n")
    return d


NAMES = {"boys_hostel_mains": "boys_mains", "boys_hostel_ups": "boys_ups"}


def meters(spark, files):
    return readers.read_meters(spark, [str(files / f"{n}.csv") for n in NAMES], NAMES)


def test_meter_files_with_different_headers(spark, files):
    d = meters(spark, files)
    n = {r.meter: r for r in d.groupBy("meter").agg(F.count(F.lit(1)).alias("n"), F.count("power").alias("p"),
                                                      F.count("voltage").alias("v"), F.min("ts").alias("first")).collect()}
    assert (n["boys_mains"].n, n["boys_ups"].p, n["boys_ups"].v) == (2860, 2879, 0)
    assert str(n["boys_mains"].first) == "2015-06-01 00:00:00"
    assert readers.csv_columns(spark, str(files / "boys_hostel_ups.csv")) == ["timestamp", "power"]


def test_columns_are_read_by_name(spark, tmp_path):
    """Files of one folder or glob may differ in the order of their columns, or lack one."""
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.csv").write_text(f"timestamp,power,current\n{T0},1,10\n")
    (tmp_path / "m" / "b.csv").write_text(f"timestamp,current,power\n{T0},20,2\n")
    (tmp_path / "m" / "c.csv").write_text(f"power,timestamp\n3,{T0}\n")
    got = {r.meter: (r.power, r.current) for r in readers.read_meters(spark, [str(tmp_path / "m")]).collect()}
    assert got == {"a": (1, 10), "b": (2, 20), "c": (3, None)}
    (tmp_path / "calendar_year_1.csv").write_text("Date,working_day,activity\n2015-06-01,1,H\n")
    (tmp_path / "calendar_year_2.csv").write_text("activity,working_day,Date\nL,0,2016-06-01\n")
    cal = readers.read_calendar(spark, [str(tmp_path / "calendar_year_*.csv")]).orderBy("date").collect()
    assert [(str(r.date), r.working_day, r.activity) for r in cal] == [("2015-06-01", 1, "H"), ("2016-06-01", 0, "L")]
    (tmp_path / "BH.csv").write_text(f"occupancy_count,timestamp\n7,{T0}\n")
    assert readers.read_occupancy(spark, [str(tmp_path / "BH.csv")]).first().occupancy == 7


def test_calendars_that_disagree(spark, tmp_path):
    (tmp_path / "calendar_b.csv").write_text("Date,working_day,activity\n2015-06-01,0,A\n2015-06-02,1,H\n2015-06-02,0,L\n")
    (tmp_path / "calendar_a.csv").write_text("Date,working_day,activity\n2015-06-01,1,Z\n")
    got = [(str(r.date), r.working_day, r.activity) for r in readers.read_calendar(spark, [str(tmp_path / "*.csv")]).orderBy("date").collect()]
    assert got == [("2015-06-01", 1, "Z"), ("2015-06-02", 0, "L")]


def test_small_readers(spark, files):
    cal = readers.read_calendar(spark, [str(files / "calender_year_*.csv"), str(files / "calendar_year_*.csv")])
    assert cal.count() == 2
    wide = readers.read_wide_power(spark, str(files / "wide.csv"), ["Boys_main", "Boys_backup"])
    assert wide.columns == ["ts", "Boys_main", "Boys_backup"]
    total = wide.agg(F.avg(F.col("Boys_main") + F.col("Boys_backup")).alias("m"), F.count(F.col("Boys_main") + F.col("Boys_backup")).alias("n")).first()
    assert (total.m, total.n) == (150, 3)
    assert readers.read_status(spark, str(files / "status.csv")).agg(F.sum("present")).first()[0] == 3
    assert readers.read_tsv(spark, str(files / "s.tsv")).first().Source == "y"
    assert readers.read_results(spark, str(files / "nothing.csv")) is None
    inv = readers.file_inventory(spark, str(files)).collect()
    assert inv[0].file == "boys_hostel_mains.csv" and len(inv) == 9


def test_build_from_files(spark, files, tmp_path):
    registry = assemble.meter_registry(spark)
    occ = blocks.occupancy_blocks(readers.read_occupancy(spark, [str(files / "BH.csv")]))
    wx = weather.weather_grid(weather.parse_station(readers.read_station(spark, str(files / "vidp_metar.csv"))))
    cal = readers.read_calendar(spark, [str(files / "calender_year_*.csv")])
    table = build_table(build_meters(meters(spark, files)), registry, occ, wx, cal)
    sinks.write_stage(table, str(tmp_path / "t"))
    back = readers.read_stage(spark, str(tmp_path / "t"), assemble.LONG_COLUMNS)
    assert back.count() == 288 and set(column(back, "building", ("ts",))) == {"Boys_Hostel"}
    gap = back.filter("was_interpolated").orderBy("ts").collect()
    assert [str(r.ts)[11:16] for r in gap] == ["08:20", "08:30"]      # 20 minutes: filled
    assert back.filter("usable").count() == 288 and back.filter("temp_c IS NULL").count() < 12
    share = waste.low_occupancy_share(back).first()
    assert share.reachable and 0 < share.share_pct < 20
    with pytest.raises(ValueError):
        assemble.require_columns(back.drop("cdh"))
    sinks.write_stage(back, str(tmp_path / "t2"))
    sinks.write_stage(back, str(tmp_path / "t2"))                     # a re-build replaces its partition
    assert spark.read.parquet(str(tmp_path / "t2")).count() == 288


def test_result_and_counter_sinks(spark, files, tmp_path):
    counters = blocks.reading_counters(blocks.invalidate(meters(spark, files)))
    sinks.write_counters(counters, str(tmp_path / "c"))
    lines = [json.loads(x) for p in (tmp_path / "c").glob("*.json") for x in p.read_text().splitlines()]
    got = {x["meter"]: x for x in lines}
    assert got["boys_ups"]["power_missing_in_source"] == 1 and got["boys_mains"]["voltage_invalid"] == 57
    sinks.write_result(counters, str(tmp_path / "r"), ["meter"])
    assert readers.read_results(spark, str(tmp_path / "r")).count() == 2


def test_incremental_ingest_equals_the_batch_one(spark, files, tmp_path):
    (tmp_path / "in").mkdir()
    lines = (files / "boys_hostel_mains.csv").read_text().splitlines()
    for n, cut in enumerate([(1, 900), (900, 907), (907, len(lines))]):      # blocks are split over files
        (tmp_path / "in" / f"{n}.csv").write_text("\n".join([lines[0], *lines[cut[0]:cut[1]]]) + "\n")
    stream = (spark.readStream.schema("timestamp BIGINT, power DOUBLE, current DOUBLE, voltage DOUBLE, frequency DOUBLE, power_factor DOUBLE")
              .option("header", True).option("nullValue", "NA").option("maxFilesPerTrigger", 1).csv(str(tmp_path / "in"))
              .select(F.lit("boys_mains").alias("meter"), readers.local_time("timestamp").alias("ts"), *readers.READING_COLUMNS))
    q = incremental.ingest(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination()
    got = incremental.stored_blocks(spark, str(tmp_path / "out"))
    want = blocks.aggregate_blocks(blocks.invalidate(meters(spark, files).filter("meter = 'boys_mains'")))
    assert incremental.parts_of(spark, str(tmp_path / "out"), 2) == [(0, 0), (0, 1), (0, 2)]
    j = got.alias("a").join(want.alias("b"), ["meter", "ts"], "full_outer")
    bad = j.filter(~F.col("a.power_w").eqNullSafe(F.col("b.power_w")) | ~F.col("a.n_readings").eqNullSafe(F.col("b.n_readings"))
                   | (F.abs(F.col("a.power_factor") - F.col("b.power_factor")) > 1e-9)
                   | ~F.col("a.pf_neg_frac").eqNullSafe(F.col("b.pf_neg_frac")))
    assert j.count() == 286 and bad.count() == 0


def test_parts_are_merged_by_level(spark, tmp_path):
    """21 batches as three parts; a batch run again changes nothing; old parts can go."""
    home = str(tmp_path / "parts")
    rows = [("m", i % 7, float(i), 1, float(i), float(i), 1) for i in range(42)]
    make = lambda some: spark.createDataFrame(some, "meter string, n int, power_sum double, power_cnt bigint, power_min double, power_max double, rows bigint") \
        .withColumn("ts", F.lit("2015-06-01").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("n") * 10)).drop("n")
    for number in range(21):
        incremental.store_batch(make(rows[2 * number:2 * number + 2]), home, number)
        if number % 5 == 0:
            incremental.store_batch(make(rows[:1]), home, number)           # has its snapshot
    assert incremental.parts_of(spark, home, 20) == [(2, 15), (1, 19), (0, 20)]
    read = lambda n=None: incremental.stored_blocks(spark, home, n).orderBy("ts").collect()
    want = incremental.merge_partials(make(rows)).orderBy("ts").collect()
    assert read() == want and read(9) == incremental.merge_partials(make(rows[:20])).orderBy("ts").collect()
    # a batch that ended before its snapshot leaves parts that no reader sees and that stay until it is run again
    make(rows).write.parquet(incremental.part_path(home, 0, 21))
    assert read() == want
    assert incremental.remove_unused(spark, home, 1) == 16 + 4 + 4
    assert read() == want and (tmp_path / "parts" / "level=0" / "part=21").exists()
    incremental.store_batch(make(rows[:0]), home, 21)                       # an empty batch
    assert read() == want and incremental.snapshots(spark, home) == [20, 21]
    with pytest.raises(FileNotFoundError):
        incremental.stored_blocks(spark, home, 3)


def test_stamps_are_the_site_clock_under_any_session_zone(spark):
    d = spark.createDataFrame([(1433097000,)], "timestamp bigint")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert str(d.select(readers.local_time("timestamp")).first()[0]) == "2015-06-01 00:00:00"
        assert str(d.select(readers.local_time("timestamp", "UTC")).first()[0]) == "2015-05-31 18:30:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
