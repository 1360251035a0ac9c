"""Readers for every input file: explicit schemas, NULL as the only missing value."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltloom.config import DEFAULT_RULES, METER_REGISTRY, WIDE_COLUMNS
from voltloom.functions.columns import null_nan
from voltloom.operators.assemble import require_columns

READING_COLUMNS = ("power", "current", "voltage", "frequency", "power_factor")


def local_time(seconds: str | Column, zone: str = DEFAULT_RULES.timezone) -> Column:
    """UNIX seconds to the wall clock of the site's zone, whatever the session's zone is.

    The pipeline works on wall-clock stamps throughout, as do the weather rows.
    """
    c = F.col(seconds) if isinstance(seconds, str) else seconds
    utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=c.cast("decimal(18,6)"))
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def file_stem() -> Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"([^/]*?)(\.[^.]*)?$", 1)


def folder_name() -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]*$", 1)


def csv_columns(spark: SparkSession, path: str) -> list[str]:
    """The header of a CSV file; the body is not read."""
    return spark.read.option("header", True).csv(path).columns


def read_by_name(spark: SparkSession, paths: list[str], types: dict[str, str], pick: Callable[[DataFrame], DataFrame],
                 other: str = "STRING", **options) -> DataFrame:
    """CSV files of any paths, folders or globs, each read by its own header, so neither the order
    of columns nor a missing one matters. Columns of `types` have their type, the rest `other`.

    Files with the same header are one scan; `pick` selects from each scan, and a column that a
    scan lacks is NULL. Headers are read side by side, one short job a file.
    """
    files = [r.path for r in spark.read.format("binaryFile").load(paths).select("path", "length").filter("length > 0").collect()]
    with ThreadPoolExecutor(16) as pool:
        headers = list(pool.map(lambda p: tuple(csv_columns(spark, p)), files))
    by_header: dict[tuple, list[str]] = {(): []} if not files else {}
    for header, p in zip(headers, files, strict=True):
        by_header.setdefault(header, []).append(p)
    out = None
    for header, group in by_header.items():
        schema = ", ".join(f"`{c}` {types.get(c, other)}" for c in header or types)
        reader = spark.read.schema(schema).options(header=True, enforceSchema=False, **options)
        part = pick(reader.csv(group or paths))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_meters(spark: SparkSession, paths: list[str], names: dict[str, str] | None = None,
                folder_names: bool = False, zone: str = DEFAULT_RULES.timezone) -> DataFrame:
    """All one-minute meter files: meter, ts, readings. `names` maps a file stem (or, with
    `folder_names`, the name of the folder a meter's files lie in) to a meter."""
    def pick(d: DataFrame) -> DataFrame:
        return d.select((folder_name() if folder_names else file_stem()).alias("meter"), local_time("timestamp", zone).alias("ts"),
                        *[null_nan(c).alias(c) for c in READING_COLUMNS if c in d.columns])

    out = read_by_name(spark, paths, {"timestamp": "BIGINT"} | dict.fromkeys(READING_COLUMNS, "DOUBLE"), pick, nullValue="NA")
    if names:
        pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
        out = out.withColumn("meter", F.coalesce(pairs[F.col("meter")], F.col("meter")))
    return out


def read_occupancy(spark: SparkSession, paths: list[str], codes: dict[str, str] | None = None,
                   folder_names: bool = False, zone: str = DEFAULT_RULES.timezone) -> DataFrame:
    """Occupancy files, one per building: building, ts, occupancy. `codes` maps a stem (or, with
    `folder_names`, a folder's name) to a building."""
    name = folder_name() if folder_names else file_stem()
    codes = codes or {code: b for _, b, _, _, code in METER_REGISTRY}
    pairs = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    return read_by_name(spark, paths, {"timestamp": "BIGINT", "occupancy_count": "DOUBLE"}, lambda d: d.select(
        F.coalesce(pairs[name], name).alias("building"),
        local_time("timestamp", zone).alias("ts"), null_nan("occupancy_count").alias("occupancy")), nullValue="NA")


def read_station(spark: SparkSession, path: str) -> DataFrame:
    """Weather station text rows; `operators.weather.parse_station` turns them into numbers."""
    return read_by_name(spark, [path], dict.fromkeys(("valid", "tmpc", "relh"), "STRING"), lambda d: d.select("valid", "tmpc", "relh"))


def read_calendar(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Per-year calendars, any number of globs: one row per date. Of several rows for a date that
    of the file first by name stays, of rows in one file the smallest, missing values first."""
    types = {"Date": "DATE", "working_day": "INT", "activity": "STRING"}
    rows = read_by_name(spark, paths, types, lambda d: d.select(*[c for c in types if c in d.columns], F.col("_metadata.file_name").alias("_file")))
    rest = [c for c in rows.columns if c not in ("Date", "_file")]
    one = rows.groupBy(F.col("Date").alias("date")).agg(F.min(F.struct("_file", *rest)).alias("_row"))
    return one.select("date", *[F.col("_row")[c].alias(c) for c in rest])


def read_wide_power(spark: SparkSession, path: str, columns=None, zone: str = DEFAULT_RULES.timezone) -> DataFrame:
    """The all-meters file; only the named columns are parsed."""
    def pick(d: DataFrame) -> DataFrame:
        keep = list(columns or [c for c in WIDE_COLUMNS if c in d.columns])
        return d.select(local_time("timestamp", zone).alias("ts"), *[null_nan(c).alias(c) for c in keep if c in d.columns])

    return read_by_name(spark, [path], {"timestamp": "BIGINT"}, pick, "DOUBLE", nullValue="NA")


def read_status(spark: SparkSession, path: str) -> DataFrame:
    """Presence flags: a text timestamp and one 0/1 column per meter, in long form."""
    wide = read_by_name(spark, [path], {"timestamp": "STRING"}, lambda d: d, "INT")
    return (wide.withColumn("ts", F.expr("try_cast(timestamp AS timestamp_ntz)")).drop("timestamp")
            .unpivot(["ts"], [c for c in wide.columns if c != "timestamp"], "meter", "present"))


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("sep", "\t").csv(path)


def read_results(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """A published result table, or None when it has not been written."""
    try:
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader).csv(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def read_stage(spark: SparkSession, path: str, required=()) -> DataFrame:
    """A stored stage table, checked against its column contract."""
    return require_columns(spark.read.parquet(path), required)


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """File names and sizes in MB, largest first; file contents are not read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    return (files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"),
                         (F.col("length") / 1024 / 1024).alias("size_mb"))
            .orderBy(F.col("size_mb").desc(), "file"))


def head_tail(df: DataFrame, n: int = 5, *order: str) -> tuple[DataFrame, DataFrame]:
    """First and last n rows by the given order; a distributed scan has no file order."""
    return df.orderBy(*order).limit(n), df.orderBy(*[F.col(c).desc() for c in order]).limit(n)
