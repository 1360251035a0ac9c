"""Incremental ingest: readings arrive in chunks, blocks are kept as mergeable partials.

Each micro-batch is reduced to sums, counts, minima and maxima per block and stored as a part
under its batch number, so a batch that is run again replaces its own output. A block split over
batches, however late its readings come, is exact once the partials are merged.

Parts are merged by level: of every four parts of a level one part of the next is made, so n
batches are read as some 3 log4(n) parts and each row is written about log4(n) times. A snapshot,
a small file put in place by one rename, names the parts that make up all batches so far; readers
go by the newest snapshot and never see a part that is being written or a batch twice.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltloom.config import DEFAULT_RULES, Rules
from voltloom.functions.columns import block_start, ratio
from voltloom.operators.blocks import OPTIONAL, invalidate


def partial_blocks(readings: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """One row per meter and block of this chunk, in a form that can be added up."""
    d = invalidate(readings, rules)
    aggs = [F.sum("power").alias("power_sum"), F.count("power").alias("power_cnt"),
            F.min("power").alias("power_min"), F.max("power").alias("power_max"), F.count(F.lit(1)).alias("rows")]
    for c in OPTIONAL:
        if c in d.columns:
            aggs += [F.sum(c).alias(f"{c}_sum"), F.count(c).alias(f"{c}_cnt")]
    if "pf_negative" in d.columns:
        aggs.append(F.count_if("pf_negative").alias("pf_neg_cnt"))
    return d.groupBy("meter", block_start("ts").alias("ts")).agg(*aggs)


def add_partials(partials: DataFrame) -> DataFrame:
    """One partial per meter and block from any number of them."""
    how = {c: F.min if c.endswith("_min") else F.max if c.endswith("_max") else F.sum
           for c in partials.columns if c.endswith(("_sum", "_cnt", "_min", "_max")) or c == "rows"}
    return partials.groupBy("meter", "ts").agg(*[f(c).alias(c) for c, f in how.items()])


def merge_partials(partials: DataFrame) -> DataFrame:
    """Blocks from any number of partials."""
    m, how = add_partials(partials), partials.columns
    out = [ratio(F.col("power_sum"), F.col("power_cnt")).alias("power_w"), F.col("power_min").alias("power_min_w"),
           F.col("power_max").alias("power_max_w"), F.col("power_cnt").cast("int").alias("n_readings")]
    out += [ratio(F.col(f"{c}_sum"), F.col(f"{c}_cnt")).alias(c) for c in OPTIONAL if f"{c}_sum" in how]
    if "pf_neg_cnt" in how:
        out.append(ratio(F.col("pf_neg_cnt").cast("double"), F.col("power_factor_cnt")).alias("pf_neg_frac"))
    return m.select("meter", "ts", *out)


def _files(spark: SparkSession, path: str):
    """The file system of a path, and a function that makes its paths."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), lambda *names: at("/".join([path, *names]))


def snapshots(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches up to which there is a snapshot, ascending."""
    fs, at = _files(spark, path)
    if not fs.exists(at("_snapshots")):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(at("_snapshots"))]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def parts_of(spark: SparkSession, path: str, number: int) -> list[tuple[int, int]]:
    """(level, last batch) of each part of a snapshot, oldest first."""
    fs, at = _files(spark, path)
    stream = fs.open(at("_snapshots", f"{number:012d}.json"))
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return [tuple(p) for p in json.loads(text)]


def _put_snapshot(spark: SparkSession, path: str, number: int, parts: list[tuple[int, int]]) -> None:
    fs, at = _files(spark, path)
    fs.mkdirs(at("_snapshots"))
    new, name = at("_snapshots", f"{number:012d}.new"), at("_snapshots", f"{number:012d}.json")
    out = fs.create(new, True)
    out.write(bytearray(json.dumps(parts).encode()))
    out.close()
    if not fs.rename(new, name):
        raise OSError(f"snapshot {number} of {path} could not be put in place")


def part_path(path: str, level: int, number: int) -> str:
    return f"{path}/level={level}/part={number}"


def store_batch(partials: DataFrame, path: str, number: int, fan: int = 4) -> None:
    """Add a batch's partials as a part, merge parts while `fan` of a level are there, and put the
    snapshot in place. A batch that has its snapshot already is left alone; one that ended
    before it is written anew, over whatever parts it left."""
    spark = partials.sparkSession
    done = snapshots(spark, path)
    if number in done:
        return
    before = [n for n in done if n < number]
    parts = [*(parts_of(spark, path, before[-1]) if before else []), (0, number)]
    partials.write.mode("overwrite").parquet(part_path(path, 0, number))
    while len(parts) >= fan and len({level for level, _ in parts[-fan:]}) == 1:
        merged = spark.read.schema(partials.schema).parquet(*[part_path(path, *p) for p in parts[-fan:]])
        level = parts[-1][0] + 1
        add_partials(merged).write.mode("overwrite").parquet(part_path(path, level, number))
        parts = [*parts[:-fan], (level, number)]
    _put_snapshot(spark, path, number, parts)


def remove_unused(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Remove the snapshots but for the newest `keep`, then the parts that none of these names; how
    many parts went. Readers of an older snapshot must have ended. A batch being written now has
    no snapshot yet: its parts, newer than every snapshot, stay."""
    fs, at = _files(spark, path)
    done = snapshots(spark, path)
    if not done:
        return 0
    used = {p for n in done[-keep:] for p in parts_of(spark, path, n)}
    for n in done[:-keep]:
        fs.delete(at("_snapshots", f"{n:012d}.json"), False)
    gone = 0
    for folder in fs.globStatus(at("level=*", "part=*")) or []:
        where = folder.getPath()
        part = (int(where.getParent().getName().split("=")[1]), int(where.getName().split("=")[1]))
        if part not in used and part[1] <= done[-1]:
            fs.delete(where, True)
            gone += 1
    return gone


def ingest(stream: DataFrame, path: str, checkpoint: str, rules: Rules = DEFAULT_RULES, fan: int = 4):
    """Start the ingest of everything that is there now; returns the streaming query."""

    def store(batch: DataFrame, number: int) -> None:
        store_batch(partial_blocks(batch, rules), path, number, fan)

    return (stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def stored_partials(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The partials of the newest snapshot, or of the one up to batch `number`."""
    done = snapshots(spark, path)
    if not done or (number is not None and number not in done):
        raise FileNotFoundError(f"no such snapshot in {path}")
    parts = parts_of(spark, path, done[-1] if number is None else number)
    return spark.read.parquet(*[part_path(path, *p) for p in parts])


def stored_blocks(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    return merge_partials(stored_partials(spark, path, number))
