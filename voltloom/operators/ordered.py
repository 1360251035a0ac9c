"""Ordered operators over long series that no single task has to hold.

A plain `Window.partitionBy(key).orderBy(ts)` sends a whole series to one task, and one
series may be a third of the data. Everything here therefore cuts a series into time
slices and works on (key, slice):

* `sliced` + `slice_window`: operators that look a bounded distance back or ahead. Rows
  near a slice border are also sent to the neighbouring slice, so one shuffle is enough.
* `row_positions`, `run_lengths`, `merge_runs`: unbounded ones. Each slice is reduced to
  a row or two, those few rows are combined per key, and the result goes back to the slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltloom.functions.columns import wall_seconds

SLICE, OWN, SEC = "_slice", "_own", "_sec"
DAY = 86400


def slice_of(sec: Column, days: int) -> Column:
    return F.floor(sec / (days * DAY)).cast("bigint")


def sliced(df: DataFrame, ts: str, days: int, back: int = 0, ahead: int = 0) -> DataFrame:
    """Add `_sec`, `_slice`, `_own`; copy border rows into the neighbouring slices.

    A row of a slice sees at least `back` seconds of history and `ahead` seconds of
    future among the rows with the same `_slice`. Rows with `_own` false are copies.
    """
    span = days * DAY
    if back > span or ahead > span:
        raise ValueError("a look-around must fit in one slice: raise segment_days")
    out = df.withColumn(SEC, wall_seconds(ts)).withColumn("_home", slice_of(F.col(SEC), days))
    if not back and not ahead:
        return out.withColumnRenamed("_home", SLICE).withColumn(OWN, F.lit(True))
    into = F.col(SEC) - F.col("_home") * span
    homes = F.array_compact(F.array(
        F.col("_home"),
        F.when(F.lit(back > 0) & (into >= span - back), F.col("_home") + 1),
        F.when(F.lit(ahead > 0) & (into < ahead), F.col("_home") - 1),
    ))
    return (out.withColumn(SLICE, F.explode(homes))
            .withColumn(OWN, F.col(SLICE) == F.col("_home")).drop("_home"))


def unsliced(df: DataFrame) -> DataFrame:
    return df.filter(OWN).drop(SLICE, OWN, SEC)


def slice_window(keys: list[str], *order: str):
    return Window.partitionBy(*keys, SLICE).orderBy(*(order or (SEC,)))


def up_to_here(w):
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def back_to_here(keys: list[str], order: str = SEC):
    """From the end of the slice back to the row. A frame that reaches forward to the end
    is evaluated anew for every row; the reversed order gives the same in one sweep."""
    return up_to_here(Window.partitionBy(*keys, SLICE).orderBy(F.col(order).desc()))


def row_positions(df: DataFrame, keys: list[str], ts: str, days: int,
                  name: str = "pos", total: str | None = None) -> DataFrame:
    """0-based row position of each row within its key, in time order."""
    cut = sliced(df, ts, days).drop(OWN)
    per_slice = cut.groupBy(*keys, SLICE).agg(F.count(F.lit(1)).alias("_n"))
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        *keys, SLICE,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(by_key).alias("_total"),
    )
    local = F.row_number().over(slice_window(keys)).cast("bigint") - 1
    out = (cut.withColumn("_local", local).join(offsets, [*keys, SLICE])
           .withColumn(name, F.col("_local") + F.col("_before")))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop(SLICE, SEC, "_local", "_before", "_total")


def mark_runs(df: DataFrame, keys: list[str], ts: str, state: Column, days: int) -> DataFrame:
    """Number the runs of equal `state` inside each slice (`_run` starts at 1)."""
    w = slice_window(keys)
    cut = sliced(df, ts, days).drop(OWN).withColumn("_state", state)
    broke = ~F.coalesce(F.col("_state").eqNullSafe(F.lag("_state").over(w))
                        & F.lag(SEC).over(w).isNotNull(), F.lit(False))
    return (cut.withColumn("_broke", broke.cast("int"))
            .withColumn("_run", F.sum("_broke").over(up_to_here(w))).drop("_broke"))


def merge_runs(partials: DataFrame, keys: list[str], continues: Column) -> DataFrame:
    """Give runs that go on across slice borders one id.

    `partials` holds one row per (keys, _slice, _run). Only the first and last run of a
    slice can touch a border, so only those rows meet in the per-key window. `continues`
    says whether a slice's first run goes on from the row before it in that window.
    Returns the input with `_gslice`, `_grun`: the id of the merged run.
    """
    last_run = F.max("_run").over(Window.partitionBy(*keys, SLICE))
    p = partials.withColumn("_edge", (F.col("_run") == 1) | (F.col("_run") == last_run))
    w = Window.partitionBy(*keys).orderBy(SLICE, "_run")
    edge = p.filter("_edge").withColumn(
        "_new", ~F.coalesce((F.col("_run") == 1) & continues(w), F.lit(False)))
    here = up_to_here(w)
    edge = (edge
            .withColumn("_gslice", F.last(F.when(F.col("_new"), F.col(SLICE)), True).over(here))
            .withColumn("_grun", F.last(F.when(F.col("_new"), F.col("_run")), True).over(here))
            .drop("_new"))
    inner = (p.filter(~F.col("_edge"))
             .withColumn("_gslice", F.col(SLICE)).withColumn("_grun", F.col("_run")))
    return edge.unionByName(inner).drop("_edge")


def run_table(df: DataFrame, keys: list[str], ts: str, state: Column, days: int) -> DataFrame:
    """One row per unbroken run of equal `state`: keys, state, start, end, rows."""
    marked = mark_runs(df, keys, ts, state, days)
    partial = marked.groupBy(*keys, SLICE, "_run").agg(
        F.first("_state").alias("state"), F.min(ts).alias("start"), F.max(ts).alias("end"),
        F.count(F.lit(1)).alias("rows"))
    merged = merge_runs(partial, keys,
                        lambda w: F.col("state").eqNullSafe(F.lag("state").over(w)))
    return (merged.groupBy(*keys, "_gslice", "_grun")
            .agg(F.first("state").alias("state"), F.min("start").alias("start"),
                 F.max("end").alias("end"), F.sum("rows").alias("rows"))
            .drop("_gslice", "_grun"))


def run_lengths(df: DataFrame, keys: list[str], ts: str, state: Column, days: int,
                name: str = "run_rows") -> DataFrame:
    """Add to every row the full length, in rows, of the run it belongs to."""
    marked = mark_runs(df, keys, ts, state, days)
    partial = marked.groupBy(*keys, SLICE, "_run").agg(
        F.first("_state").alias("state"), F.count(F.lit(1)).alias("rows"))
    merged = merge_runs(partial, keys,
                        lambda w: F.col("state").eqNullSafe(F.lag("state").over(w)))
    sizes = merged.groupBy(*keys, "_gslice", "_grun").agg(F.sum("rows").alias(name))
    lookup = (merged.join(sizes, [*keys, "_gslice", "_grun"])
              .select(*keys, SLICE, "_run", name))
    return (marked.join(lookup, [*keys, SLICE, "_run"])
            .drop(SLICE, "_run", "_state", SEC))
