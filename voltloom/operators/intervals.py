"""Range joins of rows to overlapping intervals, as equi-joins on cells.

Every interval is cut into the cells of one width that it touches, a row lies in one cell,
and the exact bounds decide among the pairs that share a cell. Rows are not copied. With the
mean length of the intervals as width, cells are at most three times as many as intervals,
whatever their lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")


def _number(df: DataFrame, name: str) -> Column:
    """The column as a double: a stamp as microseconds, a date as days."""
    kind = dict(df.dtypes)[name]
    if kind == "timestamp_ntz":   # counted from a fixed wall clock, so no change of clocks matters
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(name)).cast("double")
    if kind == "timestamp":
        return F.unix_micros(name).cast("double")
    if kind == "date":
        return F.unix_date(name).cast("double")
    return F.col(name).cast("double")


def covering(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str,
             keys: list[str] | None = None, width: float | None = None, how: str = "inner") -> DataFrame:
    """Every row of `points` with every interval [start, end) of the same `keys` that holds it.

    Without `keys` the intervals hold for all rows; NULL keys meet nothing. `width` is in the unit
    of the bounds, for stamps in microseconds and for dates in days; by default it is the mean
    length, one number from a pass over the intervals. A bound may be infinite; only then are the
    smallest and largest place of the rows looked up, to end such intervals there. Empty and
    reversed intervals and those with a NULL or NaN bound hold nothing. With `how="left"` a row in
    no interval, or without a place, stays once with NULLs. Names on both sides other than the
    keys are an error.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how must be 'inner' or 'left', not {how!r}")
    keys = list(keys or [])
    names = [c for c in intervals.columns if c not in keys]
    clash = {c.lower() for c in points.columns} & {c.lower() for c in names}
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    lo, hi, x = _number(intervals, start), _number(intervals, end), _number(points, at)
    rows = points.select(F.struct(*[F.col(f"`{c}`") for c in points.columns]).alias("_row"),
                         *[F.col(f"`{k}`").alias(f"_k{n}") for n, k in enumerate(keys)], x.alias("_x"))
    held = intervals.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_of"),
                            *[F.col(f"`{k}`").alias(f"_i{n}") for n, k in enumerate(keys)], lo.alias("_lo"), hi.alias("_hi"))
    held = held.filter(~F.isnan("_lo") & ~F.isnan("_hi") & (F.col("_lo") < F.col("_hi")))
    finite = (F.col("_lo") > -INF) & (F.col("_hi") < INF)
    facts = held.agg(F.avg(F.when(finite, F.col("_hi") - F.col("_lo"))).alias("mean"), F.count_if(~finite).alias("open")).first()
    first, last = F.col("_lo"), F.col("_hi")
    if facts.open:
        span = rows.filter(~F.isnan("_x")).agg(F.min("_x").alias("a"), F.max("_x").alias("b")).first()
        a, b = (span.a, span.b) if span.a is not None else (0.0, 0.0)
        first, last = F.greatest(first, F.lit(a)), F.least(last, F.lit(b))
        held = held.filter((first <= F.lit(b)) & (last >= F.lit(a)))
        if facts.mean is None:
            facts = facts.asDict() | {"mean": (b - a) or 1.0}
    w = F.lit(float(width or facts["mean"] or 1.0))
    cell = lambda c: F.floor(c / w).cast("bigint")
    held = held.withColumn("_ic", F.explode(F.sequence(cell(first), cell(last))))
    same = (cell(F.col("_x")) == F.col("_ic")) & (F.col("_x") >= F.col("_lo")) & (F.col("_x") < F.col("_hi"))
    for n in range(len(keys)):
        same = same & (F.col(f"_k{n}") == F.col(f"_i{n}"))
    return rows.join(held, same, how).select("_row.*", *[F.col("_of")[c].alias(c) for c in names])
