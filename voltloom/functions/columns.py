"""Column expressions: pure built-ins, so they stay inside whole-stage codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from voltloom.config import (
    BLOCK_HOURS, DEFAULT_RULES, Rules, SEMESTER, VACATION, VACATION_WINDOWS, WEEKDAYS,
)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- time ---------------------------------------------------------------
def wall_seconds(ts: str | Column) -> Column:
    """Wall-clock seconds since 1970-01-01 for either timestamp type.

    `unix_timestamp` would shift a zone-less timestamp by the session zone.
    """
    ts = col(ts)
    day = F.unix_date(F.to_date(ts)).cast("bigint")
    return day * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def block_start(ts: str | Column, minutes: int = 10) -> Column:
    """Floor to the block in local wall-clock time; keeps the timestamp's own type.

    `minutes` must divide an hour (`date_trunc` would turn a zone-less stamp into a zoned one).
    """
    ts = col(ts)
    return ts - F.make_dt_interval(mins=F.minute(ts) % minutes, secs=F.extract(F.lit("SECOND"), ts))


def day_start(ts: str | Column) -> Column:
    ts = col(ts)
    return ts - F.make_dt_interval(hours=F.hour(ts), mins=F.minute(ts),
                                   secs=F.extract(F.lit("SECOND"), ts))


def month_start(ts: str | Column) -> Column:
    return F.trunc(F.to_date(col(ts)), "month")


def month_label(ts: str | Column) -> Column:
    return F.date_format(col(ts), "yyyy-MM")


def days_in_month(ts: str | Column) -> Column:
    return F.dayofmonth(F.last_day(F.to_date(col(ts))))


def weekday_name(ts: str | Column) -> Column:
    names = F.array(*[F.lit(n) for n in WEEKDAYS])
    return F.element_at(names, F.weekday(F.to_date(col(ts))) + 1)


def in_vacation_window(day: str | Column, windows=VACATION_WINDOWS) -> Column:
    """Month/day windows, inclusive; a window may wrap around new year."""
    d = F.to_date(col(day))
    code = F.month(d) * 100 + F.dayofmonth(d)
    tests = []
    for (m1, d1), (m2, d2) in windows:
        lo, hi = m1 * 100 + d1, m2 * 100 + d2
        tests.append(code.between(lo, hi) if lo <= hi else (code >= lo) | (code <= hi))
    return reduce(lambda a, b: a | b, tests)


def period_name(is_vacation: Column) -> Column:
    return F.when(is_vacation, F.lit(VACATION)).otherwise(F.lit(SEMESTER))


# ---- values -------------------------------------------------------------
def null_nan(c: str | Column) -> Column:
    """NaN becomes NULL; used by the readers only."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def kwh(power: str | Column) -> Column:
    return col(power) / 1000.0 * BLOCK_HOURS


def cooling_degree_hours(temp: str | Column, base: float | Column) -> Column:
    """max(0, T - base) / 6; `greatest` skips NULLs, hence the guard."""
    t = col(temp)
    return F.when(t.isNotNull(), F.greatest(t - base, F.lit(0.0)) / 6.0)


def is_low(occupancy: str | Column, threshold: Column) -> Column:
    return F.coalesce(col(occupancy) <= threshold, F.lit(False))


def corrected_occupancy(occupancy: str | Column, baseline: Column) -> Column:
    o = col(occupancy)
    return F.when(o.isNotNull(), F.greatest(o - baseline, F.lit(0.0)))


def band(z: str | Column, rules: Rules = DEFAULT_RULES) -> Column:
    size = F.abs(col(z))
    return (F.when(size >= rules.z_anomaly, "ANOMALY")
            .when(size >= rules.z_warning, "WARNING").otherwise("NORMAL"))


def effect_label(d: str | Column) -> Column:
    size = F.abs(col(d))
    return (F.when(size.isNull() | F.isnan(size), "undefined")
            .when(size < 0.2, "negligible").when(size < 0.5, "small")
            .when(size < 0.8, "medium").otherwise("large"))


def right_closed_bucket(value: str | Column, edges) -> Column:
    """(lower, upper] buckets; `edges` is ((upper, label), ...), first lower bound 0."""
    v = col(value)
    out = None
    for upper, label in edges:
        test = (v > 0) & (v <= upper)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


def left_closed_band(value: str | Column, bands) -> Column:
    v = col(value)
    out = None
    for lo, hi in bands:
        label = F.lit(f"{lo}-{hi}C")
        out = (F.when((v >= lo) & (v < hi), label) if out is None
               else out.when((v >= lo) & (v < hi), label))
    return out


def half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


def ratio(num: Column, den: Column) -> Column:
    """num / den, NULL when the denominator is 0 or NULL."""
    return F.when(den != 0, num / den)


def unbiased_skew(c: str | Column) -> Column:
    """Sample-corrected skewness, from Spark's population one."""
    n = F.count(col(c)).cast("double")
    return F.when(n > 2, F.skewness(col(c)) * F.sqrt(n * (n - 1)) / (n - 2))
