"""DuckDB CTEs of the stand-in pipeline, written plainly: windows over whole series."""

from __future__ import annotations

from catalog import roles as R

RUNS_SQL = """z AS (
  SELECT *, power_max_w IS NULL AS miss, coalesce(power_max_w = 0, false) AS zero,
    row_number() OVER (PARTITION BY meter ORDER BY ts)
      - row_number() OVER (PARTITION BY meter, power_max_w IS NULL ORDER BY ts) AS g
  FROM blocks),
z2 AS (
  SELECT *, count(*) OVER (PARTITION BY meter, miss, g) AS run,
    last_value(CASE WHEN NOT miss THEN zero END IGNORE NULLS) OVER (PARTITION BY meter ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS zb,
    first_value(CASE WHEN NOT miss THEN zero END IGNORE NULLS) OVER (PARTITION BY meter ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS za
  FROM z),
z3 AS (SELECT *, zero OR coalesce(miss AND run <= 3 AND zb AND za, false) AS bridged FROM z2),
z4 AS (SELECT *, row_number() OVER (PARTITION BY meter ORDER BY ts)
      - row_number() OVER (PARTITION BY meter, bridged ORDER BY ts) AS bg FROM z3),
off AS (SELECT * EXCLUDE (miss, g, run, zb, za, bg, bridged),
    zero AND count(*) OVER (PARTITION BY meter, bridged, bg) >= {need} AS meter_off FROM z4)"""

FILL_SQL = """f1 AS (SELECT *, n_readings = 0 AS is_missing, CASE WHEN NOT meter_off THEN power_w END AS src FROM off),
f2 AS (SELECT *, row_number() OVER (PARTITION BY meter ORDER BY ts)
      - row_number() OVER (PARTITION BY meter, src IS NULL ORDER BY ts) AS g,
    last_value(src IGNORE NULLS) OVER before AS pv, last_value(CASE WHEN src IS NOT NULL THEN ts END IGNORE NULLS) OVER before AS pt,
    first_value(src IGNORE NULLS) OVER after AS nv, first_value(CASE WHEN src IS NOT NULL THEN ts END IGNORE NULLS) OVER after AS nt
  FROM f1 WINDOW before AS (PARTITION BY meter ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    after AS (PARTITION BY meter ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f3 AS (SELECT *, src IS NULL AND count(*) OVER (PARTITION BY meter, src IS NULL, g) <= 3
      AND pv IS NOT NULL AND nv IS NOT NULL AS was_interpolated FROM f2),
filled AS (SELECT * EXCLUDE (g, pv, pt, nv, nt, src, zero),
    CASE WHEN was_interpolated THEN pv + (nv - pv) * (epoch(ts) - epoch(pt)) / (epoch(nt) - epoch(pt)) ELSE src END AS power_filled_w
  FROM f3)"""

CLEANED_SQL = """lim AS (
  SELECT meter, count(*) AS ln, avg(power_w) AS lm, stddev_samp(power_w) AS ls,
    quantile_cont(power_w, 0.25) AS q1, quantile_cont(power_w, 0.75) AS q3
  FROM filled WHERE NOT meter_off AND power_w IS NOT NULL GROUP BY meter),
cleaned AS (
  SELECT f.*,
    coalesce(NOT meter_off AND power_w IS NOT NULL AND ln > 10
      AND (power_w < q1 - 15e-1 * (q3 - q1) OR power_w > q3 + 15e-1 * (q3 - q1)), false) AS outlier_iqr,
    coalesce(NOT meter_off AND power_w IS NOT NULL AND ln > 10 AND ls > 0
      AND abs(power_w - lm) / ls > 3, false) AS outlier_zscore
  FROM filled f LEFT JOIN lim USING (meter))"""

COMBINED_SQL = """nm AS (SELECT building, count(*) AS n_meters FROM registry GROUP BY building),
combined AS (
  SELECT building, kind AS building_kind, ts,
    CASE WHEN count(power_filled_w) = max(n_meters) THEN sum(power_filled_w) END AS power_w,
    CASE WHEN count(power_w) = max(n_meters) THEN sum(power_w) END AS power_raw_w,
    bool_or(meter_off) AS meter_off, bool_or(is_missing) AS is_missing,
    bool_or(was_interpolated) AS was_interpolated, bool_or(outlier_iqr) AS outlier_iqr,
    bool_or(outlier_zscore) AS outlier_zscore,
    max(CASE WHEN role = 'mains' THEN voltage END) AS voltage,
    max(CASE WHEN role = 'mains' THEN power_factor END) AS power_factor,
    max(CASE WHEN role = 'mains' THEN power_w END) AS power_w_mains,
    max(CASE WHEN role = 'ups' THEN power_w END) AS power_w_ups,
    max(CASE WHEN role = 'ups' THEN power_filled_w END) AS power_filled_w_ups,
    bool_or(CASE WHEN role = 'ups' THEN meter_off END) AS meter_off_ups
  FROM cleaned JOIN registry USING (meter) JOIN nm USING (building) GROUP BY 1, 2, 3)"""

WEATHER_SQL = """wxp AS (
  SELECT strptime(valid, '%Y-%m-%d %H:%M') AS ts, try_cast(tmpc AS DOUBLE) AS temp_c, try_cast(relh AS DOUBLE) AS relh FROM wxraw),
wxg AS (SELECT unnest(generate_series(time_bucket(INTERVAL 10 MINUTE, min(ts)),
    CASE WHEN time_bucket(INTERVAL 10 MINUTE, max(ts)) = max(ts) THEN max(ts)
      ELSE time_bucket(INTERVAL 10 MINUTE, max(ts)) + INTERVAL 10 MINUTE END, INTERVAL 10 MINUTE)) AS ts FROM wxp),
wxu AS (SELECT ts, temp_c, relh FROM (SELECT ts FROM wxg UNION SELECT ts FROM wxp) LEFT JOIN wxp USING (ts)),
wxn AS (SELECT *, row_number() OVER (ORDER BY ts) - row_number() OVER (PARTITION BY temp_c IS NULL ORDER BY ts) AS tg,
    row_number() OVER (ORDER BY ts) - row_number() OVER (PARTITION BY relh IS NULL ORDER BY ts) AS hg,
    last_value(temp_c IGNORE NULLS) OVER b AS tpv, first_value(temp_c IGNORE NULLS) OVER a AS tnv,
    last_value(CASE WHEN temp_c IS NOT NULL THEN ts END IGNORE NULLS) OVER b AS tpt,
    first_value(CASE WHEN temp_c IS NOT NULL THEN ts END IGNORE NULLS) OVER a AS tnt,
    last_value(relh IGNORE NULLS) OVER b AS hpv, first_value(relh IGNORE NULLS) OVER a AS hnv,
    last_value(CASE WHEN relh IS NOT NULL THEN ts END IGNORE NULLS) OVER b AS hpt,
    first_value(CASE WHEN relh IS NOT NULL THEN ts END IGNORE NULLS) OVER a AS hnt
  FROM wxu WINDOW b AS (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    a AS (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
wxc AS (SELECT *, count(*) OVER (PARTITION BY temp_c IS NULL, tg) AS tr, count(*) OVER (PARTITION BY relh IS NULL, hg) AS hr FROM wxn),
wx AS (SELECT ts,
    CASE WHEN temp_c IS NULL AND tr <= 12 THEN tpv + (tnv - tpv) * (epoch(ts) - epoch(tpt)) / (epoch(tnt) - epoch(tpt)) ELSE temp_c END AS temp_c,
    CASE WHEN relh IS NULL AND hr <= 12 THEN hpv + (hnv - hpv) * (epoch(ts) - epoch(hpt)) / (epoch(hnt) - epoch(hpt)) ELSE relh END AS relh
  FROM wxc SEMI JOIN wxg USING (ts))"""

VAC = ("((month({d})*100+day({d})) BETWEEN 516 AND 731 OR (month({d})*100+day({d})) BETWEEN 1216 AND 1231 "
       "OR (month({d})*100+day({d})) = 101)")

BUILDINGS_SQL = f"""merged AS (
  SELECT c.*, o.occupancy, w.temp_c, w.relh,
    CASE WHEN w.temp_c IS NOT NULL THEN greatest(w.temp_c - 24e0, 0e0) / 6e0 END AS cdh
  FROM combined c JOIN occ o USING (building, ts) LEFT JOIN wx w USING (ts)),
hist AS (
  SELECT *, lag(power_w, 6) OVER s AS power_lag_1h, lag(power_w, 144) OVER s AS power_lag_1d,
    CASE WHEN count(power_w) OVER d >= 6 THEN avg(power_w) OVER d END AS power_roll24h_mean,
    CASE WHEN count(power_w) OVER d >= 6 THEN stddev_samp(power_w) OVER d END AS power_roll24h_std
  FROM merged WINDOW s AS (PARTITION BY building ORDER BY ts),
    d AS (PARTITION BY building ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 1 SECOND PRECEDING)),
feat AS (
  SELECT h.*, hour(ts)::BIGINT AS hour, (hour(ts) * 60 + minute(ts))::BIGINT AS minute_of_day, month(ts)::BIGINT AS month,
    year(ts)::BIGINT AS year, ts::DATE AS date, dayname(ts) AS weekday, (isodow(ts) - 1)::BIGINT AS day_of_week,
    isodow(ts) >= 6 AS is_weekend,
    coalesce(k.activity = 'L', {VAC.format(d='ts')}) AS is_vacation,
    coalesce(k.working_day = 1, isodow(ts) < 6) AS is_working_day, 'official' AS calendar_source,
    power_w / 1e3 * (10e0 / 60e0) AS kwh
  FROM hist h LEFT JOIN calendar k ON h.ts::DATE = k.date),
buildings AS (
  SELECT *, NOT is_vacation AS is_semester, CASE WHEN is_vacation THEN 'vacation' ELSE 'semester' END AS period,
    power_w IS NOT NULL AND NOT meter_off AND occupancy IS NOT NULL AS usable
  FROM feat)"""

# name -> (needed first, SQL)
CTES = {
    "registry": ((), R.REGISTRY_SQL), "ev": ((), R.EV_SQL), "calendar": ((), R.CALENDAR_SQL),
    "readings": (("ev",), R.READINGS_SQL), "clean": (("readings",), R.CLEAN_SQL),
    "blocks": (("clean",), R.BLOCKS_SQL), "off": (("blocks",), RUNS_SQL.format(need=2)),
    "filled": (("off",), FILL_SQL), "cleaned": (("filled",), CLEANED_SQL),
    "occ": (("ev",), R.OCC_SQL), "wxraw": (("ev",), R.WEATHER_RAW_SQL), "wx": (("wxraw",), WEATHER_SQL),
    "combined": (("cleaned", "registry"), COMBINED_SQL),
    "buildings": (("combined", "occ", "wx", "calendar"), BUILDINGS_SQL),
}


def _order(name: str, seen: list[str]) -> None:
    for need in CTES[name][0]:
        _order(need, seen)
    if name not in seen:
        seen.append(name)


def sql(body: str, *needs: str, extra: str = "") -> str:
    """The query text with every CTE it needs; `extra` holds CTEs of its own."""
    seen: list[str] = []
    for n in needs:
        _order(n, seen)
    parts = [CTES[n][1] for n in seen] + ([extra] if extra else [])
    return (f"WITH {', '.join(parts)} " if parts else "") + body


def r(expr: str, name: str) -> str:
    return f"round(({expr}) + 31e-11, 6) + 0 AS {name}"


def rs(*pairs) -> str:
    """'a' or ('expr', 'name') -> rounded select list."""
    return ", ".join(r(p, p) if isinstance(p, str) else r(*p) for p in pairs)


def i(expr: str, name: str | None = None) -> str:
    return f"({expr})::BIGINT AS {name or expr}"


def is_(*pairs) -> str:
    return ", ".join(i(p) if isinstance(p, str) else i(*p) for p in pairs)


def t(expr: str, name: str | None = None) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S') AS {name or expr}"


def d(expr: str, name: str | None = None) -> str:
    return f"strftime({expr}, '%Y-%m-%d') AS {name or expr}"


def normal_sql(z: str, steps: int = 200) -> str:
    """P(Z <= z) by Simpson's rule from 0."""
    return (f"(5e-1 + {z} / {steps} / 3e0 / sqrt(2 * pi()) * list_sum(list_transform(range(0, {steps} + 1), lambda k: "
            f"(CASE WHEN k = 0 OR k = {steps} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * exp(-({z} * k / {steps}) * ({z} * k / {steps}) / 2))))")


def t_sql(t_: str, df: str, steps: int = 4000) -> str:
    """P(|T| > |t|) by Simpson's rule from 0."""
    return (f"(1 - 2 * exp(lgamma(({df} + 1) / 2e0) - lgamma({df} / 2e0)) / sqrt({df} * pi()) * abs({t_}) / {steps} / 3e0 * list_sum(list_transform(range(0, {steps} + 1), "
            f"lambda k: (CASE WHEN k = 0 OR k = {steps} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * pow(1 + ({t_} * k / {steps}) * ({t_} * k / {steps}) / {df}, -({df} + 1) / 2e0))))")
