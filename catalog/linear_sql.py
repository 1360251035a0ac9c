"""Least squares in DuckDB: the smallest solution of the normal equations, for the linear models' oracles.

The centred matrix of products is inverted with a little added to its diagonal, by elimination over
lists, and the residual of the normal equations is put through it again and again. Each round
shrinks what is left in the directions the rows determine; in the others nothing ever enters, so the
limit is the solution of least norm.
"""

from __future__ import annotations

LAMBDA, ROUNDS, NUMBERS = "1e-5", 8, ("occupancy", "temp_c", "cdh")
DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
WIDTH = 24 + 7 + 12 + 3 + len(NUMBERS)


def linear_sql(rows: str, models: dict[str, tuple], name: str = "lin") -> str:
    """CTEs that end in `name`(g, model, train, ts, split, y, p). `rows` is a table with a group g, a
    flag train, ts, split, power_w and the features; every model is a tuple of NUMBERS it uses."""
    v = lambda x: f"{name}_{x}"
    used = ", ".join(f"('{m}', [{', '.join(f'{float(x in use)}::DOUBLE' for x in NUMBERS)}])" for m, use in models.items())
    days = ", ".join(f"'{d}'" for d in DAYS)
    numbers = ", ".join(f"coalesce({x}, 0e0) * u[{k + 1}] / s{k}" for k, x in enumerate(NUMBERS))
    scales = ", ".join(f"coalesce(nullif(stddev_pop({x}) FILTER (WHERE train), 0), 1) AS s{k}" for k, x in enumerate(NUMBERS))
    every = f"range(1, {WIDTH + 1})"
    return f"""
{v('b')} AS (SELECT g, min(hour) FILTER (WHERE train) AS h0, min(weekday) FILTER (WHERE train) AS w0, min(month) FILTER (WHERE train) AS m0, {scales} FROM {rows} GROUP BY 1),
{v('x')} AS (SELECT r.g, model, train, ts, split, power_w AS y, list_transform(range(0, 24), lambda k: (hour = k AND k <> h0)::INT::DOUBLE)
    || list_transform([{days}], lambda k: (weekday = k AND k <> w0)::INT::DOUBLE) || list_transform(range(1, 13), lambda k: (month = k AND k <> m0)::INT::DOUBLE)
    || [is_weekend::INT::DOUBLE, is_semester::INT::DOUBLE, is_working_day::INT::DOUBLE] || [{numbers}] AS x
  FROM {rows} r JOIN {v('b')} b ON b.g = r.g, (VALUES {used}) u(model, u)),
{v('n')} AS (SELECT g, model, count(*) AS n, avg(y) AS ybar FROM {v('x')} WHERE train GROUP BY 1, 2),
{v('t')} AS (SELECT g, model, list_filter(list_transform({every}, lambda k: {{'k': k, 'x': x[k]}}), lambda e: e.x <> 0) AS e, y FROM {v('x')} WHERE train),
{v('u')} AS (SELECT g, model, e, unnest(e) AS a, y FROM {v('t')}),
{v('m')} AS (SELECT g, model, a.k AS i, sum(a.x) AS sx, sum(a.x * y) AS sxy FROM {v('u')} GROUP BY 1, 2, 3),
{v('p')} AS (SELECT g, model, a.k AS i, e2.k AS j, sum(a.x * e2.x) AS sxx FROM (SELECT g, model, a, unnest(e) AS e2 FROM {v('u')}) GROUP BY 1, 2, 3, 4),
{v('f')} AS (SELECT n.g, n.model, n, ybar, i, coalesce(sx, 0) / n AS mean, coalesce(sxy, 0) / n - coalesce(sx, 0) / n * ybar AS b
  FROM {v('n')} n CROSS JOIN (SELECT unnest({every}) AS i) LEFT JOIN {v('m')} USING (g, model, i)),
{v('r')} AS (SELECT a.g, a.model, a.i, list(coalesce(sxx, 0) / a.n - a.mean * c.mean ORDER BY c.i) AS r
  FROM {v('f')} a JOIN {v('f')} c ON c.g = a.g AND c.model = a.model LEFT JOIN {v('p')} p ON p.g = a.g AND p.model = a.model AND p.i = a.i AND p.j = c.i GROUP BY 1, 2, 3),
{v('g')} AS (SELECT g, model, list(r ORDER BY i) AS gram FROM {v('r')} GROUP BY 1, 2),
{v('i')} AS (SELECT g, model, 1 AS k, list_transform(gram, lambda row, i: list_transform(row, lambda e, j: e + CASE WHEN i = j THEN {LAMBDA} ELSE 0 END)) AS m FROM {v('g')}
  UNION ALL SELECT g, model, k + 1, list_transform(m, lambda row, i: list_transform(row, lambda e, j: CASE WHEN i = k AND j = k THEN 1 / m[k][k] WHEN i = k THEN e / m[k][k]
    WHEN j = k THEN -e / m[k][k] ELSE e - row[k] * m[k][j] / m[k][k] END)) FROM {v('i')} WHERE k <= {WIDTH}),
{v('s')} AS (SELECT g, model, list(b ORDER BY i) AS b, list(mean ORDER BY i) AS mean, any_value(ybar) AS ybar FROM {v('f')} GROUP BY 1, 2),
{v('w')} AS (SELECT g, model, 0 AS k, list_transform({every}, lambda q: 0e0) AS w FROM {v('g')}
  UNION ALL SELECT w.g, w.model, w.k + 1, list_transform(w.w, lambda e, q: e + list_dot_product(m[q], list_transform(b, lambda t, o: t - list_dot_product(gram[o], w.w))))
  FROM {v('w')} w JOIN {v('s')} s ON s.g = w.g AND s.model = w.model JOIN {v('g')} a ON a.g = w.g AND a.model = w.model
    JOIN (SELECT g, model, m FROM {v('i')} WHERE k = {WIDTH + 1}) z ON z.g = w.g AND z.model = w.model WHERE w.k < {ROUNDS}),
{name} AS (SELECT x.g, x.model, train, ts, split, y, ybar - list_dot_product(mean, w) + list_dot_product(x, w) AS p
  FROM {v('x')} x JOIN {v('s')} s ON s.g = x.g AND s.model = x.model JOIN {v('w')} w ON w.g = x.g AND w.model = x.model AND w.k = {ROUNDS})"""


def scores_sql(name: str = "lin", out: str = "scores") -> str:
    """CTEs `bias`, `scored_rows` and `out`: scores per split, and of the test split after the correction."""
    return f"""bias_{name} AS (SELECT g, model, avg(y - p) AS bias FROM {name} WHERE split = 'validation' GROUP BY 1, 2),
{out} AS (SELECT g AS building, model, split, count(*) AS n, avg(abs(y - p)) AS mae_w, sqrt(avg((y - p) * (y - p))) AS rmse_w,
    1 - sum((y - p) * (y - p)) / nullif(regr_syy(y, y), 0) AS r2, 100 * avg(abs((y - p) / nullif(y, 0))) AS mape_pct
  FROM (SELECT g, model, split, y, p FROM {name} UNION ALL SELECT l.g, l.model, 'test_corrected', y, p + bias FROM {name} l
    JOIN bias_{name} b ON b.g = l.g AND b.model = l.model WHERE split = 'test') GROUP BY 1, 2, 3)"""
