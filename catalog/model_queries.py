"""Expected-power models and day profiles. The linear models' oracles solve the normal equations
in SQL (catalog.linear_sql); deeper forests and whole day types have none."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from catalog.linear_sql import linear_sql, scores_sql
from catalog.registry import query
from catalog.sql import VAC, d, i, is_, r, rs, sql, t, t_sql
from catalog.detector_queries import LABEL_SQL, SPLIT_SQL
from voltloom.functions import columns as C
from voltloom.operators import anomaly, clusters, days, forest, models, stats
from voltloom.plans import experiment
from voltloom.session import stage

B = ["building"]
#: Place of the published depth among those grown.
D12 = forest.DEPTHS.index(12)


def fitted_sql(body: str, rows: str, fitted: dict, more: str = "") -> str:
    """A query on `lin` and `scores`, the models fitted to `lr`: `rows` are its CTEs after SPLIT_SQL, `more` those after the fit."""
    return sql(body, "buildings", extra=f"{SPLIT_SQL}, {rows}, {linear_sql('lr', fitted)}, {scores_sql()}{more}").replace("WITH ", "WITH RECURSIVE ", 1)


TIME_ROWS = "lr AS (SELECT building AS g, split = 'train' AS train, * FROM sp)"
LARGE_ROWS = "lr AS (SELECT building AS g, split = 'train' AS train, * FROM sp WHERE n >= 2000)"
WEATHER_ROWS = """wn AS (SELECT building, least(count(*) FILTER (WHERE k AND split = 'train'), count(*) FILTER (WHERE k AND split = 'validation'), count(*) FILTER (WHERE k AND split = 'test')) AS least_rows
    FROM (SELECT *, temp_c IS NOT NULL AND cdh IS NOT NULL AS k FROM sp) GROUP BY 1),
  lr AS (SELECT sp.building AS g, split = 'train' AS train, sp.* FROM sp JOIN wn USING (building) WHERE least_rows >= 500 AND temp_c IS NOT NULL AND cdh IS NOT NULL)"""
WEATHER_REASON = "CASE WHEN least_rows < 500 THEN 'fewer than 500 weather rows in a split' END"
FOLD_ROWS = """fo AS (SELECT *, CASE WHEN q < m - 5 * (m // 6) THEN 0 ELSE (q - (m - 5 * (m // 6))) // (m // 6) + 1 END AS fold FROM (
    SELECT *, row_number() OVER (PARTITION BY building ORDER BY ts) - 1 AS q, count(*) OVER (PARTITION BY building) AS m FROM sp WHERE split = 'train')),
  lr AS (SELECT building || '|' || k AS g, fold < k AS train, fo.* FROM fo, (SELECT unnest(range(1, 6)) AS k) WHERE fold <= k)"""
SCORES = rs("mae_w", "rmse_w", "r2", "mape_pct")
GAINS = """SELECT building, any_value(least_rows) AS least_rows, v('E') - v('B_w') AS a, v('F') - v('C_w') AS b, v('C_w') - v('B_w') AS c, v('F') - v('E') AS d
  FROM wn LEFT JOIN (SELECT * FROM scores WHERE split = 'validation') USING (building) GROUP BY 1"""
for _m in ("B_w", "C_w", "E", "F"):
    GAINS = GAINS.replace(f"v('{_m}')", f"max(r2) FILTER (WHERE model = '{_m}')")


@query("m02_m03_fit_and_score", fitted_sql(f"SELECT building, model, split, {i('n')}, {SCORES} FROM scores", TIME_ROWS, models.TIME_MODELS))
def _(w):
    return models.fit_and_score(w.split, B)


# Least squares is right exactly if the residuals of the training rows are orthogonal to
# every column of the design, which SQL can say without solving anything.
def moments_sql(train: str) -> str:
    """CTEs: tr, the training rows; fcols, the design columns each building has."""
    return SPLIT_SQL + f""", {train}, fcols AS (
      SELECT DISTINCT building, 'hour=' || hour AS feature FROM tr UNION ALL SELECT DISTINCT building, 'weekday=' || weekday FROM tr
      UNION ALL SELECT DISTINCT building, 'month=' || month FROM tr
      UNION ALL SELECT DISTINCT building, unnest(['is_weekend', 'is_semester', 'is_working_day']) FROM tr)"""


TIME_TRAIN = "tr AS (SELECT * FROM sp WHERE split = 'train')"
WEATHER_TRAIN = """okw AS (SELECT building FROM sp WHERE temp_c IS NOT NULL AND cdh IS NOT NULL GROUP BY 1
    HAVING least(count(*) FILTER (WHERE split = 'train'), count(*) FILTER (WHERE split = 'validation'), count(*) FILTER (WHERE split = 'test')) >= 100),
  tr AS (SELECT * FROM sp WHERE split = 'train' AND temp_c IS NOT NULL AND cdh IS NOT NULL AND building IN (SELECT building FROM okw))"""


def _moments(w, rows, fitted, numeric):
    coefs = models.fit_linear(rows.filter("split = 'train'"), B, fitted)
    p = models.predict(rows.filter("split = 'train'"), coefs, B).withColumn("e", F.col("power_w") - F.col("predicted_w"))
    cells = p.groupBy("building", "model", *models.CELL_KEYS).agg(F.sum("e").alias("e"), F.count(F.lit(1)).alias("n"))
    one = lambda name, on: F.struct(name.alias("feature"), on.alias("x"))
    cols = [one(F.concat(F.lit(f"{f}="), F.col(f).cast("string")), F.lit(1.0)) for f in ("hour", "weekday", "month")]
    cols += [one(F.lit(b), F.col(b).cast("double")) for b in models.BINARIES]
    m = (cells.withColumn("_c", F.explode(F.array(*cols))).groupBy("building", "model", F.col("_c.feature").alias("feature"))
         .agg((F.sum(F.col("e") * F.col("_c.x")) / F.sum("n")).alias("mean_product")))
    extra = p.groupBy("building", "model").agg(*[F.avg(F.col("e") * F.col(x)).alias(x) for x in numeric])
    extra = extra.unpivot(["building", "model"], numeric, "feature", "mean_product")
    used = F.lit(False)
    for name, xs in fitted.items():
        used = used | ((F.col("model") == name) & F.col("feature").isin(*xs)) if xs else used
    return m.unionByName(extra.filter(used)).withColumn("mean_product", F.round("mean_product", 6) + F.lit(0.0))


@query("m02_normal_equations", sql("""SELECT building, model, feature, 0e0 AS mean_product FROM fcols, (VALUES ('B'), ('C')) m(model)
  UNION ALL SELECT DISTINCT building, 'C', 'occupancy', 0e0 FROM tr""", "buildings", extra=moments_sql(TIME_TRAIN)))
def _(w):
    return _moments(w, w.split, models.TIME_MODELS, ["occupancy"])


@query("m08_normal_equations", sql("""SELECT building, model, feature, 0e0 AS mean_product FROM fcols, (VALUES ('B_w'), ('C_w'), ('E'), ('F')) m(model)
  UNION ALL SELECT building, model, feature, 0e0 FROM (SELECT DISTINCT building FROM tr), (VALUES ('C_w', 'occupancy'), ('E', 'temp_c'), ('E', 'cdh'),
    ('F', 'occupancy'), ('F', 'temp_c'), ('F', 'cdh')) m(model, feature)""", "buildings", extra=moments_sql(WEATHER_TRAIN)))
def _(w):
    return _moments(w, models.weather_rows(w.split, B, 100), models.WEATHER_MODELS, ["occupancy", "temp_c", "cdh"])


@query("m04_large_enough_buildings", fitted_sql(f"""SELECT building, {i('any_value(u)', 'usable_rows')}, model,
    any_value(CASE WHEN u < 2000 THEN 'fewer than 2000 usable rows' END) AS reason, {rs(*[(f"max({c}) FILTER (WHERE split = '{s}')", o) for s, c, o in (("train", "r2", "train_r2"), ("validation", "r2", "val_r2"), ("test", "r2", "test_r2"),
    ("test_corrected", "r2", "test_corrected_r2"), ("validation", "mae_w", "val_mae_w"), ("test", "mae_w", "test_mae_w"), ("test", "rmse_w", "test_rmse_w"))])}
  FROM (SELECT building, count(*) FILTER (WHERE usable) AS u FROM buildings GROUP BY 1) LEFT JOIN scores USING (building) GROUP BY building, model""", LARGE_ROWS, models.TIME_MODELS))
def _(w):
    table = models.model_table(models.fit_and_score(models.large_enough(w.split, B), B), B)
    return models.every_key(table, models.usable_rows(w.buildings, B), B, models.MIN_ROWS)


def _scores(w):
    return models.fit_and_score(w.split, B)


@query("m14_a44_occupancy_contribution", fitted_sql(f"""SELECT building, {rs(('max(r2) FILTER (WHERE b)', 'b_val_r2'), ('max(r2) FILTER (WHERE NOT b)', 'c_val_r2'),
    ('max(r2) FILTER (WHERE NOT b) - max(r2) FILTER (WHERE b)', 'r2_gain'), ('max(mae_w) FILTER (WHERE b)', 'b_val_mae_w'), ('max(mae_w) FILTER (WHERE NOT b)', 'c_val_mae_w'),
    ('100 * (max(mae_w) FILTER (WHERE b) - max(mae_w) FILTER (WHERE NOT b)) / nullif(max(mae_w) FILTER (WHERE b), 0)', 'mae_improvement_pct'))}
  FROM (SELECT *, model = 'B' AS b FROM scores WHERE split = 'validation') GROUP BY 1""", TIME_ROWS, models.TIME_MODELS))
def _(w):
    return models.occupancy_contribution(models.model_table(_scores(w), B), B)


def _weather_scores(w):
    return models.weather_models(w.split, B)


@query("m08_weather_models", fitted_sql(f"""SELECT building, {i('least_rows', 'weather_rows_in_a_split')}, {WEATHER_REASON} AS reason, model, split, {i('n')}, {SCORES}
  FROM wn LEFT JOIN scores USING (building)""", WEATHER_ROWS, models.WEATHER_MODELS))
def _(w):
    return _weather_scores(w)


GAIN_NAMES = rs(("a", "weather_gain_without_occupancy"), ("b", "weather_gain_with_occupancy"), ("c", "occupancy_gain_without_weather"),
                ("d", "occupancy_gain_given_weather"))


@query("m08_a44_weather_gains", fitted_sql(f"SELECT building, {WEATHER_REASON} AS reason, {GAIN_NAMES} FROM ({GAINS})", WEATHER_ROWS, models.WEATHER_MODELS))
def _(w):
    return models.weather_gains(_weather_scores(w), B)


@query("a44_gain_summary", fitted_sql(f"""SELECT {rs(('avg(c)', 'mean_gain_without_weather'), ('avg(d)', 'mean_gain_given_weather'),
    ('100 * (1 - avg(d) / nullif(avg(c), 0))', 'shrinkage_pct'))} FROM ({GAINS})""", WEATHER_ROWS, models.WEATHER_MODELS))
def _(w):
    return models.gain_summary(models.weather_gains(_weather_scores(w), B))


@query("m09_cross_validation", fitted_sql(f"""SELECT building, model, {i('count(*)', 'folds')}, {rs(('avg(mae)', 'cv_mae_mean_w'), ('stddev_pop(mae)', 'cv_mae_std_w'))} FROM (
  SELECT split_part(g, '|', 1) AS building, g, model, avg(abs(y - p)) AS mae FROM lin WHERE NOT train GROUP BY 1, 2, 3) GROUP BY 1, 2""", FOLD_ROWS, models.TIME_MODELS))
def _(w):
    return models.cross_validate(w.split.filter("split = 'train'").drop("pos", "n_rows"), B, rules=w.rules)


@query("m10_residuals", fitted_sql(f"""SELECT lin.g AS building, lin.model, {t('ts')}, {rs(('y', 'power_w'), ('p + bias', 'predicted_w'), ('y - p - bias', 'residual_w'))}
  FROM lin JOIN bias_lin b ON b.g = lin.g AND b.model = lin.model WHERE split = 'test'""", TIME_ROWS, models.TIME_MODELS))
def _(w):
    return w.expected.filter("split = 'test'").select("building", "model", "ts", "power_w", "predicted_w", "residual_w")


LEVELS = (" UNION ALL ".join(
    [f"SELECT building, '{f}' AS f, {f}::VARCHAR AS lv, {o} AS o, power_w AS y, 1 AS k FROM tr" for f, o in (("hour", "hour"), ("weekday", "0"), ("month", "month"))]))
FEATURE_SQL = SPLIT_SQL + f""", tr AS (SELECT * FROM sp WHERE split = 'train'),
lev AS ({LEVELS}),
dummy AS (SELECT building, f, lv, row_number() OVER (PARTITION BY building, f ORDER BY o, lv) AS rn FROM (SELECT DISTINCT building, f, lv, o FROM lev)),
cols AS (SELECT tr.building, d.f || '_' || d.lv AS feature, (CASE d.f WHEN 'hour' THEN hour::VARCHAR WHEN 'weekday' THEN weekday ELSE month::VARCHAR END = d.lv)::INT::DOUBLE AS x, power_w AS y
    FROM tr JOIN dummy d ON d.building = tr.building AND d.rn > 1
  UNION ALL SELECT building, unnest(['is_weekend', 'is_semester', 'is_working_day', 'occupancy']),
    unnest([is_weekend::INT::DOUBLE, is_semester::INT::DOUBLE, is_working_day::INT::DOUBLE, occupancy]), power_w FROM tr),
fc AS (SELECT building, feature, count(*) AS n, CASE WHEN stddev_pop(x) > 0 THEN corr(x, y) ELSE 0e0 END AS c, stddev_pop(x) > 0 AS varies FROM cols GROUP BY 1, 2)"""


@query("m06_feature_selection", sql(f"""SELECT building, feature, {rs(('c', 'correlation'), ('CASE WHEN varies THEN c * c / (1 - c * c) * (n - 2) END', 'f_score'))}
  FROM fc""", "buildings", extra=FEATURE_SQL))
def _(w):
    return models.select_features(w.split.filter("split = 'train'"), B).select("building", "feature", "correlation", "f_score")


@query("m06_selected_with_p_values", sql(f"""SELECT building, feature, {rs(('c', 'correlation'), ('f', 'f_score'), (t_sql('sqrt(f)', '(n - 2)'), 'p_value'))}, true AS kept
  FROM (SELECT *, CASE WHEN varies THEN c * c / (1 - c * c) * (n - 2) END AS f FROM fc) QUALIFY row_number() OVER (PARTITION BY building ORDER BY round(f, 9) DESC NULLS LAST, feature) <= 15""",
  "buildings", extra=FEATURE_SQL))
def _(w):
    f = models.select_features(w.split.filter("split = 'train'"), B)
    return models.with_f_pvalue(f.filter("kept")).drop("N")


# the same recurrence with one CTE per degree: p the newest polynomial, q the one before, f the fit so far;
# a polynomial that vanishes on the training rows adds nothing
def _degree(k: int) -> str:
    before = f"LEFT JOIN s{k - 1} r ON r.building = a.building" if k else "LEFT JOIN (SELECT NULL::DOUBLE AS pp) r ON true"
    return f"""s{k} AS (SELECT a.building, a.zpp, a.yp, r.pp AS before, CASE WHEN a.pp > 1e-9 * coalesce(r.pp, 0) AND coalesce(r.pp, 1) > 0 THEN a.pp ELSE 0 END AS pp FROM (
    SELECT building, sum(p * p) FILTER (WHERE split = 'train') AS pp, sum(z * p * p) FILTER (WHERE split = 'train') AS zpp,
      sum(y * p) FILTER (WHERE split = 'train') AS yp FROM p{k} GROUP BY 1) a {before}),
p{k + 1} AS (SELECT p.building, split, z, y, (z - coalesce(zpp / nullif(pp, 0), 0)) * p - coalesce(pp / nullif(before, 0), 0) * q AS p, p AS q,
    f + coalesce(yp / nullif(pp, 0), 0) * p AS f FROM p{k} p JOIN s{k} s ON s.building = p.building)"""


POLY_SQL = SPLIT_SQL + """, om AS (SELECT building, avg(occupancy) AS m, stddev_pop(occupancy) AS sd FROM sp WHERE split = 'train' GROUP BY 1),
p0 AS (SELECT sp.building, split, (occupancy - m) / sd AS z, power_w AS y, 1e0 AS p, 0e0 AS q, 0e0 AS f FROM sp JOIN om ON om.building = sp.building WHERE split <> 'test'), """ + ", ".join(map(_degree, range(11)))


@query("m07_polynomial_curve", sql(" UNION ALL ".join(f"""SELECT building, {i(str(k), 'degree')}, {rs(("avg(abs(y - f)) FILTER (WHERE split = 'train')", 'train_mae_w'),
    ("avg(abs(y - f)) FILTER (WHERE split = 'validation')", 'val_mae_w'))} FROM p{k + 1} GROUP BY 1""" for k in range(1, 11)), "buildings", extra=POLY_SQL))
def _(w):
    return models.polynomial_curve(w.split, B)


LAG_SQL = """lf AS (SELECT building, ts, power_w AS y, occupancy AS a, power_lag_1h AS b, row_number() OVER (PARTITION BY building ORDER BY ts) - 1 AS pos,
    count(*) OVER (PARTITION BY building) AS n FROM buildings WHERE usable AND power_lag_1h IS NOT NULL),
ls AS (SELECT *, CASE WHEN pos < floor(7e-1 * n) THEN 'train' WHEN pos < floor(7e-1 * n) + floor((15e-2 / (1e0 - 7e-1)) * (n - floor(7e-1 * n))) THEN 'validation' ELSE 'test' END AS split FROM lf),
lm AS (SELECT building, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS saa, var_pop(b) AS sbb, covar_pop(a, b) AS sab, covar_pop(y, a) AS sya, covar_pop(y, b) AS syb
  FROM ls WHERE split = 'train' GROUP BY 1),
lp AS (SELECT ls.building, 'occupancy' AS model, y, my + sya / saa * (a - ma) AS p FROM ls JOIN lm USING (building) WHERE split = 'validation'
  UNION ALL SELECT ls.building, 'occupancy + lag', y, my + (sbb * sya - sab * syb) / (saa * sbb - sab * sab) * (a - ma) + (saa * syb - sab * sya) / (saa * sbb - sab * sab) * (b - mb)
  FROM ls JOIN lm USING (building) WHERE split = 'validation')"""


@query("m11_lag_trap", sql(f"""SELECT building, model, 'validation' AS split, {i('count(*)', 'n')}, {rs(('avg(abs(y - p))', 'mae_w'), ('sqrt(avg((y - p) * (y - p)))', 'rmse_w'),
    ('1 - sum((y - p) * (y - p)) / regr_syy(y, y)', 'r2'), ('100 * avg(abs((y - p) / nullif(y, 0)))', 'mape_pct'))} FROM lp GROUP BY 1, 2""", "buildings", extra=LAG_SQL))
def _(w):
    return models.lag_trap(w.buildings, rules=w.rules)


@query("m05_forest_scores")
def _(w):
    return models.forest_scores(w.forest, w.split, B, D12)


@query("m04_all_models")
def _(w):
    """Models B, C and D of every building side by side."""
    both = models.fit_and_score(w.split, B).unionByName(models.forest_scores(w.forest, w.split, B, D12))
    return models.model_table(both, B)


@query("m05_forest_importances")
def _(w):
    return forest.importances(w.forest, B)


# what holds of any forest: as many rows as the split has, importances that add up to one
@query("m05_forest_properties", sql(f"""SELECT building, {is_(("count(*) FILTER (WHERE split = 'train')", 'train_rows'), ("count(*) FILTER (WHERE split = 'validation')", 'validation_rows'),
    ("count(*) FILTER (WHERE split = 'test')", 'test_rows'))}, {i('44', 'features')}, 1e0 AS importance, true AS better_than_mean_in_train FROM sp GROUP BY 1""", "buildings", extra=SPLIT_SQL))
def _(w):
    s = models.forest_scores(w.forest, w.split, B, D12)
    at = lambda x: F.max(F.when(F.col("split") == x, F.col("n"))).alias(f"{x}_rows")
    rows = s.groupBy("building").agg(at("train"), at("validation"), at("test"), F.bool_or((F.col("split") == "train") & (F.col("r2") > 0)).alias("better_than_mean_in_train"))
    imp = forest.importances(w.forest, B).groupBy("building").agg(F.count(F.lit(1)).alias("features"), F.sum("importance").alias("importance"))
    return rows.join(imp, "building")


# SQL follows four trees two levels down, from the same draws: candidates of every node, the best, its children
def _level(k: int) -> str:
    return f"""c{k} AS (SELECT building, tree, node, ord, sum(w) AS ni, sum(wy) AS si FROM (SELECT *, unnest(cols) AS ord FROM n{k}) GROUP BY ALL),
t{k} AS (SELECT building, tree, node, sum(w) AS n, sum(wy) AS s FROM n{k} GROUP BY ALL),
b{k} AS (SELECT * FROM (SELECT c.building, c.tree, c.node, ord, round((si * si / ni + (s - si) * (s - si) / (n - ni) - s * s / n) / scale, 9) AS gain
    FROM c{k} c JOIN t{k} t ON c.building = t.building AND c.tree = t.tree AND c.node = t.node JOIN rt ON rt.building = c.building AND rt.tree = c.tree
    WHERE ni >= 5 AND n - ni >= 5) WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY building, tree, node ORDER BY gain DESC, ord) = 1),
n{k + 1} AS (SELECT n.* EXCLUDE (node), CASE WHEN b.ord IS NULL THEN node || 'x' WHEN list_contains(cols, b.ord) THEN node || '1' ELSE node || '0' END AS node
  FROM n{k} n LEFT JOIN b{k} b USING (building, tree, node))"""


SHALLOW_SQL = SPLIT_SQL + f""", eg AS (SELECT building, list_distinct(quantile_cont(occupancy, [{', '.join(f'{k}e0 / 64' for k in range(1, 64))}])) AS e FROM sp WHERE split = 'train' GROUP BY 1),
fe AS (SELECT sp.building, ts, split, power_w, list_filter([hour, CASE WHEN isodow(ts) > 1 THEN 22 + isodow(ts) END, CASE WHEN month > 1 THEN 28 + month END,
    CASE WHEN is_weekend THEN 41 END, CASE WHEN is_semester THEN 42 END, CASE WHEN is_working_day THEN 43 END]
    || list_transform(list_filter(list_sort(e), lambda x: x >= occupancy), lambda x: 43 + list_position(list_sort(e), x)), lambda o: o > 0) AS cols FROM sp JOIN eg ON eg.building = sp.building),
dw AS (SELECT *, ('0x' || substr(md5('42|' || building || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '|0'), 1 + 4 * tree, 4))::INT AS u FROM fe, range(4) q(tree)),
n0 AS (SELECT building, ts, split, power_w, cols, tree, 'n' AS node, CASE WHEN split = 'train' THEN {' + '.join(f'(u >= {p})::INT' for p in forest.POISSON)} ELSE 0 END AS w, w * power_w AS wy FROM dw),
rt AS (SELECT building, tree, sum(wy) / sum(w) * sum(wy) AS scale FROM n0 GROUP BY 1, 2),
{_level(0)}, {_level(1)},
lf AS (SELECT building, tree, node, sum(wy) / sum(w) AS p FROM n2 GROUP BY 1, 2, 3),
pr AS (SELECT building, ts, split, any_value(power_w) AS y, avg(p) AS p FROM n2 JOIN lf USING (building, tree, node) GROUP BY 1, 2, 3)"""


@query("m05_shallow_forest", sql(f"""SELECT building, split, {i('count(*)', 'n')}, {rs(('avg(abs(y - p))', 'mae_w'), ('avg(p)', 'mean_predicted_w'), ('stddev_pop(p)', 'sd_predicted_w'))}
  FROM pr GROUP BY 1, 2""", "buildings", extra=SHALLOW_SQL))
def _(w):
    """Four trees of depth two: their draws, splits and means are those of the whole forest."""
    p = forest.predictions(forest.grow(w.split, B, trees=4, depths=(2,)), w.split, B)
    return p.groupBy("building", "split").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("power_w") - F.col("predicted_w"))).alias("mae_w"),
                                              F.avg("predicted_w").alias("mean_predicted_w"), F.stddev_pop("predicted_w").alias("sd_predicted_w"))


@query("m05_stump", sql(f"""SELECT building, tree, {is_('ord')}, {rs('gain')} FROM b0""", "buildings", extra=SHALLOW_SQL))
def _(w):
    """The first split of four trees: the column's place in the forest's order and the gain as a share of the root's square."""
    rows = stage(forest.weighted(forest.with_cells(w.split, B), B, 4, "power_w", 42), "stump")

    def best(pdf):
        part, rest = {}, pdf["cell"].to_numpy()
        for name, size in forest.PARTS:
            rest, part[name] = np.divmod(rest, size)
        n, s = pdf["w"].sum(), pdf["wy"].sum()
        ni, si = (forest.histograms(part, np.zeros(len(pdf), np.int64), 1, pdf[c].to_numpy())[0] for c in ("w", "wy"))
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where((ni >= 5) & (n - ni >= 5), np.round((si * si / ni + (s - si) ** 2 / (n - ni) - s * s / n) / (s * s / n), 9), 0)
        return pd.DataFrame({"building": pdf["building"].iloc[:1], "tree": pdf["tree"].iloc[:1], "ord": [gain.argmax() + 1], "gain": [gain.max()]})

    return rows.groupBy("building", "tree").applyInPandas(best, "building string, tree bigint, ord bigint, gain double").filter("gain > 0")


@query("m07_forest_depth_curve")
def _(w):
    return forest.depth_curve(w.forest, w.split, B)


@query("n03_hashed_experiment")
def _(w):
    low = C.is_low("occupancy", F.lit(1.0))
    test = stage(experiment.labelled_test(w.expected, B, low, rules=w.rules), "labelled")
    scored = anomaly.score_detector(test, ["building", "detector"], rules=w.rules)
    return anomaly.evaluate_by_type(scored, ["building", "detector"])


_H = lambda what: f"('0x' || substr(md5('42|{what}|' || building || '|' || pos), 1, 15))::BIGINT"
_U = lambda what: f"(({_H(what)} % 1000003) / 1000003e0)"
PLACED_SQL = SPLIT_SQL + f""", tp AS (SELECT building, pos - ntr - nv AS pos, n - ntr - nv AS nr, occupancy <= 1 AS low FROM sp WHERE split = 'test'),
tq AS (SELECT building, nr, low, pos::BIGINT AS pos FROM tp),
ca AS (SELECT building, 'spike' AS type, pos, nr, {_H('spike')} AS h, floor((10 + {_H('spike-minutes')} % 21) / 1e1)::BIGINT AS len, 5e-1 + 5e-1 * {_U('spike-size')} AS mag FROM tq
  UNION ALL SELECT building, 'waste', pos, nr, {_H('waste')}, floor((2 + 4 * {_U('waste-hours')}) * 6)::BIGINT, 15e-2 + 15e-2 * {_U('waste-size')} FROM tq WHERE low),
cr AS (SELECT *, row_number() OVER (PARTITION BY building, type ORDER BY h, pos) AS r FROM ca WHERE pos + len <= nr),
ci AS (SELECT *, CASE type WHEN 'spike' THEN r ELSE r + 200 END AS id FROM cr WHERE r <= CASE type WHEN 'spike' THEN 200 ELSE 10000 END),
pl AS (SELECT building, unnest(list_reduce(list([{{'id': id, 's': pos, 'e': pos + len}}] ORDER BY id), lambda a, x: CASE
    WHEN (x[1].id > 200 AND len(list_filter(a, lambda p: p.id > 200)) >= 200) OR len(list_filter(a, lambda p: p.s < x[1].e AND x[1].s < p.e)) > 0
    THEN a ELSE list_concat(a, x) END)) AS p FROM ci GROUP BY building)"""


@query("n03_placed_events", sql(f"""SELECT ci.building, type, {is_(('id', 'event_id'), ('pos', 'start_pos'), ('len', 'length'))}, {r('mag', 'magnitude')}
  FROM pl JOIN ci ON ci.building = pl.building AND ci.id = pl.p.id""", "buildings", extra=PLACED_SQL))
def _(w):
    """Where the default 200 spikes and 200 waste events of every building come to lie."""
    test = w.split.filter("split = 'test'").drop("pos", "n_rows")
    pos = models.row_positions(test, B, "ts", w.rules.segment_days, "pos", "n_rows")
    return anomaly.place_events(anomaly.hashed_events(pos, B, C.is_low("occupancy", F.lit(1.0))), B)


def _excess(w):
    return experiment.excess_episodes(w.expected, B, rules=w.rules)


@query("n09_excess_episodes")
def _(w):
    """Episodes of model C on the real test rows, flagged one-sided."""
    return _excess(w)[1]


@query("n09_excess_by_building")
def _(w):
    return anomaly.episode_summary(_excess(w)[1])


@query("t03_worst_excess")
def _(w):
    return anomaly.worst_episodes(_excess(w)[1])


@query("n09_excess_bands")
def _(w):
    return anomaly.band_counts(_excess(w)[0], B)


# the same plan on the mean by hour and low occupancy, which SQL can follow
ONE_SIDED_SQL = LABEL_SQL[:LABEL_SQL.index("e0 AS (")] + """ur AS (SELECT building, ts, power_w - po AS residual_w FROM te),
um AS (SELECT building, quantile_cont(residual_w, 0.5) AS med, stddev_samp(residual_w) AS sd FROM ur GROUP BY 1),
ua AS (SELECT building, quantile_cont(abs(residual_w - med), 0.5) AS mad FROM ur JOIN um USING (building) GROUP BY 1),
us AS (SELECT ur.*, (residual_w - med) / coalesce(nullif(14826e-4 * mad, 0), nullif(sd, 0)) AS z FROM ur JOIN um USING (building) JOIN ua USING (building)),
u0 AS (SELECT *, row_number() OVER (PARTITION BY building ORDER BY ts) AS p FROM us),
u1 AS (SELECT *, coalesce(p - lag(p) OVER (PARTITION BY building ORDER BY p) > 3, true)::INT AS brk FROM u0 WHERE z > 3),
u2 AS (SELECT *, sum(brk) OVER (PARTITION BY building ORDER BY p) AS g FROM u1)"""


@query("n09_one_sided_episodes", sql(f"""SELECT building, {t('min(ts)', 'start')}, {t('max(ts)', chr(34) + 'end' + chr(34))}, {i('count(*)', 'intervals')}, {rs(
    ('count(*) / 6e0', 'flagged_hours'), ('(epoch(max(ts)) - epoch(min(ts))) / 36e2 + 1e0 / 6e0', 'span_hours'), ('max(abs(z))', 'peak_z'),
    ('avg(residual_w) / 1e3', 'mean_excess_kw'), ('sum(residual_w) / 1e3 * (10e0 / 60e0)', 'total_excess_kwh'))} FROM u2 GROUP BY building, g""",
    "buildings", extra=ONE_SIDED_SQL))
def _(w):
    rows = w.hourly_means.select("building", "ts", "power_w", F.col("po").alias("predicted_w"), F.lit("C").alias("model"), F.lit("test").alias("split"))
    return experiment.excess_episodes(rows, B, rules=w.rules)[1]


RECORD_ROWS = TIME_ROWS + ", lt AS (SELECT building, 25e-2 * quantile_cont(occupancy, 0.95) AS low FROM buildings WHERE usable GROUP BY 1)"


@query("n10_scored_record", fitted_sql(f"""SELECT building, {t('ts')}, split, {rs('power_w', 'occupancy', 'temp_c', 'cdh', 'expected_w', 'expected_time_only_w', 'residual_w', 'z')},
    CASE WHEN z < 0 THEN 'NORMAL' WHEN abs(z) >= 3 THEN 'ANOMALY' WHEN abs(z) >= 2 THEN 'WARNING' ELSE 'NORMAL' END AS band, coalesce(occupancy <= low, false) AS low_occupancy
  FROM (SELECT rec.*, low, (residual_w - med) / CASE WHEN mad > 0 THEN 14826e-4 * mad ELSE 1 END AS z FROM rec JOIN rm USING (building) JOIN ra USING (building) JOIN lt USING (building))""",
  RECORD_ROWS, models.TIME_MODELS, """, rec AS (SELECT sp.building, sp.ts, sp.split, sp.power_w, sp.occupancy, sp.temp_c, sp.cdh, c.p + cb.bias AS expected_w, b.p + bb.bias AS expected_time_only_w,
      sp.power_w - c.p - cb.bias AS residual_w FROM sp JOIN lin c ON c.g = sp.building AND c.ts = sp.ts AND c.model = 'C' JOIN lin b ON b.g = sp.building AND b.ts = sp.ts AND b.model = 'B'
      JOIN bias_lin cb ON cb.g = c.g AND cb.model = 'C' JOIN bias_lin bb ON bb.g = b.g AND bb.model = 'B'),
    rm AS (SELECT building, quantile_cont(residual_w, 0.5) AS med FROM rec WHERE split = 'test' GROUP BY 1),
    ra AS (SELECT building, quantile_cont(abs(residual_w - med), 0.5) AS mad FROM rec JOIN rm USING (building) WHERE split = 'test' GROUP BY 1)"""))
def _(w):
    return experiment.scored_record(w.split, w.buildings, fraction=0.25, rules=w.rules)


@query("n11_weather_detectors")
def _(w):
    return experiment.weather_detectors(w.split, C.is_low("occupancy", F.lit(1.0)), rules=w.rules)


# ------------------------------------------------------------------------ days
DENSE_SQL = """bm AS (SELECT building, ts, power_w FROM blocks JOIN registry USING (meter) WHERE role = 'mains'),
dense AS (SELECT b.building, b.ts, coalesce(power_w, m) AS power_w FROM bm b JOIN (
    SELECT building, hour(ts) AS h, avg(power_w) AS m FROM bm GROUP BY 1, 2) a ON a.building = b.building AND hour(b.ts) = a.h),
whole AS (SELECT building, ts::DATE AS date FROM dense GROUP BY 1, 2 HAVING count(*) = 144),
hd AS (SELECT building, ts::DATE AS date, hour(ts)::BIGINT AS hour, avg(power_w) AS w FROM dense SEMI JOIN whole
    ON whole.building = dense.building AND whole.date = dense.ts::DATE GROUP BY 1, 2, 3)"""
DENSE = ("blocks", "registry")


@query("v01_day_rows", sql(f"""SELECT building, {d('x.date', 'date')}, {i('count(power_w)', 'have')}, {rs(('avg(power_w) FILTER (WHERE hour(ts) < 6)', 'night_w'),
    ('avg(power_w) FILTER (WHERE hour(ts) BETWEEN 10 AND 13)', 'midday_w'))}, bool_and(power_w IS NOT NULL) AS complete
  FROM (SELECT *, ts::DATE AS date FROM dense) x GROUP BY building, x.date HAVING count(*) = 144""", *DENSE, extra=DENSE_SQL))
def _(w):
    rows = days.night_and_midday(days.day_rows(w.dense))
    return rows.select("building", "date", F.size(F.array_compact("values")).alias("have"), "night_w", "midday_w", "complete")


@query("v01_building_days", sql(f"""SELECT building, {d('x.date', 'date')}, {i('count(power_w)', 'have')}, {r('avg(power_w)', 'mean_w')},
    bool_and(power_w IS NOT NULL) AND NOT bool_or(coalesce(meter_off, false)) AS complete
  FROM buildings x GROUP BY building, x.date HAVING count(*) = 144""", "buildings"))
def _(w):
    """Days of the building's own total as it is: missing power and dead meters make a day incomplete."""
    have = F.array_compact("values")
    mean = C.ratio(F.aggregate(have, F.lit(0.0), lambda s, x: s + x), F.size(have))
    return days.day_rows(w.buildings).select("building", "date", F.size(have).alias("have"), mean.alias("mean_w"), "complete")


@query("v02_hourly_days", sql(f"SELECT building, {d('date')}, hour, {r('w', 'w')} FROM hd", *DENSE, extra=DENSE_SQL))
def _(w):
    return w.hourly_days.select("building", "date", F.posexplode("hours").alias("hour", "w"))


@query("v03_standardised_days", sql(f"""SELECT building, {d('date')}, hour, {r("(w - avg(w) OVER p) / CASE WHEN stddev_samp(w) OVER p > 0 THEN stddev_samp(w) OVER p ELSE 1 END", 'z')}
  FROM hd WINDOW p AS (PARTITION BY building, hour)""", *DENSE, extra=DENSE_SQL))
def _(w):
    return days.standardise(w.hourly_days).select("building", "date", F.posexplode("z").alias("hour", "z"))


@query("v06_day_labels", sql(f"""SELECT building, {d('x.date', 'date')}, dayname(x.date) AS weekday, (isodow(x.date) - 1)::BIGINT AS day_of_week,
    isodow(x.date) >= 6 AS is_weekend, month(x.date)::BIGINT AS month, year(x.date)::BIGINT AS year, {VAC.format(d='x.date')} AS is_vacation,
    CASE WHEN {VAC.format(d='x.date')} THEN 'vacation' ELSE 'semester' END AS period FROM whole x""", *DENSE, extra=DENSE_SQL))
def _(w):
    return w.hourly_days.drop("hours", "complete")


def _components(w):
    return days.principal_components(days.standardise(w.hourly_days))


@query("v04_a45_scree")
def _(w):
    return days.scree(_components(w))


@query("v04_total_variance", sql(f"""SELECT building, {r('count(*) FILTER (WHERE s > 0)::DOUBLE', 'total_variance')}, {r('1e0', 'last_cumulative')}, {r('0e0', 'error_with_all')}
  FROM (SELECT building, hour, stddev_samp(w) AS s FROM hd GROUP BY 1, 2) GROUP BY 1""", *DENSE, extra=DENSE_SQL))
def _(w):
    """Eigenvalues add up to the hours that vary, and all components leave no error."""
    z = days.standardise(w.hourly_days)
    pc = days.principal_components(z)
    err = days.day_scores(z, pc, 24).groupBy("building").agg(F.round(F.max("reconstruction_error"), 5).alias("error_with_all"))
    return pc.groupBy("building").agg(F.sum("eigenvalue").alias("total_variance"), F.max("cumulative").alias("last_cumulative")).join(err, "building")


# sums of the eigenvalues' powers are the traces of the powers of the matrix, which SQL can form
@query("v04_a45_spectral_sums", sql(f"""
  SELECT building, {rs(('sum(s.m) FILTER (WHERE i = j)', 'first_power'), ('sum(s.m * s.m)', 'second_power'), ('sum(s.m * s.mm)', 'third_power'))}, true AS orthonormal, true AS eigenvectors
  FROM (SELECT a.building, a.i, a.j, any_value(a.m) AS m, sum(b.m * c.m) AS mm FROM cm a JOIN cm b ON b.building = a.building AND b.i = a.i
    JOIN cm c ON c.building = a.building AND c.i = b.j AND c.j = a.j GROUP BY 1, 2, 3) s GROUP BY 1""", *DENSE, extra=f"""{DENSE_SQL},
  zd AS (SELECT building, date, hour, (w - avg(w) OVER p) / CASE WHEN stddev_samp(w) OVER p > 0 THEN stddev_samp(w) OVER p ELSE 1 END AS z FROM hd WINDOW p AS (PARTITION BY building, hour)),
  cm AS (SELECT x.building, x.hour AS i, y.hour AS j, sum(x.z * y.z) / (count(*) - 1) AS m FROM zd x JOIN zd y ON x.building = y.building AND x.date = y.date GROUP BY 1, 2, 3)"""))
def _(w):
    """Eigenvalues by their power sums; loadings by P'P = I and by C v = lambda v."""
    z = days.standardise(w.hourly_days)
    pc = days.principal_components(z)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    sums = [F.sum(F.pow("eigenvalue", F.lit(p))).alias(n) for p, n in ((1, "first_power"), (2, "second_power"), (3, "third_power"))]
    other = pc.select(*B, F.col("component").alias("_c"), F.col("loadings").alias("_l"))
    unit = (F.col("component") == F.col("_c")).cast("double")
    ortho = pc.join(other, B).groupBy(*B).agg(F.bool_and(F.abs(dot("loadings", "_l") - unit) < 1e-9).alias("orthonormal"))
    # C v, summed over the days: z times the day's score
    scored = z.select(*B, "z").join(pc.select(*B, "component", "eigenvalue", "loadings"), B).withColumn("_s", dot("z", "loadings"))
    cv = scored.groupBy(*B, "component").agg(
        F.first("eigenvalue").alias("_e"), F.first("loadings").alias("_l"), F.count(F.lit(1)).alias("_n"), F.array(*[F.sum(F.get("z", h) * F.col("_s")) for h in range(days.HOURS)]).alias("_cv"))
    off = F.array_max(F.zip_with("_cv", "_l", lambda a, b: F.abs(a / (F.col("_n") - 1) - F.col("_e") * b)))
    good = cv.groupBy(*B).agg(F.bool_and(off < 1e-8).alias("eigenvectors"))
    return pc.groupBy(*B).agg(*sums).join(ortho, B).join(good, B)


@query("v05_aligned_halves", sql(f"""SELECT building, {i('24', 'components')}, true AS same_side, true AS only_signs FROM hd GROUP BY 1""", *DENSE, extra=DENSE_SQL))
def _(w):
    """Components of the even days turned to those of the odd ones: none points away, nothing but signs changes."""
    half = lambda odd: days.principal_components(days.standardise(w.hourly_days.filter(F.dayofmonth("date") % 2 == odd)))
    a, b = half(0), half(1)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    d = (days.align_signs(a, b).join(a.select(*B, "component", F.col("loadings").alias("_a")), [*B, "component"])
         .join(b.select(*B, "component", F.col("loadings").alias("_b")), [*B, "component"]))
    turned = F.transform("_a", lambda x: -x)
    return d.groupBy(*B).agg(F.count(F.lit(1)).alias("components"), F.bool_and(dot("loadings", "_b") >= 0).alias("same_side"),
                             F.bool_and((F.col("loadings") == F.col("_a")) | (F.col("loadings") == turned)).alias("only_signs"))


@query("v09_error_is_the_rest", sql(f"""SELECT building, {i('count(DISTINCT date)', 'days')}, true AS as_left_over, true AS below_all FROM hd GROUP BY 1""", *DENSE, extra=DENSE_SQL))
def _(w):
    """The squared errors from three components add up to the eigenvalues left over, and no day's
    error exceeds that of leaving all components out."""
    z = days.standardise(w.hourly_days)
    pc = days.principal_components(z)
    rest = pc.filter("component > 3").groupBy(*B).agg(F.sum("eigenvalue").alias("_rest"))
    e, whole = F.col("reconstruction_error"), F.aggregate("z", F.lit(0.0), lambda s, x: s + x * x)
    d = days.day_scores(z, pc).groupBy(*B).agg(F.count(F.lit(1)).alias("days"), F.sum(e * e * days.HOURS).alias("_sum"),
                                               F.bool_and(e * e * days.HOURS <= whole + 1e-9).alias("below_all"))
    left_over = F.abs(F.col("_sum") / (F.col("days") - 1) - F.col("_rest")) < 1e-8
    return d.join(rest, B).select(*B, "days", left_over.alias("as_left_over"), "below_all")


@query("v05_a45_loading_summary")
def _(w):
    return days.loading_summary(_components(w))


def _day_scores(w):
    return w.day_scores


@query("v09_reconstruction_error")
def _(w):
    return days.unusual_days(_day_scores(w)).select("building", "date", "weekday", "period", "reconstruction_error")


@query("v09_error_threshold")
def _(w):
    return days.error_threshold(_day_scores(w))


@query("h02_component_scores_by_weekend")
def _(w):
    return stats.compare_groups(w.day_scores, B, "pc1", ~F.col("is_weekend"), p_values=True)


@query("v07_v08_day_types")
def _(w):
    """Day types of every building on its own components."""
    return days.day_type_summary(days.day_types(w.day_scores))


# what holds of any result: every day is nearest to its own centre, and every centre is its days' mean
@query("v07_fixed_point", sql(f"""SELECT building, {i('count(DISTINCT date)', 'days')}, {i('4', 'clusters')}, true AS nearest_is_own, true AS centre_is_mean
  FROM hd GROUP BY 1""", *DENSE, extra=DENSE_SQL))
def _(w):
    pcs = ["pc1", "pc2", "pc3"]
    own, centres = clusters.k_means(w.day_scores, B, pcs, "date")
    mine = centres.select(*B, "cluster", "centre")
    every = centres.groupBy(*B).agg(F.sort_array(F.collect_list(F.struct("cluster", "centre")))["centre"].alias("_centres"))
    d = own.join(every, B).withColumn("_f", F.array(*pcs)).withColumn("_d", clusters.distances())
    gap = F.get("_d", F.col("cluster")) - F.array_min("_d")
    means = d.groupBy(*B, "cluster").agg(F.count(F.lit(1)).alias("n"), F.max(gap).alias("gap"), F.array(*map(F.avg, pcs)).alias("mean")).join(mine, [*B, "cluster"])
    off = F.array_max(F.zip_with("mean", "centre", lambda a, b: F.abs(a - b)))
    return means.groupBy(*B).agg(F.sum("n").alias("days"), F.count(F.lit(1)).alias("clusters"), F.bool_and(F.col("gap") < 1e-9).alias("nearest_is_own"),
                                 F.bool_and(off < 1e-9).alias("centre_is_mean"))


@query("v10_mean_day_shape", sql(f"""SELECT building, {i('days')}, hour, {rs(('m', 'mean_w'), ('m / avg(m) OVER (PARTITION BY building)', 'relative'))}, NULL::VARCHAR AS reason
  FROM (SELECT building, hour, avg(w) AS m, count(*) AS days FROM hd GROUP BY 1, 2 HAVING count(*) >= 20)
  UNION ALL SELECT building, {i('count(*)', 'days')}, NULL, NULL, NULL, 'fewer than 20 complete days' FROM hd WHERE hour = 0 GROUP BY 1 HAVING count(*) < 20""", *DENSE, extra=DENSE_SQL))
def _(w):
    return days.mean_day_shape(w.hourly_days, min_days=20)


@query("v10_complete_days", sql(f"""SELECT building, {is_(('count(*) FILTER (WHERE c)', 'complete_days'), ('count(*)', 'days'))}
  FROM (SELECT building, ts::DATE AS dd, count(power_w) = 144 AS c FROM bm GROUP BY 1, 2 HAVING count(*) = 144) GROUP BY 1""", *DENSE, extra=DENSE_SQL))
def _(w):
    b = w.blocks.join(w.registry.filter("role = 'mains'"), "meter")
    return days.complete_days(days.day_rows(b))
