"""Expected-power models, fitted for all buildings at once.

The time features are categorical, so the rows of a fit are first summed into cells
(hour x weekday x month x flags): counts, sums, squares and cross products. The normal
equations need nothing else. A cell table has at most a few thousand rows per building
whatever the size of the data; the small solve runs on it in one Arrow group per building,
and predictions are plain column expressions over the joined coefficients.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltloom.config import DEFAULT_RULES, Rules, WEEKDAYS
from voltloom.functions.columns import ratio
from voltloom.functions.tails import f_pvalue
from voltloom.operators import forest
from voltloom.operators.ordered import row_positions
from voltloom.operators.ranks import quantiles
from voltloom.session import stage

BINARIES = ("is_weekend", "is_semester", "is_working_day")
CELL_KEYS = ("hour", "weekday", "month", *BINARIES)
WEATHER = ("temp_c", "cdh")
TIME_MODELS = {"B": (), "C": ("occupancy",)}
WEATHER_MODELS = {"B_w": (), "C_w": ("occupancy",), "E": WEATHER, "F": ("occupancy", *WEATHER)}
MIN_ROWS, MIN_WEATHER_ROWS = 2000, 500


# ------------------------------------------------------------------- samples
def usable_frame(df: DataFrame, target: str = "power_w") -> DataFrame:
    """Rows a model may learn from; weather rides along and is never required."""
    need = [target, "occupancy", *CELL_KEYS]
    extra = [c for c in WEATHER if c in df.columns]
    return (df.filter("usable").dropna(subset=need)
            .select("building", "ts", *need, *extra))


def with_split(frame: DataFrame, keys, ts: str = "ts", rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Chronological split: the first 70 %, the next 15 %, the rest, by row position.

    Sizes are floored products of the same floating-point shares the published numbers
    rest on (0.15 / (1 - 0.7) is a little less than a half).
    """
    d = row_positions(frame, list(keys), ts, rules.segment_days, "pos", "n_rows")
    n_train = F.floor(F.lit(rules.train_share) * F.col("n_rows"))
    n_val = F.floor(F.lit(rules.val_share / (1 - rules.train_share)) * (F.col("n_rows") - n_train))
    return d.withColumn("split", F.when(F.col("pos") < n_train, "train")
                        .when(F.col("pos") < n_train + n_val, "validation").otherwise("test"))


def split_summary(split: DataFrame, keys, target: str = "power_w", ts: str = "ts") -> DataFrame:
    keys = list(keys)
    return split.groupBy(*keys, "split").agg(
        F.count(F.lit(1)).alias("intervals"), (100.0 * F.count(F.lit(1)) / F.first("n_rows")).alias("share_pct"),
        F.min(ts).alias("first"), F.max(ts).alias("last"), F.avg(target).alias("mean_power_w"))


def with_folds(train: DataFrame, keys, ts: str = "ts", rules: Rules = DEFAULT_RULES) -> DataFrame:
    """`fold` k in 1..K is the k-th test block; it is trained on every earlier row. 0 is
    the stretch before the first test block."""
    k = rules.cv_folds
    d = row_positions(train, list(keys), ts, rules.segment_days, "pos", "n_rows")
    size = F.floor(F.col("n_rows") / (k + 1))
    into = F.col("pos") - (F.col("n_rows") - size * k)
    return d.withColumn("fold", F.when((into < 0) | (size == 0), F.lit(0)).otherwise(F.floor(ratio(into, size)) + 1).cast("int"))


# ------------------------------------------------------------------- model A
def fit_model_a(df: DataFrame, keys, target: str = "power_w", x: str = "occupancy") -> DataFrame:
    """power = a + b * occupancy: base load, watts per occupant, in-sample R2."""
    return df.groupBy(*keys).agg(
        F.regr_count(target, x).alias("n"), F.regr_intercept(target, x).alias("a_base_load_w"),
        F.regr_slope(target, x).alias("b_watts_per_occupant"), F.regr_r2(target, x).alias("r2_in_sample"),
        F.avg(target).alias("mean_power_w"))


def usable_rows(table: DataFrame, keys) -> DataFrame:
    """How many rows of each key a model may learn from, keys without any included."""
    known = F.col("usable")
    for c in ("power_w", "occupancy", *CELL_KEYS):
        known = known & F.col(c).isNotNull()
    return table.groupBy(*keys).agg(F.count_if(known).alias("usable_rows"))


def every_key(result: DataFrame, sizes: DataFrame, keys, min_rows: int, of: str = "usable_rows") -> DataFrame:
    """The result's rows, and one row of NULLs with a reason for each key that has under `min_rows`."""
    return sizes.join(result, list(keys), "left").withColumn(
        "reason", F.when(F.col(of) < min_rows, F.lit(f"fewer than {min_rows} {of.replace('_', ' ')}")))


def train_rows(table: DataFrame, keys=("building",), min_rows: int = MIN_ROWS,
               rules: Rules = DEFAULT_RULES) -> DataFrame:
    """The training stretch of every key with enough usable rows."""
    split = with_split(large_enough(usable_frame(table), keys, min_rows), keys, rules=rules)
    return split.filter("split = 'train'")


def model_a(table: DataFrame, keys=("building",), min_rows: int = MIN_ROWS, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Model A of every key; a key with too few usable rows has NULLs and a reason."""
    return every_key(model_a_table(train_rows(table, keys, min_rows, rules), keys), usable_rows(table, keys), keys, min_rows)


def model_a_table(train: DataFrame, keys=("building",)) -> DataFrame:
    """Model A's coefficients with the training stretch's mean and night-time median."""
    keys = list(keys)
    night = quantiles(train.filter(F.col("hour").between(2, 5)), keys, "power_w", {"night_median_w": 0.5})
    fit = fit_model_a(train, keys).join(night, keys, "left")
    return fit.withColumn("base_load_pct_of_mean", 100 * ratio(F.col("a_base_load_w"), F.col("mean_power_w")))


# -------------------------------------------------------------- linear models
def cells(rows: DataFrame, keys, numeric, target: str = "power_w", factors: bool = True,
          extra=()) -> DataFrame:
    """Sufficient statistics per categorical cell."""
    y = F.col(target)
    aggs = [F.count(F.lit(1)).cast("double").alias("n"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy")]
    for a, x in enumerate(numeric):
        aggs += [F.sum(x).alias(f"sx{a}"), F.sum(F.col(x) * y).alias(f"sxy{a}")]
        aggs += [F.sum(F.col(x) * F.col(numeric[b])).alias(f"sxx{a}_{b}") for b in range(a + 1)]
    return rows.groupBy(*keys, *extra, *(CELL_KEYS if factors else ())).agg(*aggs)


def _solve(c: pd.DataFrame, numeric: tuple, use: tuple, factors: bool) -> dict:
    """Least squares from cells: dummies of the levels seen, first level dropped; the
    minimum-norm solution where columns are collinear."""
    levels, blocks = [], []
    if factors:
        for f in ("hour", "weekday", "month"):
            seen = sorted(c[f].unique())[1:]
            levels += [(f, v) for v in seen]
            blocks += [(c[f] == v).to_numpy(float) for v in seen]
        levels += [(b, None) for b in BINARIES]
        blocks += [c[b].to_numpy(float) for b in BINARIES]
    z = np.column_stack(blocks) if blocks else np.zeros((len(c), 0))
    at = [numeric.index(u) for u in use]
    n, sy = c["n"].to_numpy(float), c["sy"].to_numpy(float)
    sx = c[[f"sx{a}" for a in at]].to_numpy(float).reshape(len(c), len(at))
    total = n.sum()
    sums = np.concatenate([n @ z, sx.sum(0)])
    gram = np.zeros((sums.size, sums.size))
    q = z.shape[1]
    gram[:q, :q] = z.T @ (z * n[:, None])
    gram[:q, q:] = z.T @ sx
    gram[q:, :q] = gram[:q, q:].T
    for i, a in enumerate(at):
        for j, b in enumerate(at):
            gram[q + i, q + j] = c[f"sxx{max(a, b)}_{min(a, b)}"].sum()
    xy = np.concatenate([z.T @ sy, [c[f"sxy{a}"].sum() for a in at]])
    mean, ybar = sums / total, sy.sum() / total
    gram = gram / total - np.outer(mean, mean)
    xy = xy / total - mean * ybar
    scale = np.ones(sums.size)
    scale[q:] = np.sqrt(np.maximum(np.diag(gram)[q:], 0))
    scale[scale == 0] = 1.0
    w = np.linalg.pinv(gram / np.outer(scale, scale), rcond=1e-11, hermitian=True) @ (xy / scale) / scale
    out = {"intercept": float(ybar - mean @ w), "hour_c": [0.0] * 24, "weekday_c": [0.0] * 7,
           "month_c": [0.0] * 12, "n_fit": int(total)}
    out.update({f"{b}_c": 0.0 for b in BINARIES})
    for (f, v), coef in zip(levels, w):
        if f == "hour":
            out["hour_c"][int(v)] = float(coef)
        elif f == "weekday":
            out["weekday_c"][WEEKDAYS.index(v)] = float(coef)
        elif f == "month":
            out["month_c"][int(v) - 1] = float(coef)
        else:
            out[f"{f}_c"] = float(coef)
    for x in numeric:
        out[f"{x}_c"] = float(w[q + use.index(x)]) if x in use else 0.0
    return out


def _schema(df: DataFrame, keys, numeric, fold: bool) -> str:
    kinds = dict(df.dtypes)
    parts = [f"`{k}` {kinds[k]}" for k in keys] + ["model string"] + (["fold int"] if fold else [])
    parts += ["intercept double", "hour_c array<double>", "weekday_c array<double>", "month_c array<double>",
              "n_fit bigint", *[f"{b}_c double" for b in BINARIES], *[f"{x}_c double" for x in numeric]]
    return ", ".join(parts)


def fit_linear(train: DataFrame, keys, models: dict = TIME_MODELS, target: str = "power_w",
               factors: bool = True, folds: int = 0) -> DataFrame:
    """Coefficients, one row per key and model (and fold).

    With `folds` the input carries a `fold` column and fold k is fitted on folds < k.
    """
    keys = list(keys)
    numeric = tuple(dict.fromkeys(x for xs in models.values() for x in xs))
    c = cells(train, keys, numeric, target, factors, ["fold"] if folds else [])
    schema = _schema(train, keys, numeric, bool(folds))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for k in range(1, folds + 1) if folds else (None,):
            part = pdf if k is None else pdf[pdf["fold"] < k]
            if not len(part):
                continue
            for name, use in models.items():
                row = {key: pdf[key].iloc[0] for key in keys}
                row["model"] = name
                if k is not None:
                    row["fold"] = k
                rows.append({**row, **_solve(part, numeric, tuple(use), factors)})
        names = [p.strip().split(" ")[0].strip("`") for p in schema.split(", ")]
        return pd.DataFrame(rows, columns=names)

    return c.groupBy(*keys).applyInPandas(solve, schema)


def prediction(df_columns, numeric, factors: bool = True) -> Column:
    """The linear predictor as a column expression over joined coefficients."""
    p = F.col("intercept")
    if factors:
        day = F.array_position(F.array(*[F.lit(d) for d in WEEKDAYS]), F.col("weekday")).cast("int")
        p = (p + F.get("hour_c", F.col("hour").cast("int")) + F.get("weekday_c", day - 1)
             + F.get("month_c", F.col("month").cast("int") - 1))
        for b in BINARIES:
            p = p + F.col(f"{b}_c") * F.col(b).cast("double")
    for x in numeric:
        p = p + F.when(F.col(f"{x}_c") != 0, F.col(f"{x}_c") * F.col(x)).otherwise(0.0)
    return p


def predict(rows: DataFrame, coefs: DataFrame, keys, factors: bool = True, on=()) -> DataFrame:
    """Long form: one row per input row and model, with `predicted_w`.

    The coefficients are one row per key and model, so the engine may broadcast them
    after looking at their size, and splits a hot key otherwise.
    """
    numeric = [c[:-2] for c in coefs.columns if c.endswith("_c")
               and c[:-2] not in ("hour", "weekday", "month", *BINARIES)]
    drop = [c for c in coefs.columns if c.endswith("_c") or c in ("intercept", "n_fit")]
    return (rows.join(coefs, [*keys, *on])
            .withColumn("predicted_w", prediction(rows.columns, numeric, factors)).drop(*drop))


# --------------------------------------------------------------------- scores
def metric_columns(y: str | Column = "power_w", p: str | Column = "predicted_w") -> list[Column]:
    y = F.col(y) if isinstance(y, str) else y
    p = F.col(p) if isinstance(p, str) else p
    e = y - p
    return [F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae_w"), F.sqrt(F.avg(e * e)).alias("rmse_w"),
            (1 - ratio(F.sum(e * e), F.regr_syy(y, y))).alias("r2"),
            (100 * F.avg(F.abs(ratio(e, y)))).alias("mape_pct")]


def score(predicted: DataFrame, keys, target: str = "power_w") -> DataFrame:
    """MAE, RMSE, R2 and MAPE (zeros left out) per key, model and split."""
    return predicted.groupBy(*keys, "model", "split").agg(*metric_columns(target))


def validation_bias(predicted: DataFrame, keys, target: str = "power_w") -> DataFrame:
    val = predicted.filter("split = 'validation'")
    return val.groupBy(*keys, "model").agg(F.avg(F.col(target) - F.col("predicted_w")).alias("val_bias_w"))


def with_bias(predicted: DataFrame, keys, target: str = "power_w") -> DataFrame:
    """Add the mean validation error to every prediction and form the residual."""
    b = validation_bias(predicted, keys, target)
    return (predicted.join(b, [*keys, "model"])
            .withColumn("predicted_w", F.col("predicted_w") + F.col("val_bias_w"))
            .withColumn("residual_w", F.col(target) - F.col("predicted_w")))


def score_with_correction(predicted: DataFrame, keys, target: str = "power_w") -> DataFrame:
    """Scores per split, and the test split again after the validation-bias correction."""
    fixed = (with_bias(predicted.filter("split <> 'train'"), keys, target).filter("split = 'test'")
             .withColumn("split", F.lit("test_corrected")))
    return score(predicted, keys, target).unionByName(score(fixed, keys, target))


def fit_and_score(split: DataFrame, keys, models: dict = TIME_MODELS, target: str = "power_w",
                  factors: bool = True) -> DataFrame:
    coefs = fit_linear(split.filter("split = 'train'"), keys, models, target, factors)
    return score_with_correction(predict(split, coefs, keys, factors), keys, target)


def large_enough(frame: DataFrame, keys, min_rows: int = MIN_ROWS) -> DataFrame:
    """Rows of the keys that have at least `min_rows` rows."""
    size = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_rows)
    return frame.join(size.select(*keys), list(keys), "left_semi")


def weather_sizes(split: DataFrame, keys) -> DataFrame:
    """Rows with weather in the smallest of each key's three splits."""
    known = F.col(WEATHER[0]).isNotNull() & F.col(WEATHER[1]).isNotNull()
    return split.groupBy(*keys).agg(F.least(*[F.count_if(known & (F.col("split") == s)) for s in ("train", "validation", "test")])
                                    .alias("weather_rows_in_a_split"))


def weather_rows(split: DataFrame, keys, min_rows: int = MIN_WEATHER_ROWS) -> DataFrame:
    """Rows with weather, of keys that have enough of them in every split."""
    enough = weather_sizes(split, keys).filter(F.col("weather_rows_in_a_split") >= min_rows)
    return split.dropna(subset=list(WEATHER)).join(enough.select(*keys), list(keys), "left_semi")


def weather_models(split: DataFrame, keys, min_rows: int = MIN_WEATHER_ROWS) -> DataFrame:
    """Scores of the weather models on weather rows; keys with too few of them have NULLs and a reason."""
    scores = fit_and_score(weather_rows(split, keys, min_rows), keys, WEATHER_MODELS)
    return every_key(scores, weather_sizes(split, keys), keys, min_rows, "weather_rows_in_a_split")


def weather_gains(scores: DataFrame, keys) -> DataFrame:
    """What weather and occupancy each add to validation R2, with and without the other."""
    at = lambda m: F.max(F.when((F.col("model") == m) & (F.col("split") == "validation"), F.col("r2")))
    reason = [F.first("reason").alias("reason")] if "reason" in scores.columns else []
    return scores.groupBy(*keys).agg(
        *reason, (at("E") - at("B_w")).alias("weather_gain_without_occupancy"),
        (at("F") - at("C_w")).alias("weather_gain_with_occupancy"),
        (at("C_w") - at("B_w")).alias("occupancy_gain_without_weather"),
        (at("F") - at("E")).alias("occupancy_gain_given_weather"))


def gain_summary(gains: DataFrame) -> DataFrame:
    """Mean gains over buildings and how much of the occupancy gain weather takes away."""
    a, b = F.avg("occupancy_gain_without_weather"), F.avg("occupancy_gain_given_weather")
    return gains.agg(a.alias("mean_gain_without_weather"), b.alias("mean_gain_given_weather"),
                     (100 * (1 - ratio(b, a))).alias("shrinkage_pct"))


def model_table(scores: DataFrame, keys) -> DataFrame:
    """One row per key and model, the splits side by side."""
    at = lambda s, c: F.max(F.when(F.col("split") == s, F.col(c)))
    return scores.groupBy(*keys, "model").agg(
        at("train", "r2").alias("train_r2"), at("validation", "r2").alias("val_r2"), at("test", "r2").alias("test_r2"),
        at("test_corrected", "r2").alias("test_corrected_r2"), at("validation", "mae_w").alias("val_mae_w"),
        at("test", "mae_w").alias("test_mae_w"), at("test", "rmse_w").alias("test_rmse_w"))


def occupancy_contribution(table: DataFrame, keys) -> DataFrame:
    """Model C against model B on the validation split."""
    at = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c)))
    b, c = at("B", "val_mae_w"), at("C", "val_mae_w")
    return table.groupBy(*keys).agg(
        at("B", "val_r2").alias("b_val_r2"), at("C", "val_r2").alias("c_val_r2"),
        (at("C", "val_r2") - at("B", "val_r2")).alias("r2_gain"), b.alias("b_val_mae_w"), c.alias("c_val_mae_w"),
        (100 * ratio(b - c, b)).alias("mae_improvement_pct"))


def cross_validate(train: DataFrame, keys, models: dict = TIME_MODELS, ts: str = "ts",
                   target: str = "power_w", rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Expanding-prefix folds: mean and population sd of the folds' MAE."""
    keys = list(keys)
    f = with_folds(train, keys, ts, rules)
    coefs = fit_linear(f, keys, models, target, folds=rules.cv_folds)
    p = predict(f.filter("fold > 0"), coefs, keys, on=["fold"])
    per = p.groupBy(*keys, "model", "fold").agg(F.avg(F.abs(F.col(target) - F.col("predicted_w"))).alias("mae"))
    return per.groupBy(*keys, "model").agg(
        F.count(F.lit(1)).alias("folds"), F.avg("mae").alias("cv_mae_mean_w"), F.stddev_pop("mae").alias("cv_mae_std_w"))


# --------------------------------------------------------- feature selection
def select_features(train: DataFrame, keys, k: int = 15, target: str = "power_w") -> DataFrame:
    """Univariate correlation and F score of every encoded column; top k marked.

    A dummy's correlation follows from the count and target sum of its level, so the
    encoded columns are never materialised: levels are unfolded from the cells.
    """
    keys = list(keys)
    c = cells(train, keys, ("occupancy",), target)
    total = c.groupBy(*keys).agg(F.sum("n").alias("N"), F.sum("sy").alias("Y"), F.sum("syy").alias("YY"))
    named = [F.struct(F.lit(f).alias("f"), F.col(f).cast("string").alias("level"), F.lit(1.0).alias("on"),
                      (F.col(f).cast("double") if f != "weekday" else F.lit(0.0)).alias("ord"))
             for f in ("hour", "weekday", "month")]
    named += [F.struct(F.lit(b).alias("f"), F.lit("").alias("level"), F.col(b).cast("double").alias("on"),
                       F.lit(0.0).alias("ord")) for b in BINARIES]
    lv = (c.withColumn("_l", F.explode(F.array(*named)))
          .groupBy(*keys, "_l.f", "_l.level", "_l.ord")
          .agg(F.sum(F.col("n") * F.col("_l.on")).alias("sx"), F.sum(F.col("sy") * F.col("_l.on")).alias("sxy")))
    first = F.row_number().over(Window.partitionBy(*keys, "f").orderBy("ord", "level"))
    lv = lv.withColumn("_r", first).filter((F.col("level") == "") | (F.col("_r") > 1)).withColumn("sxx", F.col("sx"))
    lv = lv.select(*keys, F.when(F.col("level") == "", F.col("f")).otherwise(F.concat_ws("_", "f", "level"))
                   .alias("feature"), "sx", "sxy", "sxx")
    occ = c.groupBy(*keys).agg(F.sum("sx0").alias("sx"), F.sum("sxy0").alias("sxy"), F.sum("sxx0_0").alias("sxx"))
    d = lv.unionByName(occ.withColumn("feature", F.lit("occupancy"))).join(total, keys)
    cov = F.col("sxy") - ratio(F.col("sx") * F.col("Y"), F.col("N"))
    vx = F.col("sxx") - ratio(F.col("sx") * F.col("sx"), F.col("N"))
    vy = F.col("YY") - ratio(F.col("Y") * F.col("Y"), F.col("N"))
    r = F.when((vx > 0) & (vy > 0), ratio(cov, F.sqrt(vx * vy))).otherwise(0.0)
    d = d.withColumn("correlation", r).withColumn("f_score", F.when(
        vx > 0, ratio(F.col("correlation") * F.col("correlation"), 1 - F.col("correlation") * F.col("correlation"))
        * (F.col("N") - 2)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.round("f_score", 9).desc_nulls_last(), "feature"))
    return d.withColumn("kept", rank <= k).select(*keys, "feature", "correlation", "f_score", "N", "kept")


def with_f_pvalue(features: DataFrame) -> DataFrame:
    return features.withColumn("p_value", f_pvalue(F.col("f_score"), F.lit(1.0), F.col("N") - 2))


# ------------------------------------------------------------ overfit curves
def _basis(steps: Column, z: Column) -> Column:
    """The orthogonal polynomials p_0, p_1, ... at z, newest last, by their three-term recurrence."""
    def step(s: Column, ab: Column) -> Column:
        nxt = (z - ab["a"]) * s["p"] - ab["b"] * s["q"]
        return F.struct(nxt.alias("p"), s["p"].alias("q"), F.concat(s["all"], F.array(nxt)).alias("all"))

    start = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("q"), F.array(F.lit(1.0)).alias("all"))
    return F.aggregate(steps, start, step, lambda s: s["all"])


def fit_polynomials(train: DataFrame, keys, max_degree: int = 10, x: str = "occupancy", target: str = "power_w") -> DataFrame:
    """Per key: mean and sd of x, the recurrence `steps` (a, b) and the coefficients of the basis.

    The basis is orthogonal over the training rows, so each degree adds one coefficient and leaves
    the others as they are; it takes one keyed aggregate, whatever the number of distinct x. A degree
    that the distinct x cannot tell from lower ones has the coefficient 0.
    """
    keys = list(keys)
    xd = F.col(x).cast("double")
    shape = train.groupBy(*keys).agg(F.avg(xd).alias("_mean"), F.stddev_pop(xd).alias("_sd"))
    fit = shape.select(*keys, "_mean", F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0).alias("_sd"),
                       F.array().cast("array<struct<a:double,b:double>>").alias("steps"), F.array().cast("array<double>").alias("coef"),
                       F.lit(None).cast("double").alias("_s"))
    points = stage(train.groupBy(*keys, xd.alias("_x")).agg(F.count(F.lit(1)).alias("_n"), F.sum(target).alias("_y")), "points")
    for degree in range(max_degree + 1):
        z = (F.col("_x") - F.col("_mean")) / F.col("_sd")
        d = points.join(fit, keys).withColumn("_z", z).withColumn("_p", F.element_at(_basis(F.col("steps"), F.col("_z")), -1))
        square = F.col("_n") * F.col("_p") * F.col("_p")
        sums = d.groupBy(*keys).agg(F.sum(square).alias("_now"), F.sum(square * F.col("_z")).alias("_zpp"), F.sum(F.col("_y") * F.col("_p")).alias("_yp"))
        told = (F.col("_now") > 1e-9 * F.coalesce("_s", F.lit(0.0))) & (F.coalesce("_s", F.lit(1.0)) > 0)
        ratio_of = lambda c: F.when(told, ratio(F.col(c), F.col("_now"))).otherwise(0.0)
        step = F.struct(ratio_of("_zpp").alias("a"), F.when(told & F.col("_s").isNotNull(), ratio(F.col("_now"), F.col("_s"))).otherwise(0.0).alias("b"))
        fit = stage(fit.join(sums, keys).select(*keys, "_mean", "_sd", F.concat("steps", F.array(step)).alias("steps"),
                                                F.concat("coef", F.array(ratio_of("_yp"))).alias("coef"),
                                                F.when(told, F.col("_now")).otherwise(0.0).alias("_s")), "polynomials")
    return fit.drop("_s")


def polynomial_curve(split: DataFrame, keys, max_degree: int = 10, target: str = "power_w") -> DataFrame:
    """Train and validation MAE of power ~ polynomial(occupancy), degree 1..max_degree."""
    keys = list(keys)
    fit = fit_polynomials(split.filter("split = 'train'"), keys, max_degree, target=target)
    d = split.filter("split <> 'test'").join(fit, keys).withColumn("_z", (F.col("occupancy").cast("double") - F.col("_mean")) / F.col("_sd"))
    terms = F.zip_with(_basis(F.col("steps"), F.col("_z")), "coef", lambda p, c: p * c)  # the basis is one longer, so its last term is null
    upto = F.aggregate(F.slice(terms, 1, max_degree + 1), F.array().cast("array<double>"), lambda s, t: F.concat(
        s, F.array(F.coalesce(F.get(s, F.size(s) - 1), F.lit(0.0)) + t)))
    d = d.select(*keys, "split", F.col(target).alias("_y"), F.posexplode(upto).alias("degree", "_p")).filter("degree > 0")
    at = lambda s: F.avg(F.when(F.col("split") == s, F.abs(F.col("_y") - F.col("_p"))))
    return d.groupBy(*keys, "degree").agg(at("train").alias("train_mae_w"), at("validation").alias("val_mae_w"))


def forest_scores(trees: DataFrame, split: DataFrame, keys, at: int = 0, target: str = "power_w") -> DataFrame:
    """Model D's scores by split, plain and corrected; `trees` as forest.grow() leaves them."""
    return score_with_correction(stage(forest.predictions(trees, split, keys, at, target), "forest_rows"), keys, target)


def lag_trap(table: DataFrame, keys=("building",), rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Validation scores of occupancy alone and of occupancy with power one hour ago."""
    rows = table.filter("usable").dropna(subset=["power_w", "occupancy", "power_lag_1h"]).select(
        *keys, "ts", "power_w", "occupancy", "power_lag_1h")
    split = with_split(rows, keys, rules=rules)
    models = {"occupancy": ("occupancy",), "occupancy + lag": ("occupancy", "power_lag_1h")}
    coefs = fit_linear(split.filter("split = 'train'"), keys, models, factors=False)
    return score(predict(split.filter("split = 'validation'"), coefs, keys, factors=False), keys)
