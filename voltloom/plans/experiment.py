"""The detection experiment: expectations, contamination, matched budgets, pooled answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltloom.config import DEFAULT_RULES, Rules
from voltloom.operators import anomaly, models, waste
from voltloom.operators.ordered import row_positions
from voltloom.session import stage

DETECTORS = {"B": "T", "C": "O"}
WEATHER_DETECTORS = {"B_w": "T", "E": "W", "F": "OW"}


def expected_power(split: DataFrame, keys, fitted: dict = models.TIME_MODELS) -> DataFrame:
    """Bias-corrected predictions on the rows after the training stretch, long by model."""
    coefs = models.fit_linear(split.filter("split = 'train'"), keys, fitted)
    return models.with_bias(models.predict(split.filter("split <> 'train'"), coefs, keys), keys)


def labelled_test(expected: DataFrame, keys, low: Column, names: dict = DETECTORS, n_spikes: int = 200,
                  n_waste: int = 200, seed: int = 42, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """The test rows with hash-drawn events, once per detector.

    Only power changes, so every detector keeps its predictions. `low` marks the rows waste
    may start on. The positions are staged: events are drawn from them and laid over them.
    """
    keys = list(keys)
    test = expected.filter("split = 'test'").drop("pos", "n_rows")
    one = test.filter(F.col("model") == next(iter(names))).withColumn("_low", low)
    pos = stage(row_positions(one.select(*keys, "ts", "power_w", "_low"), keys, "ts", rules.segment_days,
                              "pos", "n_rows"), "test_positions")
    events = anomaly.place_events(
        anomaly.hashed_events(pos, keys, F.col("_low"), n_spikes, n_waste, seed), keys, n_waste)
    d = anomaly.contaminate(pos, events, keys).drop("_low", "n_rows")
    labels = d.select(*keys, "ts", "pos", F.col("power_w").alias("_p"), "injected_extra_w", "is_anomaly",
                      "anomaly_type", "event_id")
    name = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return (test.join(labels, [*keys, "ts"]).withColumn("power_w", F.col("_p")).drop("_p", "residual_w")
            .withColumn("detector", name[F.col("model")]).filter(F.col("detector").isNotNull()).drop("model"))


def excess_episodes(expected: DataFrame, keys=("building",), model: str = "C",
                    rules: Rules = DEFAULT_RULES) -> tuple[DataFrame, DataFrame]:
    """The real test rows of one model, scored one-sided (z > 3) on their own scale, and the
    episodes the flagged rows form. Nothing is contaminated here.

    `expected` is what `expected_power` returns. The scored rows are staged, as the episodes
    and the rankings read them again.
    """
    keys = list(keys)
    test = expected.filter((F.col("split") == "test") & (F.col("model") == model)).drop("pos", "n_rows", "residual_w")
    scored = stage(anomaly.score_detector(test, keys, one_sided=True, rules=rules), "excess_scored")
    return scored, anomaly.episodes(scored, keys, rules=rules)


def with_low_threshold(rows: DataFrame, table: DataFrame, fraction: float | None = None,
                       rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Add each building's published (two-place) low-occupancy threshold."""
    t = waste.published_threshold(waste.low_occupancy_share(table, fraction=fraction, rules=rules))
    return rows.join(t.select("building", F.col("threshold").alias("low_threshold")), "building", "left")


def matched(scored: DataFrame, keys=("building",), rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Every detector's rows flagged within the same alert budget per building."""
    budget = anomaly.matched_budget(scored, list(keys))
    return anomaly.flag_top_n(scored, [*keys, "detector"], budget, rules=rules)


def rule_variants(two_sided: DataFrame, keys=("building",), rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Confusion scores under the two-sided, one-sided and IQR rule, from one scored table."""
    rules_ = F.array(F.struct(F.lit("two-sided").alias("rule"), F.col("flagged").alias("f")),
                     F.struct(F.lit("one-sided").alias("rule"), F.coalesce(F.col("z") > rules.z_anomaly, F.lit(False)).alias("f")),
                     F.struct(F.lit("iqr").alias("rule"), F.col("flagged_iqr").alias("f")))
    d = two_sided.select(*keys, "detector", "is_anomaly", F.explode(rules_).alias("_r")).select(
        *keys, "detector", "is_anomaly", F.col("_r.rule").alias("rule"), F.col("_r.f").alias("_f"))
    out = anomaly.confusion(d, [*keys, "detector", "rule"], "is_anomaly", "_f")
    return out.withColumn("alerts", F.col("true_positives") + F.col("false_positives"))


def pooled_answer(scored: DataFrame, keys=("building",), rules: Rules = DEFAULT_RULES) -> DataFrame:
    """The comparison of detectors T and O in one table, means over buildings.

    `scored` is read several times: pass a staged table.
    """
    by = [*keys, "detector"]
    top = matched(scored, keys, rules)
    rank = anomaly.ranking_scores(scored, by)
    typed = anomaly.evaluate_by_type(top, by, "flagged_top").filter("scope = 'waste'")
    hits = anomaly.event_recall(scored, by).filter("anomaly_type = 'waste'")
    lines = [
        ("fixed threshold", "mean F1", anomaly.confusion(scored, by), "f1"),
        ("matched alert budget", "mean F1", anomaly.confusion(top, by, flagged="flagged_top"), "f1"),
        ("threshold-free ranking", "mean average precision", rank, "average_precision"),
        ("threshold-free ranking", "mean ROC AUC", rank, "roc_auc"),
        ("waste only, matched budget", "mean F1", typed, "f1"),
        ("waste events noticed at all", "event recall", hits, "event_recall"),
    ]
    out = None
    for comparison, metric, table, value in lines:
        row = table.select("detector", F.col(value).alias("v"), F.lit(comparison).alias("comparison"),
                           F.lit(metric).alias("metric"))
        out = row if out is None else out.unionByName(row)
    return anomaly.mean_by_detector(out, ["comparison", "metric"], ["v"]).select(
        "comparison", "metric", F.col("v_T").alias("detector_t"), F.col("v_O").alias("detector_o"),
        F.col("v_difference").alias("difference"))


def scored_record(split: DataFrame, table: DataFrame, keys=("building",), fraction: float | None = None,
                  rules: Rules = DEFAULT_RULES) -> DataFrame:
    """The whole usable record scored for display: expectations of both models, z on the
    scale of the test residuals, low-occupancy flag, split. The record is staged before the
    scale is taken from its test rows."""
    keys = list(keys)
    coefs = models.fit_linear(split.filter("split = 'train'"), keys)
    bias = models.validation_bias(models.predict(split.filter("split = 'validation'"), coefs, keys), keys)
    fixed = coefs.join(bias, [*keys, "model"])
    d = split.select(*keys, "ts", "power_w", "occupancy", "split", *models.CELL_KEYS,
                     *[c for c in ("temp_c", "cdh") if c in split.columns])
    # one row of coefficients per key and model: the rows themselves are not dealt anew
    for model, name in (("C", "expected_w"), ("B", "expected_time_only_w")):
        d = models.predict(d, fixed.filter(F.col("model") == model).drop("model"), keys)
        d = d.withColumn(name, F.col("predicted_w") + F.col("val_bias_w")).drop("predicted_w", "val_bias_w")
    d = stage(d.drop(*models.CELL_KEYS).withColumn("residual_w", F.col("power_w") - F.col("expected_w")), "record")
    d = with_low_threshold(anomaly.apply_test_scale(d, keys, rules), table, fraction, rules)
    return d.withColumn("low_occupancy", F.coalesce(F.col("occupancy") <= F.col("low_threshold"), F.lit(False))).drop("low_threshold")


def weather_detectors(split: DataFrame, low: Column, keys=("building",), min_rows: int = models.MIN_WEATHER_ROWS,
                      rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Ranking quality of the detectors with time, weather and occupancy on weather rows; keys
    with too few of them have NULLs and a reason.

    Scoring reads the labelled rows several times, so they are staged.
    """
    keys = list(keys)
    fitted = {m: models.WEATHER_MODELS[m] for m in WEATHER_DETECTORS}
    expected = stage(expected_power(models.weather_rows(split, keys, min_rows), keys, fitted), "weather_expected")
    test = stage(labelled_test(expected, keys, low, WEATHER_DETECTORS, rules=rules), "weather_labelled")
    z = anomaly.score_detector(test, [*keys, "detector"], one_sided=True, rules=rules)
    return models.every_key(anomaly.ranking_scores(z, [*keys, "detector"]), models.weather_sizes(split, keys), keys, min_rows,
                            "weather_rows_in_a_split")
