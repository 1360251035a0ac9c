"""Residual scoring, labelled contamination, and how good a detector is at finding it."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltloom.config import BLOCKS_PER_HOUR, DEFAULT_RULES, Rules
from voltloom.functions.columns import band, kwh, ratio, wall_seconds
from voltloom.operators.ordered import SLICE, merge_runs, row_positions, up_to_here
from voltloom.operators.ranks import COUNT, quantiles, ranked_values
from voltloom.operators.runs import fences
from voltloom.session import stage

MAD_TO_SD = 1.4826
POSITIONS_PER_SLICE = 4096


# -------------------------------------------------------------------- scoring
def robust_scale(df: DataFrame, keys, residual: str = "residual_w",
                 also: dict[str, float] | None = None) -> DataFrame:
    """Median, MAD and scale per key; the sample sd stands in where the MAD is 0.

    A constant series has sd 0 too: its scale is NULL, and so are its scores. Further
    quantiles asked for in `also` come from the same pass as the median. The medians, one
    row per key, are staged, as the deviations are taken from them.
    """
    keys = list(keys)
    med = stage(quantiles(df, keys, residual, {"median": 0.5, **(also or {})}), "medians")
    dev = df.select(*keys, residual).join(med.select(*keys, "median"), keys).withColumn(
        "_d", F.abs(F.col(residual) - F.col("median")))
    mad = quantiles(dev, keys, "_d", {"mad": 0.5})
    sd = df.groupBy(*keys).agg(F.stddev_samp(residual).alias("_sd"))
    s = med.join(mad, keys).join(sd, keys)
    scale = F.when(F.col("mad") > 0, MAD_TO_SD * F.col("mad")).when(F.col("_sd") > 0, F.col("_sd"))
    return s.withColumn("scale", scale).drop("_sd")


def robust_zscore(df: DataFrame, keys, residual: str = "residual_w", name: str = "z") -> DataFrame:
    keys = list(keys)
    s = robust_scale(df, keys, residual).select(*keys, "median", "scale")
    return (df.join(s, keys, "left")
            .withColumn(name, ratio(F.col(residual) - F.col("median"), F.col("scale"))).drop("median", "scale"))


def iqr_flags(df: DataFrame, keys, residual: str = "residual_w", k: float = 1.5) -> DataFrame:
    """The cross-check: rows outside the Tukey fences of their key."""
    f = fences(df, list(keys), residual, k).select(*keys, "low_fence", "high_fence")
    r = F.col(residual)
    return df.join(f, list(keys), "left").withColumn("flagged_iqr", F.coalesce(
        (r < F.col("low_fence")) | (r > F.col("high_fence")), F.lit(False))).drop("low_fence", "high_fence")


def score_detector(df: DataFrame, keys, actual: str = "power_w", predicted: str = "predicted_w",
                   one_sided: bool = False, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Residual, z, band, flag and the Tukey cross-check per row.

    The band uses >= 3 on |z|, the one-sided flag z > 3, as published. Quartiles and
    median come from one pass, and one small table is joined back.
    """
    keys = list(keys)
    d = df.withColumn("residual_w", F.col(actual) - F.col(predicted))
    s = robust_scale(d, keys, also={"_q1": 0.25, "_q3": 0.75}).select(*keys, "median", "scale", "_q1", "_q3")
    r, reach = F.col("residual_w"), rules.outlier_iqr_k * (F.col("_q3") - F.col("_q1"))
    z = ratio(r - F.col("median"), F.col("scale"))
    hit = z > rules.z_anomaly if one_sided else F.abs(z) >= rules.z_anomaly
    return (d.join(s, keys, "left").withColumns({
        "z": z, "band": band(z, rules), "flagged": F.coalesce(hit, F.lit(False)),
        "flagged_iqr": F.coalesce((r < F.col("_q1") - reach) | (r > F.col("_q3") + reach), F.lit(False)),
    }).drop("median", "scale", "_q1", "_q3"))


def band_counts(scored: DataFrame, keys) -> DataFrame:
    b = F.col("band")
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("intervals"), F.count_if(b == "NORMAL").alias("normal"),
        F.count_if(b == "WARNING").alias("warning"), F.count_if(b == "ANOMALY").alias("anomaly"),
        (100 * F.avg(F.col("flagged").cast("double"))).alias("pct_flagged"))


def residual_summary(scored: DataFrame, keys) -> DataFrame:
    keys = list(keys)
    a = scored.groupBy(*keys).agg(F.avg("residual_w").alias("mean_w"), F.stddev_samp("residual_w").alias("sd_w"))
    return a.join(quantiles(scored, keys, "residual_w", {"median_w": 0.5}), keys)


def apply_test_scale(rows: DataFrame, keys, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Score a whole record with the median and MAD of its **test** residuals only.

    A scale of 0 counts as 1, and negative scores are NORMAL: only excess is of interest.
    """
    keys = list(keys)
    test = rows.filter("split = 'test'")
    s = robust_scale(test, keys).select(*keys, "median", F.col("mad").alias("_mad"))
    scale = F.when(F.col("_mad") > 0, MAD_TO_SD * F.col("_mad")).otherwise(1.0)
    return (rows.join(s, keys).withColumn("z", (F.col("residual_w") - F.col("median")) / scale)
            .withColumn("band", F.when(F.col("z") < 0, "NORMAL").otherwise(band("z", rules)))
            .drop("median", "_mad"))


# -------------------------------------------------------------- contamination
def hashed_events(test: DataFrame, keys, low: Column, n_spikes: int = 200, n_waste: int = 200,
                  seed: int = 42, attempts: int = 50) -> DataFrame:
    """Candidate events drawn by hash: per key the n_spikes lowest hashes, and of waste the
    attempts * n_waste lowest. Ids follow the hashes, spikes first.

    `test` carries `pos` and `n_rows`. Spikes (10-30 min, +50-100 %) start anywhere, waste
    (2-6 h, +15-30 %) on rows where `low` is true. Every event fits in the data. The hash is
    60 bits of an MD5. A cutoff from counts per hash range leaves hardly more rows than are
    wanted before they are put in order.
    """
    keys = list(keys)
    text = lambda what: F.concat_ws("|", F.lit(str(seed)), F.lit(what), *[F.col(k).cast("string") for k in keys], F.col("pos").cast("string"))
    h = lambda what: F.conv(F.substring(F.md5(text(what)), 1, 15), 16, 10).cast("bigint")
    unit = lambda what: F.pmod(h(what), F.lit(1_000_003)) / 1_000_003.0
    kinds = F.array(
        F.struct(F.lit("spike").alias("type"), F.lit(True).alias("ok"), h("spike").alias("h"),
                 F.floor((10 + F.pmod(h("spike-minutes"), F.lit(21))) / 10).cast("int").alias("length"),
                 (0.5 + 0.5 * unit("spike-size")).alias("magnitude")),
        F.struct(F.lit("waste").alias("type"), F.coalesce(low, F.lit(False)).alias("ok"), h("waste").alias("h"),
                 F.floor((2 + 4 * unit("waste-hours")) * BLOCKS_PER_HOUR).cast("int").alias("length"),
                 (0.15 + 0.15 * unit("waste-size")).alias("magnitude")))
    c = (test.select(*keys, "pos", "n_rows", F.explode(kinds).alias("e")).select(*keys, "pos", "n_rows", "e.*")
         .filter(F.col("ok") & (F.col("pos") + F.col("length") <= F.col("n_rows"))))
    by, limit = [*keys, "type"], F.when(F.col("type") == "spike", n_spikes).otherwise(attempts * n_waste)
    c = c.withColumn("_range", F.shiftright("h", 44))
    counts = c.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(up_to_here(Window.partitionBy(*by).orderBy("_range")))
    cut = (counts.withColumn("_before", upto - F.col("_n")).filter(F.col("_before") < limit)
           .groupBy(*by).agg(F.max("_range").alias("_last")))
    order = F.row_number().over(Window.partitionBy(*by).orderBy("h", "pos"))
    top = (c.join(cut, by).filter(F.col("_range") <= F.col("_last"))
           .withColumn("_r", order).filter(F.col("_r") <= limit))
    return top.select(*keys, F.when(F.col("type") == "spike", F.col("_r")).otherwise(F.col("_r") + n_spikes)
                      .cast("bigint").alias("event_id"), "type", F.col("pos").alias("start_pos"), "length", "magnitude")


def place_events(candidates: DataFrame, keys, n_waste: int = 200) -> DataFrame:
    """Candidates by id, each placed if it touches none placed before it; of waste events the
    first `n_waste` that find a place.

    A group is the candidates of one key, whose number the draw bounds (200 + 50 * 200 by
    default) whatever the number of rows. Spikes that collide are not drawn again. Where the
    candidates run out, fewer waste events are placed; `injection_summary` counts them.
    """
    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("event_id", ignore_index=True)
        begins, ends, rows, left = [], [], [], n_waste
        for row, (kind, a, n) in enumerate(zip(pdf["type"], pdf["start_pos"], pdf["length"], strict=True)):
            at = bisect_left(begins, a)
            if (kind == "waste" and not left) or (at and ends[at - 1] > a) or (at < len(begins) and begins[at] < a + n):
                continue
            begins.insert(at, a)
            ends.insert(at, a + n)
            rows.append(row)
            left -= kind == "waste"
        return pdf.iloc[rows]

    return candidates.groupBy(*keys).applyInPandas(place, candidates.schema)


def _event_rows(events: DataFrame) -> DataFrame:
    return events.withColumn("pos", F.explode(F.sequence(
        F.col("start_pos"), F.col("start_pos") + F.col("length") - 1)))


def drop_overlaps(events: DataFrame, keys) -> DataFrame:
    """Keep an event only if no event with a lower id touches any of its rows."""
    keys = list(keys)
    rows = _event_rows(events)
    first = rows.groupBy(*keys, "pos").agg(F.min("event_id").alias("_first"))
    kept = (rows.join(first, [*keys, "pos"]).groupBy(*keys, "event_id")
            .agg(F.bool_and(F.col("_first") == F.col("event_id")).alias("_ok")).filter("_ok").drop("_ok"))
    return events.join(kept, [*keys, "event_id"])


def contaminate(test: DataFrame, events: DataFrame, keys, power: str = "power_w") -> DataFrame:
    """Raise the power of the rows each event covers and label them; nothing else changes.

    Events are unfolded to row positions (a few dozen each), so the range join is an
    equi-join. `events` must not overlap.
    """
    keys = list(keys)
    e = _event_rows(events).select(*keys, "pos", "event_id", F.col("type").alias("anomaly_type"), "magnitude")
    d = test.join(e, [*keys, "pos"], "left")
    extra = F.coalesce(F.col(power) * F.col("magnitude"), F.lit(0.0))
    return d.withColumns({
        "injected_extra_w": extra, power: F.col(power) + extra, "is_anomaly": F.col("event_id").isNotNull(),
        "anomaly_type": F.coalesce("anomaly_type", F.lit("none")),
        "event_id": F.coalesce("event_id", F.lit(-1).cast("bigint")),
    }).drop("magnitude")


def injection_summary(contaminated: DataFrame, keys, low: Column) -> DataFrame:
    t = F.col("anomaly_type")
    events = lambda k: F.count_distinct(F.when(t == k, F.col("event_id")))
    return contaminated.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("test_intervals"), events("spike").alias("spike_events"),
        events("waste").alias("waste_events"), F.count_if(t == "spike").alias("spike_intervals"),
        F.count_if(t == "waste").alias("waste_intervals"),
        (100 * F.avg(F.col("is_anomaly").cast("double"))).alias("pct_contaminated"),
        F.count_if(low).alias("low_occ_intervals"))


# ----------------------------------------------------------------- evaluation
def _rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    p, r = zero(ratio(tp, tp + fp)), zero(ratio(tp, tp + fn))
    return {"precision": p, "recall": r, "f1": zero(ratio(2 * p * r, p + r)),
            "accuracy": zero(ratio(tp + tn, tp + fp + fn + tn))}


def confusion(df: DataFrame, keys, truth: str = "is_anomaly", flagged: str = "flagged") -> DataFrame:
    """Confusion counts with precision, recall, F1 (0, never NaN) and accuracy."""
    a, b = F.col(truth), F.col(flagged)
    d = df.groupBy(*keys).agg(
        F.count_if(a & b).alias("true_positives"), F.count_if(~a & b).alias("false_positives"),
        F.count_if(a & ~b).alias("false_negatives"), F.count_if(~a & ~b).alias("true_negatives"))
    n = [F.col(c).cast("double") for c in ("true_positives", "false_positives", "false_negatives", "true_negatives")]
    return d.withColumns(_rates(*n))


def evaluate_by_type(df: DataFrame, keys, flagged: str = "flagged") -> DataFrame:
    """Scores overall and per anomaly type; the other type is left out of a type's negatives.

    Counts per type are taken first, so only a handful of rows are copied into scopes.
    """
    keys = list(keys)
    c = df.groupBy(*keys, "anomaly_type", F.col(flagged).alias("_f")).agg(F.count(F.lit(1)).alias("_n"))
    t = F.col("anomaly_type")
    scopes = F.array(F.lit("all"), F.when(t.isin("none", "spike"), "spike"), F.when(t.isin("none", "waste"), "waste"))
    s = c.withColumn("scope", F.explode(F.array_compact(scopes)))
    hit, odd = F.col("_f"), t != "none"
    total = lambda m: F.coalesce(F.sum(F.when(m, F.col("_n"))), F.lit(0))
    d = s.groupBy(*keys, "scope").agg(
        total(odd).alias("n_anomaly_intervals"), total(odd & hit).alias("true_positives"),
        total(~odd & hit).alias("false_positives"), total(odd & ~hit).alias("false_negatives"),
        total(~odd & ~hit).alias("true_negatives"))
    n = [F.col(x).cast("double") for x in ("true_positives", "false_positives", "false_negatives", "true_negatives")]
    return d.withColumns(_rates(*n))


def ranking_scores(df: DataFrame, keys, truth: str = "is_anomaly", score: str = "z") -> DataFrame:
    """ROC AUC and step-wise average precision of |score|; NULL when one class is absent.

    Both follow from the class counts at each distinct score and below it.
    """
    keys = list(keys)
    d = df.select(*keys, F.abs(F.col(score)).alias("_s"), F.col(truth).cast("bigint").alias("_t"))
    v = ranked_values(d, keys, "_s", {"pos": F.col("_t")})
    total = d.filter(F.col("_s").isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("N"), F.sum("_t").cast("double").alias("P"))
    j = v.join(total, keys)
    rank = F.col("before") + (F.col(COUNT) + 1) / 2
    tp, k = F.col("P") - F.col("pos_before"), F.col("N") - F.col("before")
    a = j.groupBy(*keys).agg(F.first("N").alias("N"), F.first("P").alias("P"), F.sum(rank * F.col("pos")).alias("R"),
                             F.sum(ratio(F.col("pos"), F.col("P")) * ratio(tp, k)).alias("AP"))
    both = (F.col("P") > 0) & (F.col("P") < F.col("N"))
    auc = ratio(F.col("R") - F.col("P") * (F.col("P") + 1) / 2, F.col("P") * (F.col("N") - F.col("P")))
    return a.select(*keys, F.when(both, auc).alias("roc_auc"), F.when(both, F.col("AP")).alias("average_precision"),
                    F.when(both, ratio(F.col("P"), F.col("N"))).alias("baseline_precision"))


def event_recall(df: DataFrame, keys, flagged: str = "flagged") -> DataFrame:
    """Share of whole events with at least one flagged row."""
    per = (df.filter("anomaly_type <> 'none'").groupBy(*keys, "anomaly_type", "event_id")
           .agg(F.bool_or(flagged).alias("_hit")))
    return per.groupBy(*keys, "anomaly_type").agg(
        F.count(F.lit(1)).alias("events"), F.count_if("_hit").alias("events_detected"),
        F.avg(F.col("_hit").cast("double")).alias("event_recall"))


def flag_top_n(df: DataFrame, keys, budget: DataFrame | int, score: str = "z", name: str = "flagged_top",
               ts: str = "ts", rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Flag the n rows with the largest |score| per key; ties go to the earliest rows.

    The n-th largest value is found from the counts per value. Rows above it are in, rows
    below it out, and only ties at the value itself need an order.
    `budget` is n, or a table with a column `budget` per (some of the) keys.
    """
    keys = list(keys)
    s = F.abs(F.col(score))
    v = ranked_values(df.select(*keys, s.alias("_s")), keys, "_s")
    size = v.groupBy(*keys).agg(F.sum(COUNT).alias("_N"))
    if isinstance(budget, int):
        v = v.withColumn("budget", F.lit(budget))
    else:
        v = v.join(budget, [k for k in keys if k in budget.columns])
    above = F.col("_N") - F.col("before") - F.col(COUNT)
    cut = (v.join(size, keys).withColumn("_above", above)
           .filter((F.col("_above") < F.col("budget")) & (F.col("_above") + F.col(COUNT) >= F.least("budget", "_N")))
           .groupBy(*keys).agg(F.max(F.struct(F.col("_v"), (F.col("budget") - F.col("_above")).alias("take"))).alias("_c"))
           .select(*keys, F.col("_c._v").alias("_cut"), F.col("_c.take").alias("_take")))
    d = df.join(cut, keys, "left")
    tie = d.filter(s == F.col("_cut")).select(*keys, ts, "_take")
    won = (row_positions(tie, keys, ts, rules.segment_days, "_place").filter(F.col("_place") < F.col("_take"))
           .select(*keys, ts, F.lit(True).alias("_won")))
    return (d.join(won, [*keys, ts], "left")
            .withColumn(name, F.coalesce((s > F.col("_cut")) | F.col("_won"), F.lit(False)))
            .drop("_cut", "_take", "_won"))


def matched_budget(scored: DataFrame, keys, detector: str = "detector", flagged: str = "flagged") -> DataFrame:
    """The alert budget both detectors are held to: the smaller of their alert counts."""
    per = scored.groupBy(*keys, detector).agg(F.count_if(flagged).alias("_n"))
    return per.groupBy(*keys).agg(F.min("_n").alias("budget"))


def mean_by_detector(table: DataFrame, by, values, detector: str = "detector", names=("T", "O")) -> DataFrame:
    """Mean over buildings, detectors side by side, with the difference of the two."""
    aggs = [F.avg(F.when(F.col(detector) == n, F.col(v))).alias(f"{v}_{n}") for v in values for n in names]
    d = table.groupBy(*by).agg(*aggs) if by else table.agg(*aggs)
    return d.withColumns({f"{v}_difference": F.col(f"{v}_{names[1]}") - F.col(f"{v}_{names[0]}") for v in values})


# ------------------------------------------------------------------ real rows
def first_rows(df: DataFrame, n: int, order, each=()) -> DataFrame:
    """The first n rows in `order`, of all rows or of each value of `each`. The engine cuts every
    partition to n rows a group before it deals them, so no group is sorted whole in one task."""
    if not each:
        return df.orderBy(*order).limit(n)
    place = F.row_number().over(Window.partitionBy(*each).orderBy(*order))
    return df.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def top_unusual(scored: DataFrame, context: DataFrame, keys, n: int = 10, ts: str = "ts", each=()) -> DataFrame:
    """The n rows (of each detector, say) with the largest |z| and their context; a top-k, not a
    sort of all rows."""
    top = first_rows(scored, n, [F.abs("z").desc_nulls_last(), *keys, ts], each)
    w = [*keys, ts]
    return top.join(context.select(*w, *[c for c in ("occupancy", "hour", "weekday", "period")]), w, "left").select(
        *each, *w, "weekday", "hour", "period", "occupancy", (F.col("power_w") / 1000).alias("actual_kw"),
        (F.col("predicted_w") / 1000).alias("expected_kw"), (F.col("residual_w") / 1000).alias("excess_kw"), "z")


def episodes(scored: DataFrame, keys, flagged: str = "flagged", ts: str = "ts",
             rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Merge flagged rows whose row positions differ by at most `episode_gap`.

    Positions count all rows given, so a hole in the record does not break an episode.
    Runs are built inside slices of positions and joined where they meet at a border.
    """
    keys = list(keys)
    gap = rules.episode_gap
    d = row_positions(scored, keys, ts, rules.segment_days, "pos").filter(flagged)
    d = d.withColumn(SLICE, F.floor(F.col("pos") / POSITIONS_PER_SLICE).cast("bigint"))
    w = Window.partitionBy(*keys, SLICE).orderBy("pos")
    new = F.coalesce(F.col("pos") - F.lag("pos").over(w) > gap, F.lit(True)).cast("int")
    d = d.withColumn("_new", new).withColumn("_run", F.sum("_new").over(up_to_here(w)))
    part = d.groupBy(*keys, SLICE, "_run").agg(
        F.min("pos").alias("_a"), F.max("pos").alias("_b"), F.min(ts).alias("start"), F.max(ts).alias("end"),
        F.count(F.lit(1)).alias("intervals"), F.max(F.abs("z")).alias("peak_z"), F.sum("residual_w").alias("_sum"))
    m = merge_runs(part, keys, lambda win: F.col("_a") - F.lag("_b").over(win) <= gap)
    e = m.groupBy(*keys, "_gslice", "_grun").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("intervals").alias("intervals"),
        F.max("peak_z").alias("peak_z"), F.sum("_sum").alias("_sum"))
    hours = (wall_seconds("end") - wall_seconds("start")) / 3600
    return e.select(*keys, "start", "end", "intervals", (F.col("intervals") / BLOCKS_PER_HOUR).alias("flagged_hours"),
                    (hours + 1 / BLOCKS_PER_HOUR).alias("span_hours"), "peak_z",
                    (F.col("_sum") / F.col("intervals") / 1000).alias("mean_excess_kw"),
                    kwh("_sum").alias("total_excess_kwh"))


def worst_episodes(eps: DataFrame, n: int = 10, each=()) -> DataFrame:
    """The n episodes (of each detector, say) with the highest peaks."""
    return first_rows(eps, n, [F.col("peak_z").desc(), "building", "start"], each)


def episode_summary(eps: DataFrame, keys=("building",)) -> DataFrame:
    """Each key's most extreme episode beside how often it was flagged at all."""
    top = F.max_by(F.struct("start", "flagged_hours", "peak_z", "mean_excess_kw", "total_excess_kwh"),
                   F.struct(F.col("peak_z"), -F.unix_date(F.to_date("start"))))
    d = eps.groupBy(*keys).agg(
        top.alias("_t"), F.count(F.lit(1)).alias("total_episodes"), F.avg("flagged_hours").alias("mean_duration_h"),
        F.sum("total_excess_kwh").alias("building_total_excess_kwh"))
    return d.select(*keys, "_t.*", "total_episodes", "mean_duration_h", "building_total_excess_kwh")
