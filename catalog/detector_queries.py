"""Residual scores, contamination and its evaluation, on a detector SQL can follow too."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.sql import i, is_, r, rs, sql, t
from voltloom.functions import columns as C
from voltloom.operators import anomaly, models, profile
from voltloom.plans import experiment

SPLIT_SQL = """fr AS (SELECT building, ts, power_w, occupancy, hour, weekday, month, is_weekend, is_semester, is_working_day, temp_c, cdh, period,
    row_number() OVER (PARTITION BY building ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY building) AS n FROM buildings WHERE usable),
fs AS (SELECT *, floor(7e-1 * n) AS ntr, floor((15e-2 / (1e0 - 7e-1)) * (n - floor(7e-1 * n))) AS nv FROM fr),
sp AS (SELECT *, CASE WHEN pos < ntr THEN 'train' WHEN pos < ntr + nv THEN 'validation' ELSE 'test' END AS split FROM fs)"""

LABEL_SQL = SPLIT_SQL + """, te AS (
  SELECT s.building, s.ts, s.hour, s.occupancy, s.period, s.weekday, round(power_w, 6) AS power_w, s.pos - ntr - nv AS pos, n - ntr - nv AS n,
    round(pt, 6) AS pt, round(coalesce(po, pt), 6) AS po
  FROM sp s JOIN (SELECT building, hour, avg(power_w) AS pt FROM sp WHERE split = 'train' GROUP BY 1, 2) a USING (building, hour)
    LEFT JOIN (SELECT building, hour, occupancy <= 1 AS low, avg(power_w) AS po FROM sp WHERE split = 'train' GROUP BY 1, 2, 3) b
      ON s.building = b.building AND s.hour = b.hour AND (s.occupancy <= 1) = b.low
  WHERE split = 'test'),
e0 AS (SELECT building, n, pos AS s, 'spike' AS type, 1 + pos % 3 AS len, 5e-1 + (pos % 50) / 1e2 AS mag, pos AS event_id FROM te WHERE pos % 97 = 13
  UNION ALL SELECT building, n, pos, 'waste', 12 + pos % 24, 15e-2 + (pos % 15) / 1e2, pos + 1000000000 FROM te WHERE pos % 53 = 5 AND occupancy <= 1),
e1 AS (SELECT * FROM e0 WHERE s + len <= n),
e2 AS (SELECT * FROM e1 a WHERE NOT EXISTS (SELECT 1 FROM e1 b WHERE b.building = a.building AND b.event_id < a.event_id
    AND b.s < a.s + a.len AND a.s < b.s + b.len)),
lab AS (SELECT te.* REPLACE (power_w + coalesce(power_w * mag, 0e0) AS power_w), coalesce(power_w * mag, 0e0) AS injected_extra_w,
    coalesce(type, 'none') AS anomaly_type, coalesce(event_id, -1) AS event_id, type IS NOT NULL AS is_anomaly
  FROM te LEFT JOIN e2 ON e2.building = te.building AND te.pos >= e2.s AND te.pos < e2.s + e2.len),
det AS (SELECT * EXCLUDE (pt, po), 'T' AS detector, pt AS predicted_w FROM lab UNION ALL SELECT * EXCLUDE (pt, po), 'O', po FROM lab),
dr AS (SELECT *, power_w - predicted_w AS residual_w FROM det),
dm AS (SELECT building, detector, quantile_cont(residual_w, 0.5) AS med, stddev_samp(residual_w) AS sd,
    quantile_cont(residual_w, 0.25) AS q1, quantile_cont(residual_w, 0.75) AS q3 FROM dr GROUP BY 1, 2),
da AS (SELECT building, detector, quantile_cont(abs(residual_w - med), 0.5) AS mad FROM dr JOIN dm USING (building, detector) GROUP BY 1, 2),
sc AS (SELECT dr.*, (residual_w - med) / coalesce(nullif(14826e-4 * mad, 0), nullif(sd, 0)) AS z,
    residual_w < q1 - 15e-1 * (q3 - q1) OR residual_w > q3 + 15e-1 * (q3 - q1) AS flagged_iqr
  FROM dr JOIN dm USING (building, detector) JOIN da USING (building, detector)),
scored AS (SELECT *, CASE WHEN abs(z) >= 3 THEN 'ANOMALY' WHEN abs(z) >= 2 THEN 'WARNING' ELSE 'NORMAL' END AS band, abs(z) >= 3 AS flagged FROM sc)"""

CONF = """count(*) FILTER (WHERE {t} AND {f}) AS tp, count(*) FILTER (WHERE NOT {t} AND {f}) AS fp,
  count(*) FILTER (WHERE {t} AND NOT {f}) AS fn, count(*) FILTER (WHERE NOT {t} AND NOT {f}) AS tn"""
CONF_OUT = is_(("tp", "true_positives"), ("fp", "false_positives"), ("fn", "false_negatives"), ("tn", "true_negatives")) + ", " + rs(
    ("coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0)", "precision"), ("coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0)", "recall"),
    ("coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0)", "f1"), ("(tp + tn) / (tp + fp + fn + tn)::DOUBLE", "accuracy"))
BUDGET_SQL = """bud AS (SELECT building, min(k) AS budget FROM (SELECT building, detector, count(*) FILTER (WHERE flagged) AS k FROM scored GROUP BY 1, 2) GROUP BY 1),
top AS (SELECT s.*, row_number() OVER (PARTITION BY building, detector ORDER BY abs(z) DESC, ts) <= budget AS flagged_top FROM scored s JOIN bud USING (building))"""
RANK_SQL = """rk AS (SELECT *, rank() OVER (PARTITION BY building, detector ORDER BY abs(z)) + (count(*) OVER (PARTITION BY building, detector, abs(z)) - 1) / 2e0 AS ar,
    count(*) OVER w AS k, count(*) FILTER (WHERE is_anomaly) OVER w AS tp, count(*) OVER (PARTITION BY building, detector) AS nn,
    count(*) FILTER (WHERE is_anomaly) OVER (PARTITION BY building, detector) AS pp
  FROM scored WHERE z IS NOT NULL WINDOW w AS (PARTITION BY building, detector ORDER BY abs(z) DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
rank_ AS (SELECT building, detector, (sum(ar) FILTER (WHERE is_anomaly) - any_value(pp * (pp + 1) / 2e0)) / any_value(pp * (nn - pp)::DOUBLE) AS roc_auc,
    sum(tp / k::DOUBLE) FILTER (WHERE is_anomaly) / any_value(pp) AS average_precision, any_value(pp / nn::DOUBLE) AS baseline_precision FROM rk GROUP BY 1, 2)"""
BD = ["building", "detector"]


@query("w07_chronological_split", sql(f"SELECT building, {t('ts')}, split, {is_('pos', ('n', 'n_rows'))} FROM sp", "buildings", extra=SPLIT_SQL))
def _(w):
    d = models.with_split(models.usable_frame(w.buildings), ["building"], rules=w.rules)
    return d.select("building", "ts", "split", "pos", "n_rows")


@query("a39_split_summary", sql(f"""SELECT building, split, {i('count(*)', 'intervals')}, {rs(('1e2 * count(*) / any_value(n)', 'share_pct'), ('avg(power_w)', 'mean_power_w'))},
  {t('min(ts)', 'first')}, {t('max(ts)', 'last')} FROM sp GROUP BY 1, 2""", "buildings", extra=SPLIT_SQL))
def _(w):
    return models.split_summary(w.split, ["building"])


@query("w08_prefix_folds", sql(f"""SELECT building, fold, {i('count(*)', 'n')}, {t('min(ts)', 'first')}, {t('max(ts)', 'last')} FROM (
  SELECT building, ts, CASE WHEN p < m - 5 * (m // 6) THEN 0 ELSE (p - (m - 5 * (m // 6))) // (m // 6) + 1 END::BIGINT AS fold FROM (
    SELECT building, ts, row_number() OVER (PARTITION BY building ORDER BY ts) - 1 AS p, count(*) OVER (PARTITION BY building) AS m FROM sp WHERE split = 'train'))
  GROUP BY 1, 2""", "buildings", extra=SPLIT_SQL))
def _(w):
    train = w.split.filter("split = 'train'").drop("pos", "n_rows")
    return models.with_folds(train, ["building"], rules=w.rules).groupBy("building", "fold").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("n03_contaminated_rows", sql(f"""SELECT building, {t('ts')}, {is_('pos', 'event_id')}, anomaly_type, is_anomaly, {rs('power_w', 'injected_extra_w')} FROM lab""",
                                    "buildings", extra=LABEL_SQL))
def _(w):
    return w.labelled.filter("detector = 'T'").select("building", "ts", "pos", "event_id", "anomaly_type", "is_anomaly",
                                                      "power_w", "injected_extra_w")


@query("a43_injection_summary", sql(f"""SELECT building, {is_(('count(*)', 'test_intervals'), ("count(DISTINCT event_id) FILTER (WHERE anomaly_type = 'spike')", 'spike_events'),
    ("count(DISTINCT event_id) FILTER (WHERE anomaly_type = 'waste')", 'waste_events'), ("count(*) FILTER (WHERE anomaly_type = 'spike')", 'spike_intervals'),
    ("count(*) FILTER (WHERE anomaly_type = 'waste')", 'waste_intervals'), ('count(*) FILTER (WHERE occupancy <= 1)', 'low_occ_intervals'))},
    {r('1e2 * avg(is_anomaly::INT)', 'pct_contaminated')} FROM lab GROUP BY 1""", "buildings", extra=LABEL_SQL))
def _(w):
    return anomaly.injection_summary(w.labelled.filter("detector = 'T'"), ["building"], C.is_low("occupancy", F.lit(1.0)))


@query("n01_n02_scored_rows", sql(f"""SELECT building, detector, {t('ts')}, {rs('residual_w', 'z')}, band, flagged, flagged_iqr FROM scored""", "buildings", extra=LABEL_SQL))
def _(w):
    return anomaly.score_detector(w.labelled, BD, rules=w.rules).select(
        *BD, "ts", "residual_w", "z", "band", "flagged", "flagged_iqr")


@query("f10_band_counts", sql(f"""SELECT building, detector, {is_(('count(*)', 'intervals'), ("count(*) FILTER (WHERE band = 'NORMAL')", 'normal'),
  ("count(*) FILTER (WHERE band = 'WARNING')", 'warning'), ("count(*) FILTER (WHERE band = 'ANOMALY')", 'anomaly'))}, {r('1e2 * avg(flagged::INT)', 'pct_flagged')}
  FROM scored GROUP BY 1, 2""", "buildings", extra=LABEL_SQL))
def _(w):
    return anomaly.band_counts(w.scored, BD)


@query("a43_residual_summary", sql(f"""SELECT building, detector, {rs(('avg(residual_w)', 'mean_w'), ('stddev_samp(residual_w)', 'sd_w'), ('quantile_cont(residual_w, 0.5)', 'median_w'))}
  FROM scored GROUP BY 1, 2""", "buildings", extra=LABEL_SQL))
def _(w):
    return anomaly.residual_summary(w.scored, BD)


@query("n04_confusion", sql(f"SELECT building, detector, {CONF_OUT} FROM (SELECT building, detector, {CONF.format(t='is_anomaly', f='flagged')} FROM scored GROUP BY 1, 2)",
                            "buildings", extra=LABEL_SQL))
def _(w):
    return anomaly.confusion(w.scored, BD)


@query("n05_evaluate_by_type", sql(f"""SELECT building, detector, scope, {i('tp + fn', 'n_anomaly_intervals')}, {CONF_OUT} FROM (
  SELECT building, detector, scope, {CONF.format(t='is_anomaly', f='flagged')} FROM scored, (VALUES ('all'), ('spike'), ('waste')) v(scope)
  WHERE scope = 'all' OR anomaly_type IN ('none', scope) GROUP BY 1, 2, 3)""", "buildings", extra=LABEL_SQL))
def _(w):
    return anomaly.evaluate_by_type(w.scored, BD)


@query("n06_ranking_scores", sql(f"SELECT building, detector, {rs('roc_auc', 'average_precision', 'baseline_precision')} FROM rank_", "buildings",
                                 extra=LABEL_SQL + ", " + RANK_SQL))
def _(w):
    return anomaly.ranking_scores(w.scored, BD)


EVENT_SQL = """ev7 AS (SELECT building, detector, anomaly_type, count(*) AS events, count(*) FILTER (WHERE hit) AS events_detected, avg(hit::INT) AS event_recall FROM (
  SELECT building, detector, anomaly_type, event_id, bool_or(flagged) AS hit FROM scored WHERE anomaly_type <> 'none' GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)"""


@query("n07_event_recall", sql(f"SELECT building, detector, anomaly_type, {is_('events', 'events_detected')}, {r('event_recall', 'event_recall')} FROM ev7", "buildings",
                               extra=LABEL_SQL + ", " + EVENT_SQL))
def _(w):
    return anomaly.event_recall(w.scored, BD)


@query("t01_n08_matched_budget", sql(f"SELECT building, detector, {CONF_OUT} FROM (SELECT building, detector, {CONF.format(t='is_anomaly', f='flagged_top')} FROM top GROUP BY 1, 2)",
                                     "buildings", extra=LABEL_SQL + ", " + BUDGET_SQL))
def _(w):
    return anomaly.confusion(experiment.matched(w.scored, rules=w.rules), BD, flagged="flagged_top")


@query("t01_top_n_rows", sql(f"SELECT building, detector, {t('ts')} FROM (SELECT *, row_number() OVER (PARTITION BY building, detector ORDER BY abs(z) DESC, ts) AS rn FROM scored) WHERE rn <= 25",
                             "buildings", extra=LABEL_SQL))
def _(w):
    return anomaly.flag_top_n(w.scored, BD, 25, rules=w.rules).filter("flagged_top").select(*BD, "ts")


@query("n08_rule_variants", sql(f"""SELECT building, detector, rule, {i('tp + fp', 'alerts')}, {CONF_OUT} FROM (
  SELECT building, detector, rule, {CONF.format(t='is_anomaly', f='f')} FROM (
    SELECT building, detector, is_anomaly, unnest(['two-sided', 'one-sided', 'iqr']) AS rule, unnest([flagged, z > 3, flagged_iqr]) AS f FROM scored) GROUP BY 1, 2, 3)""",
    "buildings", extra=LABEL_SQL))
def _(w):
    return experiment.rule_variants(w.scored, rules=w.rules)


F1 = "coalesce(2e0 * count(*) FILTER (WHERE is_anomaly AND {f}) / nullif(count(*) FILTER (WHERE is_anomaly) + count(*) FILTER (WHERE {f}), 0), 0)"


@query("n08_pooled_answer", sql(f"""SELECT comparison, metric, {rs(("avg(v) FILTER (WHERE detector = 'T')", 'detector_t'), ("avg(v) FILTER (WHERE detector = 'O')", 'detector_o'),
    ("avg(v) FILTER (WHERE detector = 'O') - avg(v) FILTER (WHERE detector = 'T')", 'difference'))} FROM (
  SELECT 'fixed threshold' AS comparison, 'mean F1' AS metric, detector, {F1.format(f='flagged')} AS v FROM scored GROUP BY building, detector
  UNION ALL SELECT 'matched alert budget', 'mean F1', detector, {F1.format(f='flagged_top')} FROM top GROUP BY building, detector
  UNION ALL SELECT 'threshold-free ranking', 'mean average precision', detector, average_precision FROM rank_
  UNION ALL SELECT 'threshold-free ranking', 'mean ROC AUC', detector, roc_auc FROM rank_
  UNION ALL SELECT 'waste only, matched budget', 'mean F1', detector, {F1.format(f='flagged_top')} FROM top WHERE anomaly_type <> 'spike' GROUP BY building, detector
  UNION ALL SELECT 'waste events noticed at all', 'event recall', detector, event_recall FROM ev7 WHERE anomaly_type = 'waste') GROUP BY 1, 2""",
    "buildings", extra=", ".join([LABEL_SQL, BUDGET_SQL, RANK_SQL, EVENT_SQL])))
def _(w):
    return experiment.pooled_answer(w.scored, rules=w.rules)


EPISODE_SQL = """ep0 AS (SELECT *, row_number() OVER (PARTITION BY building, detector ORDER BY ts) AS p, abs(z) >= 2 AS hit FROM scored),
ep1 AS (SELECT *, coalesce(p - lag(p) OVER (PARTITION BY building, detector ORDER BY p) > 3, true)::INT AS brk FROM ep0 WHERE hit),
ep2 AS (SELECT *, sum(brk) OVER (PARTITION BY building, detector ORDER BY p) AS g FROM ep1),
eps AS (SELECT building, detector, min(ts) AS start, max(ts) AS "end", count(*) AS intervals, count(*) / 6e0 AS flagged_hours,
    (epoch(max(ts)) - epoch(min(ts))) / 36e2 + 1e0 / 6e0 AS span_hours, max(abs(z)) AS peak_z, avg(residual_w) / 1e3 AS mean_excess_kw,
    sum(residual_w) / 1e3 * (10e0 / 60e0) AS total_excess_kwh FROM ep2 GROUP BY building, detector, g)"""
EP_COLS = rs("flagged_hours", "span_hours", "peak_z", "mean_excess_kw", "total_excess_kwh")


def _episodes(w):
    s = w.scored.withColumn("hit", F.coalesce(F.abs("z") >= 2, F.lit(False)))
    return anomaly.episodes(s, BD, "hit", rules=w.rules)


@query("g07_episodes", sql(f"SELECT building, detector, {t('start')}, {t(chr(34) + 'end' + chr(34))}, {i('intervals')}, {EP_COLS} FROM eps", "buildings",
                           extra=LABEL_SQL + ", " + EPISODE_SQL))
def _(w):
    return _episodes(w)


@query("t03_worst_episodes", sql(f"""SELECT detector, building, {t('start')}, {i('intervals')}, {r('peak_z', 'peak_z')} FROM (
  SELECT * FROM eps QUALIFY row_number() OVER (PARTITION BY detector ORDER BY peak_z DESC, building, start) <= 10)""", "buildings", extra=LABEL_SQL + ", " + EPISODE_SQL))
def _(w):
    return anomaly.worst_episodes(_episodes(w), each=["detector"]).select("detector", "building", "start", "intervals", "peak_z")


@query("a38_worst_episodes_by_hour", sql(f"""SELECT detector, hour(start)::BIGINT AS hour, strftime(start, '%Y-%m') AS month, building, {i('count(*)', 'n')}
  FROM (SELECT * FROM eps QUALIFY row_number() OVER (PARTITION BY detector ORDER BY peak_z DESC, building, start) <= 30) GROUP BY 1, 2, 3, 4""", "buildings", extra=LABEL_SQL + ", " + EPISODE_SQL))
def _(w):
    top = anomaly.worst_episodes(_episodes(w), 30, each=["detector"])
    return profile.value_counts(top.select("detector", F.hour("start").alias("hour"), C.month_label("start").alias("month"), "building"),
                                "detector", "hour", "month", "building")


@query("n09_w09_episode_per_building", sql(f"""SELECT building, detector, {t('arg_max(start, peak_z)', 'start')}, {rs(('arg_max(flagged_hours, peak_z)', 'flagged_hours'), ('max(peak_z)', 'peak_z'),
    ('arg_max(mean_excess_kw, peak_z)', 'mean_excess_kw'), ('arg_max(total_excess_kwh, peak_z)', 'total_excess_kwh'), ('avg(flagged_hours)', 'mean_duration_h'),
    ('sum(total_excess_kwh)', 'building_total_excess_kwh'))}, {i('count(*)', 'total_episodes')} FROM eps GROUP BY 1, 2""", "buildings",
    extra=LABEL_SQL + ", " + EPISODE_SQL))
def _(w):
    return anomaly.episode_summary(_episodes(w), BD)


@query("t02_top_unusual", sql(f"""SELECT detector, building, {t('ts')}, weekday, period, {i('hour')}, {rs('occupancy', ('power_w / 1e3', 'actual_kw'), ('predicted_w / 1e3', 'expected_kw'),
    ('residual_w / 1e3', 'excess_kw'), 'z')} FROM (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY detector ORDER BY abs(z) DESC NULLS LAST, building, ts) <= 10)""", "buildings", extra=LABEL_SQL))
def _(w):
    s = w.scored.select(*BD, "ts", "power_w", "predicted_w", "residual_w", "z")
    return anomaly.top_unusual(s, w.buildings, ["building"], 10, each=["detector"])


@query("a40_window_kpis", sql(f"""SELECT building, detector, {is_(('count(*) FILTER (WHERE i)', 'intervals'), ("count(*) FILTER (WHERE i AND band = 'ANOMALY')", 'flagged'),
    ('count(*) FILTER (WHERE i AND occupancy <= 1)', 'low_occupancy_intervals'))}, {rs(("1e2 * avg((band = 'ANOMALY')::INT) FILTER (WHERE i)", 'window_rate_pct'),
    ("1e2 * avg((band = 'ANOMALY')::INT)", 'overall_rate_pct'), ('avg(temp_c) FILTER (WHERE i)', 'temp_mean_c'), ('min(temp_c) FILTER (WHERE i)', 'temp_min_c'),
    ('max(temp_c) FILTER (WHERE i)', 'temp_max_c'), ('sum(power_w) FILTER (WHERE i) / 1e3 * (10e0 / 60e0)', 'window_kwh'))},
    coalesce(avg((band = 'ANOMALY')::INT) > 0 AND 1e2 * avg((band = 'ANOMALY')::INT) FILTER (WHERE i) > greatest(3e2 * avg((band = 'ANOMALY')::INT), 5e0), false) AS drift_warning
  FROM (SELECT s.*, temp_c, s.ts BETWEEN TIMESTAMP '2024-01-27 00:00:00' AND TIMESTAMP '2024-01-29 00:00:00' AS i
    FROM scored s LEFT JOIN (SELECT building, ts, temp_c FROM buildings) USING (building, ts)) GROUP BY 1, 2""", "buildings", extra=LABEL_SQL))
def _(w):
    s = w.scored.select(*BD, "ts", "power_w", "occupancy", "band", "temp_c").withColumn(
        "low_occupancy", C.is_low("occupancy", F.lit(1.0)))
    b = lambda x: F.lit(x).cast("timestamp_ntz")
    return profile.window_kpis(s, BD, b("2024-01-27 00:00:00"), b("2024-01-29 00:00:00"))


@query("n10_display_scores", sql(f"""
  SELECT building, {t('ts')}, split, {rs('residual_w', 'z')}, CASE WHEN z < 0 THEN 'NORMAL' WHEN abs(z) >= 3 THEN 'ANOMALY' WHEN abs(z) >= 2 THEN 'WARNING' ELSE 'NORMAL' END AS band
  FROM (SELECT q.*, (residual_w - med) / CASE WHEN mad > 0 THEN 14826e-4 * mad ELSE 1 END AS z FROM q JOIN qm USING (building) JOIN qa USING (building))""", "buildings",
  extra=SPLIT_SQL + """, q AS (SELECT building, ts, split, round(power_w, 6) - round(pt, 6) AS residual_w FROM sp
      JOIN (SELECT building, hour, avg(power_w) AS pt FROM sp WHERE split = 'train' GROUP BY 1, 2) a USING (building, hour)),
    qm AS (SELECT building, quantile_cont(residual_w, 0.5) AS med FROM q WHERE split = 'test' GROUP BY 1),
    qa AS (SELECT building, quantile_cont(abs(residual_w - med), 0.5) AS mad FROM q JOIN qm USING (building) WHERE split = 'test' GROUP BY 1)"""))
def _(w):
    """A whole record on the scale of its test residuals, against the mean by hour."""
    mean = w.split.filter("split = 'train'").groupBy("building", "hour").agg(F.avg("power_w").alias("pt"))
    d = w.split.join(mean, ["building", "hour"]).withColumn("residual_w", F.round("power_w", 6) - F.round("pt", 6))
    return anomaly.apply_test_scale(d, ["building"], w.rules).select("building", "ts", "split", "residual_w", "z", "band")
