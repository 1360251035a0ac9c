"""Scores, labels, ranking and episodes on hand-worked cases and against brute force."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tests.conftest import column, series
from voltloom.config import DEFAULT_RULES
from voltloom.operators import anomaly

RULES = replace(DEFAULT_RULES, segment_days=1)
K = ["key"]


def z_of(spark, values):
    return column(anomaly.robust_zscore(series(spark, values, cols=("residual_w",)), K), "z")


def test_robust_z(spark):
    assert z_of(spark, [1, 2, 3, 4, 5])[2] == 0
    assert z_of(spark, [10, 20, 30, 40, 50])[4] == pytest.approx(20 / 14.826)
    assert z_of(spark, [*[0] * 100, *[1] * 100, *[5000] * 5])[-1] > 3
    assert z_of(spark, [7] * 50) == [None] * 50
    assert z_of(spark, [*[0] * 9, 10])[-1] == pytest.approx(10 / 3.1622776601683795)   # MAD 0: sample sd


def test_confusion(spark):
    d = series(spark, [(True, True), (True, False), (False, True), (False, False), (False, False)], cols=("t", "f"))
    r = anomaly.confusion(d, K, "t", "f").first()
    assert (r.true_positives, r.false_positives, r.false_negatives, r.true_negatives) == (1, 1, 1, 2)
    assert (r.precision, r.recall, r.f1, r.accuracy) == (0.5, 0.5, 0.5, 0.6)
    none = anomaly.confusion(d.withColumn("f", F.lit(False)), K, "t", "f").first()
    assert (none.precision, none.recall, none.f1) == (0, 0, 0)
    best = anomaly.confusion(d.withColumn("f", F.col("t")), K, "t", "f").first()
    assert (best.precision, best.recall, best.f1, best.accuracy) == (1, 1, 1, 1)


def test_iqr_flags(spark):
    d = series(spark, [*[0] * 50, 500, -500], cols=("residual_w",))
    assert sum(column(anomaly.iqr_flags(d, K), "flagged_iqr")) == 2


def test_ranking_scores(spark):
    d = series(spark, [(0.1, False), (0.4, False), (0.35, True), (0.8, True)], cols=("z", "t"))
    r = anomaly.ranking_scores(d, K, "t").first()
    assert r.roc_auc == pytest.approx(0.75) and r.average_precision == pytest.approx(0.8333333333)
    one = anomaly.ranking_scores(d.withColumn("t", F.lit(False)), K, "t").first()
    assert one.roc_auc is None and one.average_precision is None


@pytest.mark.parametrize("seed", [1, 2])
def test_ranking_scores_by_pairs(spark, seed):
    rng = random.Random(seed)
    rows = [(float(rng.randint(0, 12)) * rng.choice([-1, 1]), rng.random() < 0.3) for _ in range(200)]
    r = anomaly.ranking_scores(series(spark, rows, cols=("z", "t")), K, "t").first()
    pos, neg = [abs(z) for z, t in rows if t], [abs(z) for z, t in rows if not t]
    assert r.roc_auc == pytest.approx(sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg))
    ap = sum(sum(p >= s for p in pos) / sum(abs(z) >= s for z, _ in rows) for s in pos) / len(pos)
    assert r.average_precision == pytest.approx(ap)


@pytest.mark.parametrize("n", [0, 1, 7, 150, 500])
def test_top_n_with_ties(spark, n):
    rng = random.Random(n)
    z = [float(rng.randint(-6, 6)) for _ in range(300)]
    got = column(anomaly.flag_top_n(series(spark, z, cols=("z",)), K, n, rules=RULES), "flagged_top")
    want = set(sorted(range(300), key=lambda i: (-abs(z[i]), i))[:n])
    assert got == [i in want for i in range(300)]


def brute_episodes(flags, gap=3):
    out = []
    for i in [i for i, f in enumerate(flags) if f]:
        if out and i - out[-1][-1] <= gap:
            out[-1].append(i)
        else:
            out.append([i])
    return [(e[0], e[-1], len(e)) for e in out]


@pytest.mark.parametrize("seed", [1, 2])
def test_episodes(spark, seed, monkeypatch):
    monkeypatch.setattr(anomaly, "POSITIONS_PER_SLICE", 16)     # episodes cross slice borders
    rng = random.Random(seed)
    flags = [rng.random() < 0.35 for _ in range(300)]
    d = series(spark, [(f, 4.0, 100.0) for f in flags], cols=("flagged", "z", "residual_w"))
    e = anomaly.episodes(d, K, rules=RULES).orderBy("start").collect()
    want = brute_episodes(flags)
    assert [r.intervals for r in e] == [n for _, _, n in want]
    assert [r.span_hours for r in e] == [pytest.approx((b - a + 1) / 6) for a, b, _ in want]
    assert [r.flagged_hours for r in e] == [pytest.approx(n / 6) for *_, n in want]
    assert [r.total_excess_kwh for r in e] == [pytest.approx(n * 0.1 / 6) for *_, n in want]


def test_a_hole_in_the_record_does_not_break_an_episode(spark):
    d = series(spark, [(True, 4.0, 1.0)] * 20, cols=("flagged", "z", "residual_w")).filter("i < 5 OR i > 14")
    assert anomaly.episodes(d, K, rules=RULES).count() == 1


def test_contamination(spark):
    d = series(spark, [100.0] * 50, cols=("power_w",)).withColumn("pos", F.col("i"))
    ev = spark.createDataFrame([("k", 1, "spike", 5, 3, 0.5), ("k", 2, "waste", 7, 12, 0.2), ("k", 3, "waste", 30, 4, 0.25)],
                               "key string, event_id bigint, type string, start_pos bigint, length int, magnitude double")
    kept = anomaly.drop_overlaps(ev, K)
    assert sorted(column(kept, "event_id", ("event_id",))) == [1, 3]
    out = anomaly.contaminate(d, kept, K)
    assert column(out, "power_w") == [150.0 if 5 <= i < 8 else 125.0 if 30 <= i < 34 else 100.0 for i in range(50)]
    assert sum(column(out, "is_anomaly")) == 7 and set(column(out, "anomaly_type")) == {"none", "spike", "waste"}
    flagged = out.withColumn("flagged", F.col("pos").isin(6, 40))
    r = {x.anomaly_type: x for x in anomaly.event_recall(flagged, K).collect()}
    assert (r["spike"].event_recall, r["waste"].event_recall) == (1.0, 0.0)
    t = {x.scope: x for x in anomaly.evaluate_by_type(flagged, K).collect()}
    assert (t["all"].n_anomaly_intervals, t["spike"].true_positives, t["spike"].true_negatives) == (7, 1, 42)


def test_hashed_events_fit_and_start_where_they_may(spark):
    d = series(spark, [100.0] * 400, cols=("power_w",)).withColumns({"pos": F.col("i"), "n_rows": F.lit(400)})
    ev = anomaly.hashed_events(d, K, F.col("i") % 4 == 0, 20, 15, attempts=1).collect()
    spikes, waste = [e for e in ev if e.type == "spike"], [e for e in ev if e.type == "waste"]
    assert (len(spikes), len(waste)) == (20, 15) and len({e.event_id for e in ev}) == 35
    assert all(1 <= e.length <= 3 and 0.5 <= e.magnitude <= 1 for e in spikes)
    assert all(12 <= e.length <= 36 and 0.15 <= e.magnitude <= 0.3 and e.start_pos % 4 == 0 for e in waste)
    assert all(e.start_pos + e.length <= 400 for e in ev)


def test_waste_is_drawn_again_until_enough_is_placed(spark):
    d = series(spark, [100.0] * 2000, cols=("power_w",)).withColumns({"pos": F.col("i"), "n_rows": F.lit(2000)})
    low = F.col("i") % 50 < 10
    placed = {}
    for attempts in (1, 50):
        e = anomaly.place_events(anomaly.hashed_events(d, K, low, 20, 30, attempts=attempts), K, 30).collect()
        rows = [p for x in e for p in range(x.start_pos, x.start_pos + x.length)]
        assert len(rows) == len(set(rows))
        placed[attempts] = sum(x.type == "waste" for x in e)
    assert placed[1] < 30 == placed[50]
    few = anomaly.place_events(anomaly.hashed_events(d, K, F.col("i") < 5, 20, 30), K, 30)
    assert few.filter("type = 'waste'").count() <= 1
    assert anomaly.place_events(anomaly.hashed_events(d.filter("i < 0"), K, low), K).count() == 0


def test_display_scores_use_the_test_scale(spark):
    d = series(spark, [(float(i % 7), "test" if i < 70 else "train") for i in range(140)], cols=("residual_w", "split"))
    d = d.withColumn("residual_w", F.when(F.col("split") == "train", F.col("residual_w") - 100).otherwise(F.col("residual_w")))
    out = anomaly.apply_test_scale(d, K)
    assert out.filter("split = 'train' AND band <> 'NORMAL'").count() == 0
    assert out.filter("residual_w = 3 AND z = 0").count() == 10
