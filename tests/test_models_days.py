"""Models against direct least squares, day profiles against NumPy."""

import hashlib
import random
from dataclasses import replace
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import series
from voltloom.config import DEFAULT_RULES, WEEKDAYS
from voltloom.operators import clusters, days, features, forest, models

RULES = replace(DEFAULT_RULES, segment_days=7)


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(4)
    rows = []
    for i in range(2600):
        occ, t = float(rng.randint(1, 30)), 15 + rng.random() * 20
        rows.append((200 + 4 * occ + 30 * ((i // 6) % 24) + rng.gauss(0, 20), occ, t))
    d = series(spark, rows, cols=("power_w", "occupancy", "temp_c"), key="x").withColumnRenamed("key", "building")
    d = features.add_calendar_features(d, None).withColumn("cdh", F.greatest(F.col("temp_c") - 24, F.lit(0.0)) / 6)
    return models.with_split(models.usable_frame(d.withColumn("usable", F.lit(True))), ["building"], rules=RULES).cache()


def design(pdf, train, numeric):
    cols = []
    for f in ("hour", "weekday", "month"):
        cols += [(pdf[f] == v).astype(float) for v in sorted(train[f].unique())[1:]]
    cols += [pdf[b].astype(float) for b in models.BINARIES]
    cols += [(pdf[x] - train[x].mean()) / train[x].std(ddof=0) for x in numeric]
    return np.column_stack(cols)


def test_split_sizes_use_the_published_arithmetic(frame):
    n = {r.split: r["count"] for r in frame.groupBy("split").count().collect()}
    total = 2600
    train = int(np.floor(0.7 * total))
    val = int(np.floor(0.15 / (1 - 0.7) * (total - train)))
    assert n == {"train": train, "validation": val, "test": total - train - val}
    even = 35188     # an even remainder: the share is just below one half
    assert (int(np.floor(0.15 / (1 - 0.7) * even)), even - int(np.floor(0.15 / (1 - 0.7) * even))) == (17593, 17595)


@pytest.mark.parametrize("name, numeric", [*models.TIME_MODELS.items(), *models.WEATHER_MODELS.items()])
def test_linear_models_match_a_direct_fit(frame, name, numeric):
    coefs = models.fit_linear(frame.filter("split = 'train'"), ["building"], {name: numeric})
    got = models.predict(frame, coefs, ["building"]).orderBy("ts").toPandas()
    train = got[got.split == "train"]
    x, y = design(train, train, numeric), train.power_w
    w = np.linalg.lstsq(x - x.mean(0), y - y.mean(), rcond=None)[0]
    want = (design(got, train, numeric) - x.mean(0)) @ w + y.mean()
    assert np.abs(got.predicted_w - want).max() < 1e-6


def test_scores_and_bias(frame):
    s = {(r.model, r.split): r for r in models.fit_and_score(frame, ["building"]).collect()}
    assert s[("C", "validation")].r2 > s[("B", "validation")].r2 > 0
    coefs = models.fit_linear(frame.filter("split = 'train'"), ["building"])
    p = models.with_bias(models.predict(frame, coefs, ["building"]), ["building"]).toPandas()
    val = p[(p.split == "validation") & (p.model == "C")]
    assert abs(val.residual_w.mean()) < 1e-9
    test = p[(p.split == "test") & (p.model == "C")]
    assert s[("C", "test_corrected")].mae_w == pytest.approx(test.residual_w.abs().mean())
    assert s[("C", "test_corrected")].r2 == pytest.approx(
        1 - (test.residual_w ** 2).sum() / ((test.power_w - test.power_w.mean()) ** 2).sum())


def test_folds_grow_and_are_scored(frame):
    train = frame.filter("split = 'train'").drop("pos", "n_rows")
    f = {r.fold: r["count"] for r in models.with_folds(train, ["building"], rules=RULES).groupBy("fold").count().collect()}
    n = int(np.floor(0.7 * 2600))     # 1819: the product is just below 1820
    size = n // 6
    assert f == {0: n - 5 * size, **{k: size for k in range(1, 6)}}
    cv = {r.model: r for r in models.cross_validate(train, ["building"], rules=RULES).collect()}
    assert cv["B"].folds == 5 and cv["C"].cv_mae_mean_w < cv["B"].cv_mae_mean_w


def test_polynomial_curve_matches_numpy(frame):
    got = {r.degree: r for r in models.polynomial_curve(frame, ["building"], 3).collect()}
    pdf = frame.toPandas()
    tr, va = pdf[pdf.split == "train"], pdf[pdf.split == "validation"]
    for deg in (1, 2, 3):
        w = np.polyfit(tr.occupancy, tr.power_w, deg)
        assert got[deg].train_mae_w == pytest.approx((tr.power_w - np.polyval(w, tr.occupancy)).abs().mean())
        assert got[deg].val_mae_w == pytest.approx((va.power_w - np.polyval(w, va.occupancy)).abs().mean())


def test_polynomials_of_many_distinct_and_of_few_values(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(20, 4, 3000)
    few = np.repeat([1.0, 2.0, 5.0], 200)
    rows = [("real", float(a), float(3 + a - 0.2 * a * a + e), "train" if i % 3 else "validation") for i, (a, e) in enumerate(zip(x, rng.normal(0, 1, 3000)))]
    rows += [("few", float(a), float(a * a + e), "train") for a, e in zip(few, rng.normal(0, 1, 600))] + [("few", 3.0, 9.0, "validation"), ("one", 2.0, 5.0, "train")]
    d = spark.createDataFrame(rows, "building string, occupancy double, power_w double, split string").repartition(4)
    got = {(r.building, r.degree): r for r in models.polynomial_curve(d, ["building"], 6).collect()}
    pdf = d.toPandas()
    for b, degrees in (("real", range(1, 7)), ("few", (1, 2))):
        tr, va = (pdf[(pdf.building == b) & (pdf.split == s)] for s in ("train", "validation"))
        for k in degrees:
            w = np.polyfit(tr.occupancy - 20, tr.power_w, k)
            assert got[b, k].train_mae_w == pytest.approx((tr.power_w - np.polyval(w, tr.occupancy - 20)).abs().mean())
            assert got[b, k].val_mae_w == pytest.approx((va.power_w - np.polyval(w, va.occupancy - 20)).abs().mean())
    assert got["few", 6].train_mae_w == pytest.approx(got["few", 2].train_mae_w) and got["few", 6].val_mae_w == pytest.approx(got["few", 2].val_mae_w)
    assert got["one", 6].train_mae_w == pytest.approx(0, abs=1e-9) and got["one", 6].val_mae_w is None


def plain_tree(d, depth):
    """Means of a tree's leaves by exhaustive search over the same columns, one node after the other."""
    out = np.empty(len(d))

    def node(rows, level):
        y, w = d.power_w.to_numpy()[rows], d.w.to_numpy()[rows]
        out[rows] = (w * y).sum() / w.sum()
        best = (1e-9, None)
        for inside in splits:
            a = inside[rows]
            if level == depth or w[a].sum() < 5 or w[~a].sum() < 5:
                continue
            sse = sum((w[m] * (y[m] - np.average(y[m], weights=w[m])) ** 2).sum() for m in (a, ~a))
            gain = ((w * (y - np.average(y, weights=w)) ** 2).sum() - sse) / scale
            if gain > best[0] + 1e-9:
                best = (gain, a)
        if best[1] is not None:
            node(rows[best[1]], level + 1)
            node(rows[~best[1]], level + 1)

    scale = (d.w * d.power_w).sum() ** 2 / d.w.sum()
    splits = [(d.hour == h).to_numpy() for h in range(1, 24)] + [(d.weekday == x).to_numpy() for x in WEEKDAYS[1:]]
    splits += [(d.month == m).to_numpy() for m in range(2, 13)] + [d[b].to_numpy(bool) for b in forest.BINARIES]
    splits += [(d.occupancy <= e).to_numpy() for e in sorted(set(np.quantile(d[d.split == "train"].occupancy, np.arange(1, 64) / 64)))]
    node(np.arange(len(d)), 0)
    return out


def test_a_tree_is_the_one_exhaustive_search_finds(frame):
    keys, d = ["building"], frame.orderBy("ts").toPandas()
    for seed in (1, 42):
        grown = forest.grow(frame, keys, trees=1, depths=(1, 3, 5), seed=seed)
        draw = [int(hashlib.md5(f"{seed}|{b}|{t:%Y-%m-%d %H:%M:%S}|0".encode()).hexdigest()[:4], 16) for b, t in zip(d.building, d.ts)]
        d["w"] = [sum(u >= p for p in forest.POISSON) if s == "train" else 0 for u, s in zip(draw, d.split)]
        for at, depth in enumerate((1, 3, 5)):
            got = forest.predictions(grown, frame, keys, at).orderBy("ts").toPandas().predicted_w
            assert got.to_numpy() == pytest.approx(plain_tree(d, depth))


def test_forests_of_two_buildings_beat_the_mean_and_name_their_features(frame, spark):
    both = frame.unionByName(frame.withColumn("building", F.lit("other")).withColumn("power_w", 2 * F.col("power_w")))
    only_test = frame.filter("split = 'test'").withColumn("building", F.lit("untrained"))
    trees = forest.grow(both.unionByName(only_test), ["building"], trees=10, depths=(2, 6, None))
    s = {(r.building, r.split): r for r in models.forest_scores(trees, both, ["building"], 1).collect()}
    names = {b for b, _ in s}
    assert len(names) == 2 and len(s) == 8
    for b in names:
        assert s[b, "validation"].r2 > 0 and s[b, "train"].r2 > s[b, "test"].r2 - 0.2
        own = forest.importances(trees, ["building"]).filter(F.col("building") == b).collect()
        assert sum(r.importance for r in own) == pytest.approx(1) and {r.feature for r in own} == set(forest.FEATURES)
    curve = {(r.building, r.max_depth): r for r in forest.depth_curve(trees, both, ["building"], (2, 6, None)).collect()}
    assert set(curve) == {(b, d) for b in names for d in ("2", "6", "unlimited")}
    assert all(curve[b, "2"].train_mae_w >= curve[b, "6"].train_mae_w >= curve[b, "unlimited"].train_mae_w for b in names)


def test_feature_ranking(frame):
    r = models.with_f_pvalue(models.select_features(frame.filter("split = 'train'"), ["building"])).toPandas()
    train = frame.filter("split = 'train'").toPandas()
    occ = r[r.feature == "occupancy"].iloc[0]
    c = np.corrcoef(train.occupancy, train.power_w)[0, 1]
    assert occ.correlation == pytest.approx(c) and occ.f_score == pytest.approx(c * c / (1 - c * c) * (len(train) - 2))
    assert r.kept.sum() == 15 and 0 <= occ.p_value < 1e-3
    assert "hour_0" not in set(r.feature) and "weekday_Friday" not in set(r.feature)


def test_usable_frame_keeps_rows_without_weather(spark):
    d = series(spark, [(1, 2, None), (None, 2, 20), (3, None, 20)], cols=("power_w", "occupancy", "temp_c"))
    d = features.add_calendar_features(d.withColumnRenamed("key", "building"), None)
    d = d.withColumns({"usable": F.lit(True), "cdh": F.lit(0.0)})
    assert models.usable_frame(d).count() == 1


# ----------------------------------------------------------------------- days
@pytest.fixture(scope="module")
def load(spark):
    rng = np.random.default_rng(3)
    m = 100 + rng.normal(0, 5, (40, 144)) + 50 * np.sin(np.arange(144) / 144 * np.pi) * rng.uniform(0.5, 1.5, (40, 1))
    d = series(spark, [float(v) for v in m.ravel()][5:], cols=("power_w",), start="2015-06-01 00:50:00", key="x")
    return m, d.withColumnRenamed("key", "building").withColumn("meter_off", F.lit(False)).cache()


def test_days_are_trimmed_and_flagged(load):
    m, d = load
    rows = days.day_rows(d)
    assert rows.count() == 39 and rows.filter("complete").count() == 39
    holes = days.day_rows(d.withColumn("power_w", F.when(F.col("i") != 500, F.col("power_w"))))
    assert holes.filter("NOT complete").count() == 1
    off = days.day_rows(d.withColumn("meter_off", F.col("i") == 500))
    assert off.filter("NOT complete").count() == 1


def test_components_match_numpy(load):
    m, d = load
    h = days.hourly(days.day_rows(d))
    mat = m[1:].reshape(39, 24, 6).mean(axis=2)
    got = np.array([r.hours for r in h.orderBy("date").collect()])
    assert np.allclose(got, mat)
    z = days.standardise(h)
    sc = (mat - mat.mean(0)) / mat.std(0, ddof=1)
    assert np.allclose(np.array([r.z for r in z.orderBy("date").collect()]), sc)
    pc = days.principal_components(z)
    rows = pc.orderBy("component").collect()
    values = np.sort(np.linalg.eigvalsh(np.cov(sc.T)))[::-1]
    assert np.allclose([r.eigenvalue for r in rows], values) and rows[-1].cumulative == pytest.approx(1)
    s = days.day_scores(z, pc, 3).orderBy("date").collect()
    v = np.array([r.loadings for r in rows[:3]]).T
    err = np.sqrt(((sc - sc @ v @ v.T) ** 2).mean(axis=1))
    assert np.allclose([r.reconstruction_error for r in s], err)
    assert np.allclose([r.pc1 for r in s], sc @ v[:, 0])
    flipped = days.align_signs(pc.withColumn("loadings", F.transform("loadings", lambda x: -x)), pc)
    assert np.allclose([r.loadings for r in flipped.orderBy("component").collect()], [r.loadings for r in rows])


def test_cluster_names(spark):
    flat = [100.0] * 24
    morning = [50.0] * 6 + [200.0] * 6 + [100.0] * 12
    noon = [50.0] * 9 + [400.0] * 4 + [500.0] * 5 + [50.0] * 6
    evening = [50.0] * 9 + [300.0] * 9 + [900.0] * 6
    rows = [(0, 5, flat), (1, 5, morning), (2, 5, evening), (3, 5, noon)]
    d = days.name_clusters(spark.createDataFrame(rows, "cluster int, days int, profile array<double>"))
    assert {r.cluster: r.name for r in d.collect()} == {
        0: "lowest load, flat all day", 1: "low load, morning peak", 3: "high load, daytime peak",
        2: "highest load, evening peak"}
    two = days.name_clusters(spark.createDataFrame(rows[:2], "cluster int, days int, profile array<double>"))
    assert sorted(r.name.split(",")[0] for r in two.collect()) == ["highest load", "lowest load"]


def test_day_types_cover_all_days(load):
    _, d = load
    z = days.standardise(days.with_labels(days.hourly(days.day_rows(d))))
    s = days.day_scores(z, days.principal_components(z))
    t = days.day_type_summary(days.day_types(s, 4)).collect()
    assert sum(r.days for r in t) == 39 and all(0 <= r.pct_weekend <= 100 for r in t)
    assert set(WEEKDAYS) >= {r.weekday for r in s.select("weekday").distinct().collect()}


def plain_lloyd(rows, k, seed):
    """(id, cluster) by the same start, one key at a time."""
    x = np.array([r[2:] for r in rows], float)
    h = [hashlib.md5(f"{seed}|{r[0]}|{r[1]}".encode()).hexdigest() for r in rows]
    centres = [x[min(range(len(x)), key=lambda j: h[j])]]
    for _ in range(k - 1):
        reach = [min(((p - c) ** 2).sum() for c in centres) for p in x]
        far = max(range(len(x)), key=lambda j: (reach[j], h[j]))
        if reach[far] > 0:
            centres.append(x[far])
    centres, before = np.array(centres), None
    while True:
        own = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        if before is not None and (own == before).all():
            return {r[1]: int(c) for r, c in zip(rows, own)}
        before = own
        centres = np.array([x[own == c].mean(0) if (own == c).any() else centres[c] for c in range(len(centres))])


def test_k_means_of_many_keys_is_each_ones_own(spark):
    rng = np.random.default_rng(8)
    rows = {b: [(b, i, float(u), float(v)) for i, (u, v) in enumerate(rng.normal(0, 1, (n, 2)) + 3 * rng.integers(0, 3, (n, 1)))]
            for b, n in (("a", 300), ("b", 41), ("c", 5), ("one", 1))}
    rows["same"] = [("same", i, 2.0, 2.0) for i in range(6)]  # fewer distinct points than clusters
    d = spark.createDataFrame([r for own in rows.values() for r in own] + [("a", 999, None, 1.0)], "b string, i int, u double, v double").repartition(5)
    got, centres = clusters.k_means(d, ["b"], ["u", "v"], "i", 4, 7)
    found = {}
    for r in got.collect():
        found.setdefault(r.b, {})[r.i] = r.cluster
    assert found == {b: plain_lloyd(own, 4, 7) for b, own in rows.items()}
    assert {(r.b, r.n) for r in centres.groupBy("b").agg(F.count("*").alias("n")).collect()} == {("a", 4), ("b", 4), ("c", 4), ("one", 1), ("same", 1)}



def test_mean_day_shape_query_keeps_buildings_of_a_short_month(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    start = datetime(2024, 1, 1, 0, 5)
    rows = []
    for meter, n_days in (("view", 25), ("purchase", 12)):
        for i in range(24 * n_days):
            at = start + timedelta(hours=i, minutes=45 if i == 24 * n_days - 1 else 0)
            rows.append((len(rows), at, i % 7, meter, 50.0 + i % 24 + i % 5, '{"k": 10}'))
    folder = str(tmp_path)
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").write.parquet(
        f"{folder}/events.parquet")
    got = entry.queries()["v10_mean_day_shape"](spark, folder).collect()
    shape = {r.hour: r for r in got if r.building == "B"}
    assert sorted(shape) == list(range(24)) and {r.days for r in shape.values()} == {25} and {r.reason for r in shape.values()} == {None}
    assert np.mean([r.relative for r in shape.values()]) == pytest.approx(1.0, abs=1e-5)
    assert [(r.days, r.hour, r.relative, r.reason) for r in got if r.building == "C"] == [(12, None, None, "fewer than 20 complete days")]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    want = con.sql(entry.oracle_sql()["v10_mean_day_shape"])
    order = [want.columns.index(c) for c in got[0].__fields__]
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())
