"""The interval join and the keyed samples against direct computation."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from voltloom.operators import intervals, ranks, samples

INF = float("inf")


def brute(points, spans, keyed):
    return sorted((p[0], s[0]) for p in points for s in spans if p[2] is not None and None not in s[2:]
                  and (not keyed or (p[1] is not None and p[1] == s[1])) and s[2] <= p[2] < s[3])


@pytest.mark.parametrize("width", [None, 0.3, 50.0])
@pytest.mark.parametrize("keyed", [False, True])
def test_overlapping_intervals_of_any_length(spark, width, keyed):
    rng = random.Random(3)
    points = [(i, rng.choice("ab"), rng.choice([round(rng.uniform(-20, 20), 1), 5.0])) for i in range(300)]
    points += [(900, "a", None), (901, None, 5.0)]
    spans = [(100 + i, rng.choice("ab"), a, a + rng.choice([0.1, 1.0, 30.0, 0.0, -2.0]))
             for i in range(40) for a in [round(rng.uniform(-20, 20), 1)]]
    spans += [(200, "a", -INF, 0.0), (201, "b", 3.0, INF), (202, "a", -INF, INF), (203, "a", None, 1.0), (204, None, 0.0, 9.0), (100, "a", 0.0, 9.0)]
    p = spark.createDataFrame(points, "i int, k string, x double")
    s = spark.createDataFrame(spans, "j int, k string, lo double, hi double")
    s = s if keyed else s.withColumnRenamed("k", "other")
    got = intervals.covering(p, s, "x", "lo", "hi", ["k"] if keyed else None, width)
    want = brute(points, spans, keyed)
    assert sorted((r.i, r.j) for r in got.collect()) == want
    left = intervals.covering(p, s, "x", "lo", "hi", ["k"] if keyed else None, width, "left")
    hit = {i for i, _ in want}
    assert sorted((r.i, r.j or 0) for r in left.collect()) == sorted(want + [(q[0], 0) for q in points if q[0] not in hit])


def test_intervals_of_stamps_and_none_at_all(spark):
    p = spark.range(288).select("id", (F.lit("2015-06-01").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("id") * 10).cast("int"))).alias("ts"))
    s = spark.createDataFrame([("a", "2015-06-01 00:05:00", "2015-06-01 01:00:00"), ("b", "2015-06-01 00:50:00", "2015-07-01 00:00:00")], "e string, a string, b string")
    s = s.select("e", F.col("a").cast("timestamp_ntz").alias("a"), F.col("b").cast("timestamp_ntz").alias("b"))
    got = intervals.covering(p, s, "ts", "a", "b")
    assert {r.e: r["count"] for r in got.groupBy("e").count().collect()} == {"a": 5, "b": 283}
    assert got.columns == ["id", "ts", "e", "a", "b"]
    assert intervals.covering(p, s.limit(0), "ts", "a", "b").count() == 0
    assert intervals.covering(p, s.limit(0), "ts", "a", "b", how="left").count() == 288
    assert intervals.covering(p.limit(0), s, "ts", "a", "b").count() == 0
    days = intervals.covering(p.select("id", F.to_date("ts").alias("d")), s.select("e", F.to_date("a").alias("a"), F.to_date("b").alias("b")), "d", "a", "b")
    assert days.groupBy("e").count().collect()[0]["count"] == 288       # a begins and ends on one day: empty
    with pytest.raises(ValueError, match="both sides"):
        intervals.covering(p, s.withColumnRenamed("e", "ID"), "ts", "a", "b")


def digest(*parts):
    return hashlib.md5("|".join(map(str, ("42", *parts))).encode()).hexdigest()[:15]


def test_lowest_hashes_per_key_and_merged_chunks(spark):
    rows = [("a" if i % 3 else None if i % 2 else "b", i) for i in range(3000)] + [("c", 1), ("c", 1), ("c", 2)]
    d = spark.createDataFrame(rows, "k string, i int")
    got = samples.sample(d, ["i"], 50, ["k"])
    want = []
    for k in ("a", "b", None, "c"):
        want += [(k or "", i) for _, i in sorted((digest(i), i) for q, i in rows if q == k)[:50]]
    plain = lambda x: sorted((r.k or "", r.i) for r in x.collect())
    assert plain(got) == sorted(want)
    chunks = [samples.sample(d.filter(F.col("i") % 4 == n), ["i"], 50, ["k"]) for n in range(4)]
    assert plain(samples.merge_samples(chunks, ["i"], 50, ["k"])) == sorted(want)
    whole = samples.sample(d, ["i", "k"], 20)
    order = sorted((digest(i, "\\" if k is None else k), i, k or "") for k, i in rows)[:20]
    assert plain(whole) == sorted((k, i) for _, i, k in order)
    assert samples.sample(d.limit(0), ["i"], 5).count() == 0 and samples.sample(d, ["i"], 10_000).count() == len(rows)
    assert samples.sample(d.limit(0), ["i"], 5, ["k"]).count() == 0


@pytest.mark.parametrize("bound", [0, 3, 1 << 16])
def test_ranks_whatever_bins_are_cut(spark, monkeypatch, bound):
    """Bins sorted whole, cut into parts, or some of each, give the same totals."""
    monkeypatch.setattr(ranks, "LARGE_BIN", bound)
    rng = random.Random(8)
    values = [rng.choice([100 + rng.random() / 10, -5.0, 0.0, rng.gauss(0, 9), 100.05]) for _ in range(800)]
    d = spark.createDataFrame([(v, float(n)) for n, v in enumerate(values)], "value double, x double")
    got = {r._v: (r.before, r.x_before) for r in ranks.ranked_values(d, [], "value", {"x": F.col("x")}).collect()}
    for v in set(values):
        below = [n for n, u in enumerate(values) if u < v]
        assert got[v] == (len(below), sum(below))
    q = ranks.quantiles(d, [], "value", {"a": 0.3, "b": 0.77}).first()
    import numpy as np
    assert (q.a, q.b) == pytest.approx((np.quantile(values, 0.3), np.quantile(values, 0.77)), rel=1e-12)
