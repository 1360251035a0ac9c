"""The vector search over many blocks: against brute force, and what its plans leave to the driver."""

import numpy as np
import pytest

from voltloom.llm import vafile


def table(spark, ids, x, parts=3):
    rows = [(int(i), [float(v) / 1024 for v in r]) for i, r in zip(ids, x, strict=True)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(parts).cache()


def brute_force(ids, x, asked, k=10):
    x, out = x.astype(object), set()
    for q in set(ids[asked].tolist()):
        best = sorted((-int(x[j] @ x[i]), int(ids[i])) for j in np.flatnonzero(ids == q) for i in range(len(ids)) if ids[i] != q)[:k]
        out |= {(int(q), rank + 1, i, -s) for rank, (s, i) in enumerate(best)}
    return out


def drawn(kind):
    draw = np.random.default_rng(12)
    ids, x = np.arange(240), draw.integers(-300, 300, (240, 6))
    if kind == "repeats":
        ids[90:120], x[100:140] = 7, x[3]
    if kind == "near ties of large sums":  # scores of about 6e18 that differ by tens: neither single nor double precision tells them apart
        e = draw.integers(-20, 20, (240, 3))
        x = 10 ** 9 + np.concatenate((e, -e), 1)
    return ids, x


@pytest.mark.parametrize("kind", ["plain", "repeats", "near ties of large sums"])
def test_small_blocks_find_what_brute_force_finds(spark, monkeypatch, kind):
    for name, value in (("BLOCK", 7), ("QUERY_BLOCK", 3), ("HELD", 5)):
        monkeypatch.setattr(vafile, name, value)
    ids, x = drawn(kind)
    t = table(spark, ids, x)
    got = [tuple(r) for r in vafile.search(t, t.filter("vec_id % 7 = 0")).select("query_id", "rank", "id", "score").collect()]
    want = brute_force(ids, x, ids % 7 == 0)
    assert len(got) == len(want) and set(got) == want


def test_nothing_that_grows_with_the_table_is_broadcast(spark, monkeypatch):
    plans, stage = [], vafile.stage
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(vafile, "stage", lambda df, name: plan(df) or stage(df, name))
    ids, x = drawn("plain")
    t = table(spark, ids, x)
    out = vafile.search(t, t.filter("vec_id % 7 = 0"))
    plan(out)
    assert out.count() == 350 and len(plans) > 3
    assert not [p for p in plans if "Broadcast" in p]


def test_grid_copies_little_and_fits_tasks():
    dims = 64
    for vectors, parts in ((500, 12), (51_282, 12), (615_384, 600), (24_000_000, 600)):
        queries = vectors // 100
        columns, lines = vafile.grid(vectors, queries, dims, parts, cores=6)
        cells, asked = vectors * (dims + 16), queries * (2 * dims + 24)
        assert -(-cells // columns) <= vafile.TASK_BYTES and -(-asked // lines) <= vafile.TASK_BYTES
        assert lines * cells + columns * asked <= 4 * dims * vectors  # the bytes of the table
    assert vafile.grid(0, 0, 1, 4, 1) == (4, 1)
