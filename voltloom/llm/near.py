"""Near-duplicate documents: MinHash tables from pairs of half keys, then exact links.

Tensored banding. Two collections of `halves` keys are made of `rows` minhashes each; every pair
of one key from either collection is a table key, so halves^2 tables cost 2 * halves * rows
minhashes. Two documents of similarity s share no table with probability below
2 * (1 - s^rows)^halves; with the 14 halves of 2 rows here that is 2e-5 at 0.75 and 1e-6 at 0.8,
and only pairs with no other chain of links are lost by it.

Documents with equal shingle sets are one class. Half keys that no other class has form no table
keys, which loses no pair. Classes that share a table, directly or by others, are a candidate
cluster; the links inside a cluster are decided on full shingle sets. A cluster of more than
`chunk` shingles is dealt by hash into chunks of about that many, and each two chunks meet in one
task, so no task takes an unbounded group and every pair of members meets. A task walks its
members: one is compared with all that are not reached yet, those linked to it are walked next,
and so on; it returns one link per member reached, never all pairs.

Rules. A-Z count as lower case. A set holds the distinct shingles of `width` words (of a shorter
text, all its words as one). Null, empty and blank texts have no shingles and no links. Rows that
repeat a document key count as one document, by the text with the smallest hash. Rows without a
key get no component and are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltloom.llm.components import components
from voltloom.llm.rows import unwrapped, wrapped
from voltloom.llm.spans import arrow_binary, flat, hashes, mixed, slices, words
from voltloom.session import stage

PRIME = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(column: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every document, and bounds."""
    codes, bounds, distinct = words(column, lower=True)
    word, n = hashes(distinct)[codes], np.diff(bounds)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    ends = np.cumsum(count)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    doc = np.repeat(np.arange(len(n)), count)
    first = np.arange(len(out)) - (ends - count)[doc] + bounds[:-1][doc]
    size = np.minimum(n, width)[doc]
    out[:] = size.astype(np.uint64)
    for k in range(width):
        on = size > k
        if on.all():
            out = out * PRIME + word[first + k]
        else:
            out[on] = out[on] * PRIME + word[first[on] + k]
    out = mixed(out)
    for s, e in zip((ends - count).tolist(), ends.tolist(), strict=True):
        out[s:e].sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    return out[fresh], np.concatenate(([0], np.cumsum(np.bincount(doc[fresh], minlength=len(n)))))


def half_keys(sets: np.ndarray, starts: np.ndarray, halves: int, rows: int, seed: int = 1) -> np.ndarray:
    """2 * halves keys of each non-empty set (first collection, then second)."""
    draw = np.random.Generator(np.random.PCG64(seed))
    keys = np.empty((len(starts), 2 * halves), np.uint64)
    for i in range(2 * halves):
        key = np.full(len(starts), i + 1, np.uint64)
        for _ in range(rows):
            flip, odd = draw.integers(0, 1 << 64, 2, np.uint64)
            key = mixed(key * PRIME + np.minimum.reduceat((sets ^ flip) * (odd | np.uint64(1)), starts))
        keys[:, i] = key
    return keys


def sketches(docs: DataFrame, key: str, text: str, width: int, halves: int, rows: int) -> DataFrame:
    """doc, version, n (shingles), f1, f2 (128 bits of the set), keys of every row."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, 2):
                sets, bounds = shingle_sets(part.column(2), width)
                n = np.diff(bounds)
                some = np.flatnonzero(n)
                keys = np.zeros((len(n), 2 * halves), np.uint64)
                f = np.zeros((2, len(n)), np.uint64)
                if len(some):
                    at = bounds[:-1][some]
                    keys[some] = half_keys(sets, at, halves, rows)
                    f[0, some] = np.add.reduceat(sets, at)
                    f[1, some] = np.add.reduceat(mixed(sets + PRIME), at)
                offsets = pa.array(np.arange(len(n) + 1, dtype=np.int32) * (2 * halves))
                yield pa.record_batch([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(f[0].view(np.int64)),
                                       pa.array(f[1].view(np.int64)),
                                       pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1).view(np.int64)))],
                                      names=["doc", "version", "n", "f1", "f2", "keys"])

    rows_ = docs.select(F.col(key).cast("bigint").alias("doc"), F.xxhash64(text).alias("version"), F.col(text).alias("text"))
    return rows_.mapInArrow(run, "doc bigint, version bigint, n bigint, f1 bigint, f2 bigint, keys array<bigint>")


def candidate_links(classes: DataFrame, halves: int) -> DataFrame:
    """rep, root: every class of a table with the smallest class of that table."""
    each = classes.select("rep", F.posexplode("keys").alias("i", "half"))
    shared = each.groupBy("half").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("half")
    left = each.join(shared, "half", "left_semi").groupBy("rep").agg(F.collect_list(F.struct("i", "half")).alias("x"))
    side = f"i < {halves}"
    tables = left.select("rep", F.expr(f"filter(x, y -> y.{side})").alias("a"), F.expr(f"filter(x, y -> not y.{side})").alias("b"))
    keyed = stage(tables.select("rep", F.explode("a").alias("a"), "b").select("rep", "a", F.explode("b").alias("b"))
                  .select("rep", F.xxhash64("a.half", "b.half").alias("table")), "near_tables")
    roots = keyed.groupBy("table").agg(F.min("rep").alias("root"), F.max("rep").alias("last")).filter("root <> last")
    return keyed.join(roots.select("table", "root"), "table").filter("rep <> root").select("rep", "root").distinct()


def alike(inter: np.ndarray, a: np.ndarray, b: int, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (a + b - inter)


def reached(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the first of the sets it is linked with, directly or by others."""
    root = np.arange(len(sets))
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    if len(sets) == 2:
        both = np.sort(np.concatenate(sets))
        if alike(np.count_nonzero(both[1:] == both[:-1]), size[0], size[1], percent):
            root[1] = 0
        return root
    values = np.concatenate(sets)
    distinct = np.sort(values)
    distinct = distinct[np.concatenate(([True], distinct[1:] != distinct[:-1]))]
    codes = np.searchsorted(distinct, values)
    # a set whose shingles others have too few of is linked with none of them
    left = np.arange(len(sets))
    while True:
        starts = np.cumsum(size[left]) - size[left]
        often = np.bincount(codes, minlength=len(distinct))
        stay = 100 * np.add.reduceat((often > 1)[codes].astype(np.int64), starts) >= percent * size[left]
        if stay.all():
            break
        codes, left = codes[np.repeat(stay, size[left])], left[stay]
        if not len(left):
            return root
    own = {int(i): codes[s:s + size[i]] for i, s in zip(left, starts, strict=True)}
    seen, queue = np.zeros(len(distinct), bool), []
    while len(left):
        if not queue:
            queue, base = [int(left[0])], int(left[0])
            codes, left = codes[size[left[0]]:], left[1:]
            continue
        one = queue.pop()
        seen[own[one]] = True
        inter = np.add.reduceat(seen[codes].astype(np.int64), np.cumsum(size[left]) - size[left])
        seen[own[one]] = False
        hit = alike(inter, size[left], int(size[one]), percent)
        if hit.any():
            root[left[hit]] = base
            queue += left[hit].tolist()
            codes, left = codes[np.repeat(~hit, size[left])], left[~hit]
    return root


def exact_links(docs: DataFrame, clusters: DataFrame, key: str, text: str, width: int, percent: int, chunk: int) -> DataFrame:
    """rep, root: links by full sets. `clusters`: rep, version, n, cluster."""
    sizes = stage(clusters.groupBy("cluster").agg(F.sum("n").alias("total")), "near_clusters")
    bins = max(1, int((sizes.agg(F.sum("total")).first()[0] or 0) // chunk))
    m = clusters.join(sizes, "cluster").withColumn("parts", F.ceil(F.col("total") / chunk))
    rows = docs.select(F.col(key).cast("bigint").alias("rep"), F.xxhash64(text).alias("version"), F.col(text).alias("text")).join(
        m, ["rep", "version"]).select("rep", "cluster", "parts", "text")

    def sets(batches):
        for batch in batches:
            for part in slices(batch, 3):
                got, bounds = shingle_sets(part.column(3), width)
                yield pa.record_batch([*part.columns[:3], arrow_binary(got.view(np.uint8), bounds * 8).cast(pa.binary())],
                                      names=["rep", "cluster", "parts", "shingles"])

    # a chunk meets each other chunk of its cluster; small clusters share bins
    made = rows.mapInArrow(sets, "rep bigint, cluster bigint, parts bigint, shingles binary").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")))
    small = F.col("parts") == 1
    others = F.when(small, F.array(F.lit(-1).cast("bigint"))).otherwise(F.array_remove(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1), F.col("own")))
    dealt = made.withColumn("other", F.explode(others)).select(
        F.when(small, F.pmod(F.xxhash64("cluster"), F.lit(bins))).otherwise(F.col("cluster")).alias("g"),
        F.when(small, -1).otherwise(F.least("own", "other")).alias("i"), F.when(small, -1).otherwise(F.greatest("own", "other")).alias("j"),
        "rep", "cluster", "shingles")

    def verify(table: pa.Table) -> pa.Table:
        rep, cluster = table.column("rep").to_numpy(), table.column("cluster").to_numpy()
        data, off = flat(table.column("shingles"))
        order = np.lexsort((rep, cluster))
        cuts = np.flatnonzero(np.diff(cluster[order])) + 1
        a, b = [], []
        for group in np.split(order, cuts):
            group = group[np.concatenate(([True], rep[group][1:] != rep[group][:-1]))]
            if len(group) < 2:
                continue
            root = reached([data[off[k]:off[k + 1]].view(np.uint64) for k in group], percent)
            hit = np.flatnonzero(root != np.arange(len(root)))
            a.append(rep[group[hit]])
            b.append(rep[group[root[hit]]])
        none = [np.empty(0, np.int64)]
        return pa.table({"rep": np.concatenate(a or none), "root": np.concatenate(b or none)})

    return dealt.groupBy("g", "i", "j").applyInArrow(verify, "rep bigint, root bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75,
                    halves: int = 14, rows: int = 2, chunk: int = 1 << 20) -> DataFrame:
    """doc, version (hash of the text), n_shingles, component (smallest document reached) and kept of every row."""
    made = stage(sketches(docs, key, text, width, halves, rows), "near_sketches")
    one = made.filter("doc is not null").groupBy("doc").agg(F.min_by(F.struct("version", "n", "f1", "f2", "keys"), "version").alias("s")).select("doc", "s.*")
    one = stage(one, "near_documents")
    classes = stage(one.filter("n > 0").groupBy("f1", "f2", "n").agg(
        F.min("doc").alias("rep"), F.min_by(F.struct("version", "keys"), "doc").alias("s")).select("f1", "f2", "n", "rep", "s.*"), "near_classes")
    clusters = components(candidate_links(classes, halves), "rep", "root")
    members = stage(classes.select("rep", "version", "n").join(clusters.withColumnRenamed("component", "cluster"), F.col("rep") == F.col("node"))
                    .select("rep", "version", "n", "cluster"), "near_members")
    found = components(exact_links(docs, members, key, text, width, percent, chunk), "rep", "root")
    roots = classes.select("f1", "f2", F.col("n").alias("_n"), "rep").join(
        found, F.col("rep") == F.col("node"), "left").select("f1", "f2", "_n", F.coalesce("component", "rep").alias("component"))
    by_doc = one.select("doc", "f1", "f2", "n").join(
        roots, (one["f1"] == roots["f1"]) & (one["f2"] == roots["f2"]) & (one["n"] == roots["_n"]), "left").select(
        F.col("doc").alias("_doc"), F.coalesce("component", "doc").alias("component"))
    out = made.select("doc", "version", F.col("n").alias("n_shingles")).join(by_doc, F.col("doc") == F.col("_doc"), "left")
    return out.select("doc", "version", "n_shingles", "component",
                      F.coalesce(F.col("doc") == F.col("component"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows whose document is the smallest of its component, unchanged."""
    good = near_duplicates(docs, key, text, **options).filter("kept").select("doc", "version").distinct()
    rows = wrapped(docs, k=F.col(key).cast("bigint"), v=F.xxhash64(text))
    return unwrapped(rows.join(good, F.col("k").eqNullSafe(F.col("doc")) & (F.col("v") == F.col("version")), "left_semi"), docs)


def digests(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS x FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(x) = 0 THEN [] WHEN len(x) < 5 THEN [array_to_string(x, ' ')]
        ELSE [array_to_string(x[i:i + 4], ' ') FOR i IN range(1, len(x) - 3)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * m >= 75 * (na.n + nb.n - m)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
FROM documents d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""
