"""Mixing sources to target weights by exact subset sums.

Documents are counted by exact length per source. Each source gets whole passes of all its
documents and a remaining budget; a proportional share of the lengths (every so many-th document in
the order of lengths, from a seeded start) fills all of it but `dp_words`, then a few of the longest until
at most `dp_words` are missing, and bounded-knapsack dynamic programming over the lengths left finds
the counts whose words fill the rest exactly. Where they do not, it is done again with eight times
as many words left to it, up to the whole budget, for which the best sum is certain. Which documents
of a length are taken is decided by a seeded hash: whole hash buckets, and the order inside the one
bucket where the count ends, so that no length or source meets in one task.

Null and empty texts have size 0 and are never taken by a remaining budget; null sources are one
source, the last. Rows that repeat a document are documents of their own. The plan of a source is
made from one row per distinct length, the targets from one row per source.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltloom.llm.rows import unwrapped, wrapped
from voltloom.llm.spans import flat, slices, word_spans
from voltloom.session import stage

WEIGHTS = (5.0, 2.0, 1.0)
BUCKETS = 256


def sizes(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """doc, version (hash of the text), source and size (words) of every row."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, 3):
                yield pa.record_batch([*part.columns[:3], pa.array(np.diff(word_spans(*flat(part.column(3)))[2]), pa.int64())],
                                      names=["doc", "version", "source", "size"])

    rows = docs.select(F.col(key).cast("bigint").alias("doc"), F.xxhash64(text).alias("version"),
                       F.col(source).alias("source"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc bigint, version bigint, source string, size bigint")


def share_out(total: float, weights: list[float], caps: list[float]) -> list[float]:
    """`total` by weight; what lies above a cap goes to the others by weight until none is above."""
    out, open_ = [0.0] * len(caps), list(range(len(caps)))
    while open_:
        unit = (total - sum(out)) / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > caps[i]]
        for i in full or open_:
            out[i] = caps[i] if full else unit * weights[i]
        open_ = [i for i in open_ if i not in set(full)] if full else []
    return out


def targets(sized: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target: one row per source."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order = sorted(range(len(pdf)), key=lambda i: (pd.isna(pdf["source"][i]), "" if pd.isna(pdf["source"][i]) else pdf["source"][i]))
        pdf = pdf.iloc[order].reset_index(drop=True)
        w = [weights[i % len(weights)] for i in range(len(pdf))]
        total = pdf["source_size"].tolist()
        pdf["target"] = share_out(share * sum(total), w, [most * x for x in total])
        return pdf[["source", "source_size", "target"]]

    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    return per.groupBy().applyInPandas(run, "source string, source_size bigint, target double")


def fill(budget: int, lengths: np.ndarray, counts: np.ndarray, dp_words: int, seed: int = 17) -> np.ndarray:
    """How many documents of each length make up `budget` words, or as near below as there is."""
    have = int((lengths * counts).sum())
    if budget <= 0 or not have:
        return np.zeros(len(lengths), np.int64)
    if budget >= have:
        return counts.copy()
    # in units that divide all lengths
    unit = int(np.gcd.reduce(lengths[(lengths > 0) & (counts > 0)]))
    lengths, budget = lengths // unit, budget // unit
    best, most, window = np.zeros(len(lengths), np.int64), 0, dp_words
    while most < budget:
        take = filled(budget, lengths, counts, window, seed)
        words = int((lengths * take).sum())
        if words > most:
            best, most = take, words
        if window >= budget:
            break
        window = 8 * max(1, window)
    return best


def filled(budget: int, lengths: np.ndarray, counts: np.ndarray, dp_words: int, seed: int) -> np.ndarray:
    """A proportional share, and the best choice for the (about) `dp_words` words that it leaves."""
    draw = np.random.Generator(np.random.PCG64([seed, len(lengths)]))
    order = np.argsort(-lengths, kind="stable")
    take, have, share = np.zeros(len(lengths), np.int64), int((lengths * counts).sum()), max(0, budget - dp_words)
    # whole-number arithmetic: sums may be beyond 2^53
    at = int(draw.random() * have) if share else 0
    for i in order:
        if lengths[i]:
            before, at = at, at + int(counts[i]) * share
            take[i] = at // have - before // have
    rest = budget - int((lengths * take).sum())
    for i in order[::-1]:  # the share may be over by less than the longest: back by the shortest that are enough
        if rest < 0 and take[i] and lengths[i] >= -rest:
            take[i] -= 1
            rest += int(lengths[i])
    for i in order:
        if rest >= 0:
            break
        k = min(int(take[i]), -(rest // int(lengths[i]))) if lengths[i] else 0
        take[i] -= k
        rest += k * int(lengths[i])
    for i in order:
        if rest <= dp_words:
            break
        size = int(lengths[i])
        if size:
            k = min(int(counts[i] - take[i]), rest // size, -(-(rest - dp_words) // size))
            take[i] += k
            rest -= k * size
    # in a random order, so that short documents are not preferred
    knapsack(rest, lengths, counts, take, draw.permutation(order))
    return take


def knapsack(rest: int, lengths: np.ndarray, counts: np.ndarray, take: np.ndarray, order: np.ndarray) -> None:
    """Adds to `take` documents that make up `rest` words, or as near below as those left can."""
    # the sums that some choice has, and the step that first reached each; the sum before that step is of earlier steps
    sums, first, steps = np.zeros(1, np.int64), np.full(1, -1, np.int32), []
    for i in order:
        size, left, power = int(lengths[i]), int(counts[i] - take[i]), 1
        left = min(left, rest // size) if size else 0
        while left and sums[-1] != rest:
            k = min(power, left)
            new = sums[:np.searchsorted(sums, rest - k * size, "right")] + k * size
            at = np.searchsorted(sums, new)
            fresh = sums[np.minimum(at, len(sums) - 1)] != new
            sums, first = np.insert(sums, at[fresh], new[fresh]), np.insert(first, at[fresh], len(steps))
            steps.append((i, k))
            left, power = left - k, power * 2
    got = int(sums[-1])
    while got:
        i, k = steps[first[np.searchsorted(sums, got)]]
        take[i] += k
        got -= k * int(lengths[i])


def plan(sized: DataFrame, goal: DataFrame, dp_words: int, seed: int) -> DataFrame:
    """source, size, passes (of all the source's documents) and n_more (documents of that size
    taken once more)."""
    counted = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    rows = counted.join(goal, counted["source"].eqNullSafe(goal["source"])).select(
        counted["source"], "size", "n", "source_size", "target")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        whole, goal_ = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        passes = math.floor(goal_ / whole) if whole else 0
        budget = min(whole, max(0, round(goal_ - passes * whole)))
        more = fill(budget, pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), dp_words, seed)
        return pd.DataFrame({"source": pdf["source"], "size": pdf["size"], "passes": passes, "n_more": more})

    return rows.groupBy("source").applyInPandas(run, "source string, size bigint, passes bigint, n_more bigint")


def copies(sized: DataFrame, planned: DataFrame, seed: int) -> DataFrame:
    """The rows of `sized` with the number of times the mix takes each."""
    d = sized.withColumn("_h", F.xxhash64(F.lit(seed), "doc", "version"))
    d = d.withColumn("_bucket", F.pmod(F.col("_h"), F.lit(BUCKETS)).cast("int"))
    key = ["source", "size", "_bucket"]
    n = d.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("source", "size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    n = n.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    p = planned.select(F.col("source").alias("_ps"), F.col("size").alias("_pz"), "passes", "n_more")
    n = n.join(p, n["source"].eqNullSafe(p["_ps"]) & (n["size"] == p["_pz"])).select(
        F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("_bucket").alias("_b"), "passes",
        F.least(F.greatest(F.col("n_more") - F.col("_before"), F.lit(0)), F.col("_n")).alias("_quota"), "_n")
    d = d.join(n, d["source"].eqNullSafe(n["_s"]) & (d["size"] == n["_z"]) & (d["_bucket"] == n["_b"])).drop("_s", "_z", "_b")
    part = d.filter("_quota > 0 and _quota < _n")
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("_h", "doc", "version"))
    part = part.withColumn("more", (rank <= F.col("_quota")).cast("bigint"))
    rest = d.filter("_quota = 0 or _quota = _n").withColumn("more", (F.col("_quota") > 0).cast("bigint"))
    out = rest.unionByName(part)
    return out.select(*sized.columns, (F.col("passes") + F.col("more")).alias("copies"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17,
        share: float = 1.5, most: float = 2.0, dp_words: int = 1 << 14) -> tuple[DataFrame, DataFrame]:
    """(doc, version, source, size, copies of every row; source, source_size, target)."""
    sized = stage(sizes(docs, key, text, source), "mix_sizes")
    goal = stage(targets(sized, share, most), "mix_targets")
    return copies(sized, stage(plan(sized, goal, dp_words, seed), "mix_plan"), seed), goal


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows, each as often as the mix takes it. Rows alike in key and text count alike."""
    counts, _ = mix(docs, key, text, source, **options)
    # equal rows may differ in their count: the sum is dealt out by number
    n = counts.groupBy("doc", "version").agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("alike"))
    rows = wrapped(docs, k=F.col(key).cast("bigint"), v=F.xxhash64(text))
    d = rows.join(n.filter("n > 0"), F.col("k").eqNullSafe(F.col("doc")) & (F.col("v") == F.col("version")))
    alone = d.filter("alike = 1").withColumn("i", F.lit(1))
    several = d.filter("alike > 1").withColumn("i", F.row_number().over(Window.partitionBy("k", "v").orderBy(F.xxhash64("row"))))
    times = F.expr("n div alike + if(i <= n % alike, 1, 0)")
    d = alone.unionByName(several).withColumn("times", times).filter("times > 0")
    return unwrapped(d.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times")))), docs)


def digests(docs: DataFrame) -> DataFrame:
    counts, goal = mix(docs)
    goal = goal.withColumnRenamed("source", "_gs")
    return counts.join(goal, counts["source"].eqNullSafe(goal["_gs"])).select(
        F.col("doc").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
