"""Quality rules whose cutoffs are chosen on labelled documents with a bound on false rejections.

Each rule scores a document (higher is worse) and rejects from some cutoff on. Per stratum, the
labelled good documents that pass the base rule are the holdout. Cutoffs are tested from the most
lenient to the strictest: one passes if the exact binomial tail says that a false-rejection rate
above its limit would show so few rejected good documents with a probability of at most its level;
the first that does not pass ends the sequence (fixed-sequence testing, so the cutoffs of one rule
need no correction among themselves). The limit alpha is divided by the number of rules, so it
holds for all rules of a stratum together; the level delta is divided by rules and strata
(Bonferroni), so all statements hold together with probability 1 - delta. Of the cutoffs that
pass, the one with the largest gap between the rejected shares of bad and good documents is used,
the most lenient of equals; a rule that has none rejects nothing.

Null and empty texts have no words and fail the base rule. A null stratum is one stratum. Several
labels of one document are reduced to the lowest; unlabelled documents and null labels take no
part in the choice. Strata without labels keep whatever passes the base rule.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltloom.llm.rows import unwrapped, wrapped
from voltloom.llm.spans import WHITE, coded, flat, slices, word_spans
from voltloom.session import stage

SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_marks", "n_upper")
#: name: (count, divided by, width of a bin); cutoffs lie at bin edges 1 to BINS, and the last bin is open.
BINS = 100
RULES: dict[str, tuple[str, str, float]] = {
    "symbols": ("n_symbols", "n_words", 0.05),
    "marks": ("n_marks", "n_words", 0.05),
    "upper": ("n_upper", "word_chars", 0.01),
    "dup_lines": ("n_dup_lines", "n_lines", 0.01),
    "repeats": ("n_repeat_words", "n_words", 0.01),
    "long_words": ("word_chars", "n_words", 0.25),
}


def flags(*values: int) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


def inside(hit: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many of `hit` lie in each span off[i] to off[i + 1]."""
    return np.diff(np.searchsorted(np.flatnonzero(hit), off))


def repeated(codes: np.ndarray, n_codes: int, bounds: np.ndarray) -> np.ndarray:
    """Per document, the words in 3-word windows that its text has twice or more."""
    n = len(codes)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    if n < 3:
        return np.zeros(len(bounds) - 1, np.int64)
    at = np.flatnonzero(doc[:-2] == doc[2:])
    a, b, c = (codes[at + k].astype(np.int64) for k in range(3))
    pair, n_pairs = a * n_codes + b, n_codes * n_codes
    if n_pairs * n_codes >= 1 << 62:
        order = np.sort(pair)
        order = order[np.concatenate(([True], order[1:] != order[:-1]))]
        pair = np.searchsorted(order, pair)
    key = pair * n_codes + c
    order = np.argsort(key, kind="stable")  # documents stay in order, so equal neighbours meet
    same = (key[order][1:] == key[order][:-1]) & (doc[at[order]][1:] == doc[at[order]][:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    word = np.zeros(n, bool)
    for k in range(3):
        word[at[twice] + k] = True
    return np.bincount(doc[word], minlength=len(bounds) - 1)


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    data, off = flat(column)
    solid = ~WHITE[data]
    starts, ends, bounds = word_spans(data, off)
    codes, distinct = coded(data[solid], np.concatenate(([0], np.cumsum(ends - starts))))
    # lines: cut at \n and at the documents' ends
    cuts = np.flatnonzero(data == 10)
    n_lines = np.diff(np.searchsorted(cuts, off)) + 1
    begin = np.sort(np.concatenate((off[:-1], cuts + 1)))
    end = np.sort(np.concatenate((off[1:], cuts)))
    owner = np.repeat(np.arange(len(off) - 1), n_lines)
    with_word = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    begin, end, owner = begin[with_word], end[with_word], owner[with_word]
    edges = np.empty(2 * len(begin), np.int64)
    edges[::2], edges[1::2] = begin, end
    lines = pa.Array.from_buffers(pa.large_binary(), max(0, 2 * len(begin) - 1), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
    line = lines.take(pa.array(np.arange(0, len(lines), 2))).dictionary_encode().indices.to_numpy()
    key = np.sort(owner * np.int64(len(line) + 1) + line)
    dup = np.flatnonzero(np.concatenate(([False], key[1:] == key[:-1])) if len(key) else np.empty(0, bool))
    dups = np.bincount(key[dup] // (len(line) + 1), minlength=len(off) - 1)
    return {"n_words": np.diff(bounds), "word_chars": inside(solid & ((data & 0xC0) != 0x80), off),
            "n_symbols": inside(flags(*SYMBOLS)[data], off), "n_lines": n_lines, "n_dup_lines": dups,
            "n_repeat_words": repeated(codes, len(distinct), bounds),
            "n_marks": inside(flags(33, 63)[data], off), "n_upper": inside((data >= 65) & (data <= 90), off)}


#: Bytes of text measured at once; the working arrays take some twenty times as much.
PART_BYTES = 4 << 20


def measures(docs: DataFrame, key: str, text: str, stratum: str) -> DataFrame:
    """doc, version (hash of the text), stratum, the MEASURES and base_failed of every row."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, 3, PART_BYTES):
                got = measure(part.column(3))
                yield pa.record_batch([*part.columns[:3], *(pa.array(got[m], pa.int64()) for m in MEASURES)],
                                      names=["doc", "version", "stratum", *MEASURES])

    rows = docs.select(F.col(key).cast("bigint").alias("doc"), F.xxhash64(text).alias("version"),
                       F.col(stratum).cast("string").alias("stratum"), F.col(text).alias("text"))
    out = rows.mapInArrow(run, "doc bigint, version bigint, stratum string, " + ", ".join(f"{m} bigint" for m in MEASURES))
    return out.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


def bin_of(rule: str) -> Column:
    part, whole, width = RULES[rule]
    return F.least(F.floor(F.try_divide(F.col(part), F.col(whole)) / width), F.lit(BINS)).cast("int")


def tail(rejected: int, n: int, rate: float) -> float:
    """P(at most `rejected` of n) if each is rejected with probability `rate`."""
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(rate) + (n - k) * math.log1p(-rate)
            for k in range(rejected + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def choose(good: list[int], bad: list[int], limit: float, level: float) -> int | None:
    """The cutoff (reject from this bin on) for counts by bin, or None."""
    n, n_bad, best, gap, g, b = sum(good), sum(bad), None, 0.0, 0, 0
    for cut in range(BINS, 0, -1):
        g, b = g + good[cut], b + bad[cut]
        # the tail only grows with g, and at g >= n * limit it is near one half
        if not n or g >= n * limit or tail(g, n, limit) > level:
            break
        if n_bad and b / n_bad - g / n > gap:
            best, gap = cut, b / n_bad - g / n
    return best


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float, delta: float, label_key: str, label: str) -> DataFrame:
    """stratum and one column per rule: the bin from which it rejects, null where it does not."""
    names = list(RULES)
    lowest = labels.filter(F.col(label).isNotNull()).groupBy(F.col(label_key).alias("_doc")).agg(F.min(label).alias("_good"))
    held = measured.filter("not base_failed").join(lowest, F.col("doc") == F.col("_doc"))
    rules = F.explode(F.array(*(F.struct(F.lit(i).alias("rule"), bin_of(r).alias("bin")) for i, r in enumerate(names))))
    counts = stage(held.select("stratum", "_good", rules.alias("r")).groupBy("stratum", "r.rule", "r.bin").agg(
        F.sum((F.col("_good") > 0).cast("bigint")).alias("good"), F.sum((F.col("_good") <= 0).cast("bigint")).alias("bad")), "quality_counts")
    level = delta / (len(names) * max(1, counts.select("stratum").distinct().count()))
    limit = alpha / len(names)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: dict = {"stratum": [pdf["stratum"].iloc[0]]}
        for i, r in enumerate(names):
            own, good, bad = pdf[pdf["rule"] == i], [0] * (BINS + 1), [0] * (BINS + 1)
            for b, g, n in zip(own["bin"], own["good"], own["bad"], strict=True):
                good[int(b)], bad[int(b)] = int(g), int(n)
            out[r] = pd.array([choose(good, bad, limit, level)], dtype="Int32")
        return pd.DataFrame(out)

    return counts.groupBy("stratum").applyInPandas(run, "stratum string, " + ", ".join(f"{r} int" for r in names))


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang",
          alpha: float = 0.03, delta: float = 0.1, label_key: str = "doc_id", label: str = "quality") -> DataFrame:
    """doc, version, stratum, MEASURES, base_failed and kept of every row of `docs`."""
    measured = stage(measures(docs, key, text, stratum), "quality_measures")
    cuts = stage(cutoffs(measured, labels, alpha, delta, label_key, label), "quality_cutoffs").withColumnRenamed("stratum", "_stratum")
    d = measured.join(cuts, measured["stratum"].eqNullSafe(cuts["_stratum"]), "left")
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | F.coalesce(bin_of(r) >= F.col(r), F.lit(False))
    return d.select(*measured.columns, (~F.col("base_failed") & ~rejected).alias("kept"))


def kept_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows that are kept, unchanged."""
    good = judge(docs, labels, key, text, **options).filter("kept").select("doc", "version").distinct()
    rows = wrapped(docs, k=F.col(key).cast("bigint"), v=F.xxhash64(text))
    return unwrapped(rows.join(good, F.col("k").eqNullSafe(F.col("doc")) & (F.col("v") == F.col("version")), "left_semi"), docs)


def digests(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, labels).select(F.col("doc").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                      "n_repeat_words", "base_failed", "kept")
