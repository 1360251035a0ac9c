"""Toxicity by a convolutional text classifier, trained in NumPy and applied by Spark.

Words and their beginnings of 4 and 6 code points are hashed to BUCKETS rows of an embedding, and a
word is the sum of its three rows; only rows that two or more documents of the sample use are kept and
trained, all others are zero. Filters over one, two and three neighbouring words,
the largest answer of each filter over the whole text, and a logistic layer give the score. A text of
any length is read whole. The first number of a row starts as its words' standardised excess in
toxic documents, the rest as small random numbers; then all weights learn by Adam on small batches,
until the loss on documents left out of the fit no longer falls.

The fit reads a bounded sample: at most `sample` labelled documents in order of a hash, none over
DOC_BYTES and at most SAMPLE_BYTES together, in one task. The model is a few MB at most (its words
occur in the sample) and goes to the workers as a broadcast; all documents are scored where they are read.

Thresholds by language come from all labelled documents that were kept for it (a fifth, by hash; the
fit never learns from them): counts by language and score, and of all cuts the one with the best F1.
Languages with fewer than LEAST_LABELS of either label take the cut of all languages together. The
language is no input of a score.

Rules. Words are runs of ASCII letters and digits and of other than ASCII, A-Z and U+00C0 to U+00DE in
lower case. Null and
empty texts are one unknown word and get a score like any other. Null keys have no labels and are not
held out. Of several labels of a document the highest counts; null labels take no part. Rows that
repeat a key are scored each by itself; equal rows are fitted once. Without labels of both kinds every
score is (toxic + 1) / (labelled + 4). Only the columns named are read, so others never clash.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltloom.llm.spans import BASE, Coded, coded, flat, lowered, mixed, pack, powers, run_spans, slices, unique, unpack
from voltloom.session import stage

BUCKETS = 1 << 22
#: A word's rows: of itself, and of its beginnings of so many code points.
BEGINNINGS = (4, 6)
#: Numbers of an embedding, filters of each width, widths.
DIMENSIONS, FILTERS, WIDTHS = 16, 8, (1, 2, 3)
#: The sample: documents, bytes of one, bytes together.
SAMPLE, DOC_BYTES, SAMPLE_BYTES = 8192, 1 << 18, 48 << 20
BATCH, STEPS, EPOCHS, EVERY, PATIENCE, RATE, SMOOTH = 64, 1200, 40, 80, 4, 0.01, 0.01
LEAST_LABELS = 20
#: Text scored at once.
PART_BYTES = 4 << 20
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Model(NamedTuple):
    buckets: np.ndarray     # sorted; row i + 1 of the embedding is theirs, row 0 is zero
    embedding: np.ndarray   # (words + 1, DIMENSIONS)
    filters: np.ndarray     # (taps, DIMENSIONS, FILTERS), taps of width 1, then 2, ...
    shift: np.ndarray       # (widths * FILTERS)
    weights: np.ndarray     # (widths * FILTERS)
    bias: np.ndarray        # (1)

    def packed(self) -> bytes:
        return pack(*(a.reshape(-1) for a in self))

    @staticmethod
    def unpacked(value: bytes) -> Model:
        b, e, f, s, w, c = unpack(value)
        return Model(b, e.reshape(-1, DIMENSIONS), f.reshape(-1, DIMENSIONS, FILTERS), s, w, c)


def words(column: pa.Array) -> Coded:
    """The words of every document, dictionary-coded."""
    data, off = flat(column)
    solid = WORD[data]
    starts, ends, bounds = run_spans(solid, off)
    low = lowered(data)
    after = np.concatenate(([False], low[:-1] == 0xC3)) if len(low) else solid
    low = np.where(after & (low < 0x9F) & (low != 0x97), low + np.uint8(32), low)
    codes, distinct = coded(low[solid], np.concatenate(([0], np.cumsum(ends - starts))))
    return Coded(codes, bounds, distinct)


def buckets_of(distinct: pa.Array) -> np.ndarray:
    """The buckets of words (words, rows of a word), by fingerprints of the word and of its beginnings."""
    data, off = flat(distinct)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)))))
    back = powers(pow(BASE, -1, 1 << 64), len(data) + 1)[off[:-1]]
    points = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    first = np.searchsorted(points, off)
    ends = [off[1:], *(points[np.minimum(first[:-1] + k, first[1:])] for k in BEGINNINGS)]
    return np.stack([(mixed((sums[e] - sums[off[:-1]]) * back + np.uint64(i)) % np.uint64(BUCKETS)).astype(np.int64) for i, e in enumerate(ends)], 1)


def padded(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embedding rows with zeros after each document, as many as the widest filter reaches beyond its
    first word; where documents start and end. An empty document is one zero."""
    n = np.diff(bounds)
    size = np.maximum(n, 1)
    starts = np.cumsum(size + WIDTHS[-1] - 1) - (size + WIDTHS[-1] - 1)
    out = np.zeros((int((size + WIDTHS[-1] - 1).sum()), *ids.shape[1:]), np.int64)
    out[np.arange(len(ids)) + np.repeat(starts - bounds[:-1], n)] = ids
    return out, starts, starts + size


def taps():
    """(width's number, tap's number, words after the first) of every tap."""
    t = 0
    for w, width in enumerate(WIDTHS):
        for j in range(width):
            yield w, t, j
            t += 1


def tops(vectors: np.ndarray, filters: np.ndarray, at: np.ndarray, starts: np.ndarray, ends: np.ndarray, where: bool = False) -> np.ndarray:
    """The largest answer of every filter in each document (or the place of it) whose words are vectors[at]."""
    out = []
    for own in WIDTHS:
        first = sum(w for w in WIDTHS if w < own)
        answer = (vectors @ filters[first])[at]
        for j in range(1, own):
            answer[:len(at) - j] += (vectors @ filters[first + j])[at[j:]]
        out.append(np.stack([s + answer[s:e].argmax(0) if where else answer[s:e].max(0) for s, e in zip(starts, ends, strict=True)]))
    return np.hstack(out)


def scores(model: Model, codes: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Scores of documents given as places in `rows`, the embedding rows of distinct words."""
    if len(bounds) == 1:
        return np.empty(0)
    vectors = np.concatenate((np.zeros((1, DIMENSIONS), np.float32), model.embedding[rows].sum(1)))
    top = tops(vectors, model.filters, *padded(codes + 1, bounds))
    logit = np.maximum(top + model.shift, 0) @ model.weights + model.bias[0]
    return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -30, 30)))


def constant(labels: np.ndarray) -> Model:
    p = (labels.sum() + 1) / (len(labels) + 4)
    none = np.zeros(len(WIDTHS) * FILTERS, np.float32)
    return Model(np.empty(0, np.int64), np.zeros((1, DIMENSIONS), np.float32), np.zeros((sum(WIDTHS), DIMENSIONS, FILTERS), np.float32),
                 none, none, np.array([np.log(p / (1 - p))], np.float32))


def loss(p: np.ndarray, y: np.ndarray) -> float:
    p = np.clip(p, 1e-7, 1 - 1e-7)
    return float(-np.mean(np.where(y, np.log(p), np.log(1 - p))))


class Adam:
    def __init__(self, a: np.ndarray, rate: float = RATE):
        self.a, self.rate, self.m, self.v, self.t = a, rate, np.zeros_like(a), np.zeros_like(a), 0

    def step(self, gradient: np.ndarray, rows=slice(None)) -> None:
        self.t += 1
        self.m[rows] = 0.9 * self.m[rows] + 0.1 * gradient
        self.v[rows] = 0.99 * self.v[rows] + 0.01 * gradient * gradient
        self.a[rows] -= self.rate * self.m[rows] / (1 - 0.9 ** self.t) / (np.sqrt(self.v[rows] / (1 - 0.99 ** self.t)) + 1e-7)


def fitted(codes: np.ndarray, bounds: np.ndarray, buckets: np.ndarray, labels: np.ndarray, held: np.ndarray) -> Model:
    """A model of documents (places in `buckets`, those of distinct words) that are not `held`; those say when to stop."""
    if labels[~held].all() or not labels[~held].any():
        return constant(labels)
    n, doc = len(labels), np.repeat(np.arange(len(labels)), np.diff(bounds))
    word, doc = np.divmod(unique(codes * np.int64(n) + doc), n)
    bucket, doc = np.divmod(unique((buckets[word] * n + doc[:, None]).reshape(-1)), n)
    known, counts = np.unique(bucket, return_counts=True)
    known = known[counts > 1]
    at = np.searchsorted(known, bucket)
    ok = ~held[doc] & (known[np.minimum(at, len(known) - 1)] == bucket) if len(known) else held[doc] & False
    toxic = np.bincount(at[ok], labels[doc[ok]], len(known))
    seen = np.bincount(at[ok], minlength=len(known))
    rate = labels[~held].mean()
    draw = np.random.default_rng(17)
    model = Model(known, draw.normal(0, 0.05, (len(known) + 1, DIMENSIONS)).astype(np.float32),
                  draw.normal(0, 0.2, (sum(WIDTHS), DIMENSIONS, FILTERS)).astype(np.float32),
                  np.zeros(len(WIDTHS) * FILTERS, np.float32), draw.normal(0, 0.2, len(WIDTHS) * FILTERS).astype(np.float32),
                  np.array([np.log(rate / (1 - rate))], np.float32))
    model.embedding[1:, 0] = np.clip((toxic - rate * seen) / np.sqrt(np.maximum(seen, 1) * rate * (1 - rate)) / 5, -1, 3)
    model.embedding[0] = 0
    rows = embedding_rows(model, buckets)
    parts = [np.flatnonzero(~held), np.flatnonzero(held) if held.any() else np.flatnonzero(~held)]
    watch, watch_bounds = picked(codes, bounds, parts[1])
    learn = [Adam(a) for a in model[1:]]
    best, best_loss, bad, order = model, np.inf, 0, np.empty(0, np.int64)
    for step in range(min(STEPS, max(EVERY * PATIENCE, EPOCHS * len(parts[0]) // BATCH))):
        if step % EVERY == 0:
            now = loss(scores(model, watch, watch_bounds, rows), labels[parts[1]])
            if now < best_loss - 1e-5:
                best, best_loss, bad = Model(*(a.copy() for a in model)), now, 0
            elif (bad := bad + 1) >= PATIENCE:
                break
        if len(order) < BATCH:
            order = np.concatenate((order, draw.permutation(parts[0])))
        batch, order = order[:BATCH], order[BATCH:]
        for a, gradient in zip(learn, gradients(model, *picked(codes, bounds, batch), rows, labels[batch]), strict=True):
            a.step(*gradient)
        model.embedding[0] = 0
    return best


def picked(codes: np.ndarray, bounds: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (np.concatenate([codes[bounds[d]:bounds[d + 1]] for d in docs] or [codes[:0]]).astype(np.int64),
            np.concatenate(([0], np.cumsum(bounds[docs + 1] - bounds[docs]))))


def gradients(model: Model, codes: np.ndarray, bounds: np.ndarray, word_rows: np.ndarray, labels: np.ndarray):
    """Of the mean loss, for each array of the model after the buckets; the embedding's as (values, rows)."""
    some, codes = np.unique(codes, return_inverse=True)
    some_rows = np.concatenate((np.zeros((1, word_rows.shape[1]), np.int64), word_rows[some]))
    vectors = model.embedding[some_rows].sum(1)
    words_at, starts, ends = padded(codes + 1, bounds)
    top = tops(vectors, model.filters, words_at, starts, ends, where=True)
    before = np.empty(top.shape, np.float32)
    for w in range(len(WIDTHS)):
        own = slice(w * FILTERS, (w + 1) * FILTERS)
        before[:, own] = model.shift[own] + sum(np.einsum("bfd,df->bf", vectors[words_at[top[:, own] + j]], model.filters[t]) for v, t, j in taps() if v == w)
    hidden = np.maximum(before, 0)
    p = 1 / (1 + np.exp(-np.clip(hidden @ model.weights + model.bias[0], -30, 30)))
    aim = SMOOTH + (1 - 2 * SMOOTH) * labels
    d_logit = ((p - aim) / len(labels)).astype(np.float32)
    d_hidden = d_logit[:, None] * model.weights * (before > 0)
    d_filters, touched, d_touched = np.empty_like(model.filters), [], []
    for w, t, j in taps():
        own = slice(w * FILTERS, (w + 1) * FILTERS)
        at, d = top[:, own] + j, d_hidden[:, own]
        d_filters[t] = np.einsum("bfd,bf->df", vectors[words_at[at]], d)
        touched.append(some_rows[words_at[at]].reshape(-1))
        d_touched.append(np.repeat((d[..., None] * model.filters[t].T).reshape(-1, DIMENSIONS), some_rows.shape[1], 0))
    used, which = np.unique(np.concatenate(touched), return_inverse=True)
    d_embedding = np.zeros((len(used), DIMENSIONS), np.float32)
    np.add.at(d_embedding, which, np.concatenate(d_touched))
    return (d_embedding, used), (d_filters,), (d_hidden.sum(0),), (hidden.T @ d_logit,), (d_logit.sum(keepdims=True),)


def embedding_rows(model: Model, buckets: np.ndarray) -> np.ndarray:
    """The rows of buckets, 0 where the model has none."""
    if not len(model.buckets):
        return np.zeros(buckets.shape, np.int64)
    at = np.minimum(np.searchsorted(model.buckets, buckets), len(model.buckets) - 1)
    return np.where(model.buckets[at] == buckets, at + 1, 0)


def labelled(labels: DataFrame, key: str, label: str, fold: int, folds: int) -> DataFrame:
    """doc, toxic, kept (for the thresholds) of the documents that may be learned from."""
    k = F.col(key).cast("bigint")
    return (labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull())
            .filter(F.crc32(k.cast("string").cast("binary")) % folds != fold)
            .groupBy(k.alias("doc")).agg((F.max(label) > 0).alias("toxic"))
            .withColumn("kept", F.pmod(F.xxhash64(F.lit("kept"), "doc"), F.lit(5)) == 0))


def train(docs: DataFrame, known: DataFrame, key: str, text: str, sample: int) -> Model:
    """A model from a bounded sample of the labelled documents."""
    rows = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text"), F.xxhash64(text).alias("version"))
    order = F.xxhash64(F.lit("order"), "doc", "version")
    few = (rows.filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= DOC_BYTES)
           .select("doc", "version", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")).join(known, "doc")
           .dropDuplicates(["doc", "version"]).withColumn("order", order).orderBy("order", "doc", "version").limit(sample))
    # a window over at most `sample` rows
    sums = F.sum("bytes").over(Window.orderBy("order", "doc", "version").rowsBetween(Window.unboundedPreceding, 0))
    chosen = stage(few.withColumn("sum", sums).filter(F.col("sum") <= SAMPLE_BYTES).drop("sum", "bytes"), "toxicity_sample")
    texts = rows.join(chosen, ["doc", "version"]).groupBy("doc", "version", "order", "toxic", "kept").agg(F.first("text").alias("text"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("order", "ascending"), ("doc", "ascending"), ("version", "ascending")])
        got = [words(part.column(0)) for batch in table.select(["text"]).combine_chunks().to_batches() for part in slices(batch, 0)]
        every = pa.chunked_array([g.distinct.take(pa.array(g.codes)) for g in got]).combine_chunks().dictionary_encode()
        sizes = np.concatenate([np.diff(g.bounds) for g in got])
        model = fitted(every.indices.to_numpy().astype(np.int64), np.concatenate(([0], np.cumsum(sizes))), buckets_of(every.dictionary),
                       *(np.array(table.column(c).to_pylist(), bool) for c in ("toxic", "kept")))
        return pa.table({"model": pa.array([model.packed()], pa.binary())})

    made = stage(texts.groupBy(F.lit(1).alias("all")).applyInArrow(run, "model binary"), "toxicity_model").collect()  # one row, a few MB
    return Model.unpacked(made[0][0]) if made else constant(np.empty(0))


def cuts(scored: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, threshold) of the languages with enough labels, and one row (threshold) for all others."""
    counts = stage(scored.join(known.filter("kept").select("doc", "toxic"), F.col("key") == F.col("doc")).groupBy(
        "lang", F.floor(F.col("score") * 1000).cast("int").alias("bin")).agg(
        F.count_if("toxic").alias("toxic"), F.count_if(~F.col("toxic")).alias("clean")), "toxicity_counts")

    def best(rows: DataFrame, by: list[str]) -> DataFrame:
        whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
        above = whole.orderBy(F.desc("bin"))  # at most 1,001 rows of a language
        cut = rows.select(*by, "bin", F.sum("toxic").over(whole).alias("all_toxic"), F.sum("clean").over(whole).alias("all_clean"),
                          F.sum("toxic").over(above).alias("hit"), F.sum("clean").over(above).alias("wrong"))
        cut = cut.filter(f"least(all_toxic, all_clean) >= {LEAST_LABELS}").withColumn("f1", F.expr("2 * hit / (hit + wrong + all_toxic)"))
        return cut.groupBy(*by).agg(F.max(F.struct("f1", "bin"))["bin"].alias("bin")).select(*by, (F.col("bin") / 1000).alias("threshold"))

    every = counts.groupBy("bin").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    return best(counts, ["lang"]), best(every, []).agg(F.coalesce(F.max("threshold"), F.lit(0.5)).alias("threshold"))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", label_key: str = "doc_id",
             label: str = "toxic", fold: int = 0, folds: int = 5, sample: int = SAMPLE) -> DataFrame:
    """key, held_out, score, threshold (of the row's language) and toxic (score at or above it) of every row."""
    spark = docs.sparkSession
    known = labelled(labels, label_key, label, fold, folds)
    model = train(docs, known, key, text, sample)
    shared = spark.sparkContext.broadcast(model.packed())

    def run(batches):
        own = Model.unpacked(shared.value)
        for batch in batches:
            for part in slices(batch, 2, PART_BYTES):
                text_words = words(part.column(2))
                got = scores(own, text_words.codes.astype(np.int64), text_words.bounds, embedding_rows(own, buckets_of(text_words.distinct)))
                yield pa.record_batch([part.column(0), part.column(1), pa.array(got, pa.float64())], names=["key", "lang", "score"])

    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    scored = stage(rows.mapInArrow(run, "key bigint, lang string, score double"), "toxicity_scores")
    by_lang, other = cuts(scored, known)
    by_lang = by_lang.withColumnRenamed("lang", "own")
    rest = other.first()[0]
    held = F.coalesce(F.crc32(F.col("key").cast("string").cast("binary")) % folds == fold, F.lit(False))
    return (scored.join(by_lang, F.col("lang").eqNullSafe(F.col("own")), "left")
            .withColumn("threshold", F.coalesce("threshold", F.lit(rest)))
            .select("key", held.alias("held_out"), "score", "threshold", (F.col("score") >= F.col("threshold")).alias("toxic")))


def digests(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, labels).select(F.col("key").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                                         "threshold", F.col("toxic").alias("flagged"))
