"""An interpolated trigram model in sharded Elias-Fano tries, and its scores of all texts.

Words are numbered once per corpus (voltloom.llm.distinct). Blocks of documents count their
distinct trigrams (two words of context and the next token), so a passage that a third of all
documents repeat is one entry per block. Trigrams are dealt to shards by their root: the word
before the token, and a class of the word before that. Ordinary words have one class; a word with
a share of more than one shard's part of all tokens has more, by hash, so only a frequent pair of words
is one shard's (the start of every text is such a context). The
bigrams of such a split root are dealt by the token instead and counted on their own, each pair in
one shard; how many kinds follow the root is summed over its shards (a few numbers per split root,
and at most as many split roots as shards), and how often it occurs is its word's count.

A shard builds a trie of the training counts: roots, their successors, their contexts, and under
each context the tokens seen, kept not as word numbers but as ranks among the successors of the
root. Numbers and pointers are Elias-Fano sequences, probabilities two-byte logarithmic codes, and
the file is mapped into memory and asked for the blocks' trigrams by successor search, from the
root's range to the context's. A split root's part of the trie holds trigrams only; the blocks add its
bigram level (unquantised) from the counts of the pairs.

Model. P(c | a b) = d3 + l3 * (d2 + l2 * P1(c)) with absolute discounting by D at both levels
(d = max(n - D, 0) / total, l = D * kinds / total), where the middle level conditions on the root,
and P1(c) = (count + 1/2) / (N + (V + 1) / 2). Codes are rounded down (by up to 0.5 % each), so probabilities of a
context sum to at most 1; an unseen context passes everything on.

Rules. A-Z in lower case; a text's end is a token; null, empty and blank texts are an end only.
Two start marks stand before each text. Documents whose crc32 of the key as text leaves remainder
`fold` by `folds` are held out of training; null keys train. With no training tokens all counts
are 0. Rows that repeat a key are scored and trained on as documents of their own.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltloom.llm.distinct import ROW, ROW_ARROW, drop_words, in_order, n_buckets, row, staged_blocks
from voltloom.llm.eliasfano import coded as ef_coded
from voltloom.llm.eliasfano import decoded as ef_decoded
from voltloom.llm.eliasfano import found, mapped, ranged, save
from voltloom.llm.files import new_folder
from voltloom.llm.spans import mixed, narrow, pack, unpack, unpack_binary, words
from voltloom.session import stage

DISCOUNT = 0.75
#: Codes of the trie and of the answers (two bytes, steps of 0.5 %): how many, over how many decades.
#: A count is below 2^63, so no stored value is under 10^-20 and no product of two under 10^-40.
STORED, ANSWERED = (9099, 20.0), (18197, 40.0)
#: Shards per shuffle partition: a shard is built and asked in memory.
FINER = 4
#: Text of a block: its trigrams are sorted in memory.
BLOCK_BYTES = 8 << 20
START, END, FIRST = 0, 1, 2
OUT = ("doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def quantised(p: np.ndarray, scale: tuple[int, float]) -> np.ndarray:
    """Logarithmic codes of probabilities, rounded down; 0 is none, the last is 1."""
    levels, decades = scale
    with np.errstate(divide="ignore"):
        code = np.floor((np.log10(p) + decades) * ((levels - 1) / decades) + 1e-9) + 1
    return np.where(p > 0, np.clip(code, 1, levels), 0).astype(np.uint16)


def values(scale: tuple[int, float]) -> np.ndarray:
    levels, decades = scale
    return np.concatenate(([0.0], 10.0 ** (np.arange(levels) * (decades / (levels - 1)) - decades)))


def held_out(keys: pa.Array, fold: int, folds: int) -> np.ndarray:
    return np.array([k is not None and zlib.crc32(str(k).encode()) % folds == fold for k in keys.to_pylist()], bool)


def numbered_words(word_rows: DataFrame, buckets: int) -> DataFrame:
    """Per block and bucket: the number and the training count of each word of the dictionary.
    Rows of block -1 hold a bucket's training tokens and its words with a count."""
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        parts = [unpack_binary(r["payload"]) for r in rows]
        every = pa.concat_arrays([v for v, _ in parts]).dictionary_encode()
        codes = every.indices.to_numpy()
        counts = np.bincount(codes, np.concatenate([c for _, c in parts]), len(every.dictionary)).astype(np.int64)
        # frequent words get small numbers, which code shorter; byte order settles ties, so that reruns agree
        texts = every.dictionary.to_pylist()
        order = np.array(sorted(range(len(counts)), key=lambda i: (-counts[i], texts[i])))
        number = np.empty(len(counts), np.int64)
        number[order] = np.arange(len(counts))
        number = FIRST + number * buckets + rows[0]["bucket"]
        made, at = [row(-1, rows[0]["bucket"], pack(np.array([counts.sum(), np.count_nonzero(counts)])))], 0
        for r, (v, _) in zip(rows, parts, strict=True):
            mine = codes[at:at + len(v)]
            at += len(v)
            made.append(row(r["block"], r["bucket"], pack(narrow(number[mine]), narrow(counts[mine]))))
        return pa.Table.from_batches(made, ROW_ARROW)

    return word_rows.groupBy("bucket").applyInArrow(run, ROW)


class Corpus:
    """What every task knows of the corpus: a few numbers."""

    def __init__(self, tokens: int, distinct: int, documents: int, shards: int, fold: int, folds: int):
        self.n, self.v, self.ends = tokens, distinct, documents
        self.shards, self.fold, self.folds = shards, fold, folds
        self.kinds = np.empty((2, 0), np.int64)  # split roots in order, and how many kinds of tokens follow each

    def bigram(self, b: np.ndarray, often: np.ndarray, n: np.ndarray, p1: np.ndarray) -> np.ndarray:
        """P(c | b) of split roots from the training counts of b and of the pairs."""
        kinds = self.kinds[1][np.searchsorted(self.kinds[0], b)]
        return (np.maximum(n - DISCOUNT, 0) + DISCOUNT * kinds * p1) / often

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.5) / (self.n + 0.5 * (self.v + 1))


def block_trigrams(docs: pa.Table, words_: list[list[np.ndarray]], corpus: Corpus):
    """Tokens of a block in order with their distinct trigrams, and the distinct bigrams of split
    roots, each dealt to shards. Class 0 is an ordinary root, 1 and more are those of a split one."""
    numbers = np.concatenate([w[0].astype(np.int64) for w in words_] or [np.empty(0, np.int64)])
    counts = np.concatenate([w[1].astype(np.int64) for w in words_] or [np.empty(0, np.int64)])
    codes, sizes = unpack(docs.column("payload")[0].as_py())
    sizes = sizes.astype(np.int64)
    keys = docs.column("keys")[0].values
    out = held_out(keys, corpus.fold, corpus.folds)
    n = sizes + 1
    ends = np.cumsum(n) - 1
    # the block's own numbers of its words, in the order of the corpus's: three of them make one key to sort by
    local = np.empty(len(numbers), np.int64)
    local[np.argsort(numbers)] = np.arange(FIRST, FIRST + len(numbers))
    c, often, own = (np.empty(int(n.sum()), np.int64) for _ in range(3))
    word = np.ones(len(c), bool)
    word[ends] = False
    c[ends], often[ends], own[ends] = END, corpus.ends, END
    c[word], often[word], own[word] = numbers[codes], counts[codes], local[codes]
    starts = ends - n + 1
    second = (starts + 1)[n > 1]

    def before(x: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        one, two = np.empty_like(x), np.empty_like(x)
        one[1:], two[2:] = x[:-1], x[:-2]
        one[starts], two[starts], two[second] = first, first, first
        return one, two

    b, a = before(c, START)
    b_often = before(often, corpus.ends)[0]
    own_b, own_a = before(own, START)
    size = FIRST + len(numbers)
    if size ** 3 < 1 << 63:
        key = (own_b * size + own_a) * size + own
        order = np.argsort(key)  # equal keys are equal trigrams, so their order does not matter
        at = heads(key[order])
    else:
        order = np.lexsort((c, a, b))
        at = heads(a[order], b[order], c[order])
    new = np.zeros(len(order), np.int64)
    new[at] = 1
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    first = order[at]
    train = np.bincount(which, np.repeat(~out, n), len(first)).astype(np.int64)
    a, b, b_often = a[first], b[first], b_often[first]
    classes = 1 + b_often * corpus.shards // max(1, corpus.n)
    split, c = classes > 1, c[first]
    g = np.where(split, 1 + salt(a, classes), 0)
    deal, place, cuts = dealt(b, g, corpus.shards)
    trigrams = Dealt(place[which], cuts, (b[deal], g[deal], a[deal], c[deal], train[deal]))
    some = np.flatnonzero(split)
    some = some[np.lexsort((c[some], b[some]))]
    at = heads(b[some], c[some])
    of = np.full(len(b), -1, np.int64)
    of[some] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(some))))
    pairs, seen = some[at], np.add.reduceat(train[some], at) if len(at) else train[:0]
    deal, place, cuts = dealt(b[pairs], 1 + salt(c[pairs], classes[pairs]), corpus.shards)
    of[some] = place[of[some]]
    bigrams = Dealt(of[which], cuts, (b[pairs][deal], c[pairs][deal], seen[deal], b_often[pairs][deal]))
    return keys, out, n, often, trigrams, bigrams


class Dealt(NamedTuple):
    of: np.ndarray          # of each token, its place in the columns, or -1
    cuts: np.ndarray        # where each shard's part begins
    columns: tuple[np.ndarray, ...]


def salt(x: np.ndarray, classes: np.ndarray) -> np.ndarray:
    return (mixed(x.astype(np.uint64)) % classes.astype(np.uint64)).astype(np.int64)


def dealt(b: np.ndarray, g: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by shards, each item's place in it, and the shards' bounds."""
    shard = (mixed((b * 65_537 + g).astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
    deal = np.argsort(shard, kind="stable")
    place = np.empty(len(deal), np.int64)
    place[deal] = np.arange(len(deal))
    return deal, place, np.searchsorted(shard[deal], np.arange(shards + 1))


def sorted_by(first: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """The order by `first`, then two more columns of whole numbers, as one key where they fit together."""
    a, c = more
    size = int(c.max()) + 1 if len(c) else 1
    if len(a) and int(a.max()) + 1 < (1 << 63) // size:
        return np.lexsort((a * size + c, first))
    return np.lexsort((c, a, first))


def heads(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def build(b, g, a, c, n, split: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """The trie of trigrams sorted by (b, g, a, c), each once, with their counts n > 0. Where
    `split`, the root is one of several parts: its bigram level is left to the caller (d2 = 0, l2 = 1)."""
    root_at = heads(b, g)
    root_of = np.repeat(np.arange(len(root_at)), np.diff(np.append(root_at, len(b))))
    context_at = heads(root_of, a)
    # successors of roots
    order = np.lexsort((c, root_of))
    s_at = heads(root_of[order], c[order])
    s_root, s_word = root_of[order][s_at], c[order][s_at]
    s_n = np.add.reduceat(n[order], s_at) if len(n) else n
    s_ptr = np.searchsorted(s_root, np.arange(len(root_at) + 1))
    total = np.bincount(root_of, n, len(root_at))
    d2 = np.maximum(s_n - DISCOUNT, 0) / total[s_root]
    l2 = DISCOUNT * np.diff(s_ptr) / total
    if split is not None:
        d2, l2 = np.where(split[root_at][s_root], 0.0, d2), np.where(split[root_at], 1.0, l2)
    # contexts and what follows them, as ranks among the root's successors
    x_ptr = np.searchsorted(root_of[context_at], np.arange(len(root_at) + 1))
    t_ptr = np.append(context_at, len(b))
    x_total = np.add.reduceat(n, context_at) if len(n) else n
    rank = np.empty(len(b), np.int64)
    rank[order] = np.repeat(np.arange(len(s_at)), np.diff(np.append(s_at, len(b)))) - s_ptr[root_of[order]]
    d3 = np.maximum(n - DISCOUNT, 0) / np.repeat(x_total, np.diff(t_ptr))
    l3 = DISCOUNT * np.diff(t_ptr) / x_total
    levels = {"roots": b[root_at] * 65_537 + g[root_at], "s_ptr": s_ptr, "s": ranged(s_word, s_ptr), "x_ptr": x_ptr,
              "x": ranged(a[context_at], x_ptr), "t_ptr": t_ptr, "t": ranged(rank, t_ptr)}
    out = {f"{k}.{part}": v for k, seq in levels.items() for part, v in ef_coded(seq).items()}
    return out | {k: quantised(p, STORED) for k, p in (("d2", d2), ("l2", l2), ("d3", d3), ("l3", l3))}


def ask(trie: dict[str, np.ndarray], b, g, a, c) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the part seen and of the weight of P1, for each trigram."""
    seq = {k: ef_decoded({p: trie[f"{k}.{p}"] for p in ("head", "low", "high")}) for k in ("roots", "s_ptr", "s", "x_ptr", "x", "t_ptr", "t")}
    if not len(seq["roots"]):
        return np.zeros(len(b), np.uint16), np.full(len(b), ANSWERED[0], np.uint16)
    key = b * 65_537 + g
    at = np.minimum(np.searchsorted(seq["roots"], key), len(seq["roots"]) - 1)
    root = np.where(seq["roots"][at] == key, at, -1)
    s = found(seq["s"], seq["s_ptr"], root, c)
    x = found(seq["x"], seq["x_ptr"], root, a)
    t = found(seq["t"], seq["t_ptr"], x, np.where(s >= 0, s - seq["s_ptr"][np.maximum(root, 0)], -1))
    level = values(STORED)
    value = lambda codes, i, none: np.where(i >= 0, level[codes[np.maximum(i, 0)]], none)
    l3 = value(trie["l3"], x, 1.0)
    return (quantised(value(trie["d3"], t, 0.0) + l3 * value(trie["d2"], s, 0.0), ANSWERED),
            quantised(l3 * value(trie["l2"], root, 1.0), ANSWERED))


def pair_counts(b, c, n) -> tuple[np.ndarray, np.ndarray]:
    """The roots of pairs with how many kinds follow each in training, and each pair's count over all rows."""
    order = np.lexsort((c, b))
    at = heads(b[order], c[order])
    total = np.add.reduceat(n[order], at) if len(at) else n[:0]
    counts = np.empty(len(b), np.int64)
    counts[order] = np.repeat(total, np.diff(np.append(at, len(b))))
    root, kinds = np.unique(b[order][at][total > 0], return_counts=True)
    return np.stack((root, kinds)), counts


def summed(*parts: list[np.ndarray]) -> np.ndarray:
    """Roots in order, and the sum of their numbers over all parts."""
    root, which = np.unique(np.concatenate([p[0] for p in parts] or [np.empty(0, np.int64)]), return_inverse=True)
    kinds = np.zeros(len(root), np.int64)
    np.add.at(kinds, which, np.concatenate([p[1] for p in parts] or [kinds]))
    return np.stack((root, kinds))


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", fold: int = 1, folds: int = 5, folder: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    buckets, folder = n_buckets(spark), folder or new_folder(spark, "trie")
    doc_rows, word_rows = staged_blocks(docs, key, text, lambda c: words(c, lower=True),
                                        lambda keys: ~held_out(keys, fold, folds), BLOCK_BYTES)
    numbers = stage(numbered_words(word_rows, buckets), "lm_words")
    drop_words(word_rows)  # from here on words are their numbers
    totals = [unpack(r[0])[0] for r in numbers.filter("block = -1").select("payload").collect()]  # a row per bucket
    k = F.col(key)
    ends = docs.filter(F.coalesce(F.crc32(k.cast("bigint").cast("string").cast("binary")) % folds != fold, F.lit(True))).count()
    corpus = Corpus(int(sum(t[0] for t in totals)) + ends, int(sum(t[1] for t in totals)) + (ends > 0), ends, buckets * FINER, fold, folds)
    numbers = numbers.filter("block >= 0")

    def emit(docs_: pa.Table, parts: pa.Table) -> pa.Table:
        made = []
        if docs_.num_rows:
            *_, three, two = block_trigrams(docs_, in_order(parts), corpus)
            block = docs_.column("block")[0].as_py()
            for i in np.flatnonzero(np.diff(three.cuts) + np.diff(two.cuts)):
                b, g, a, c, n = (x[three.cuts[i]:three.cuts[i + 1]] for x in three.columns)
                b2, c2, n2, _ = (x[two.cuts[i]:two.cuts[i + 1]] for x in two.columns)
                step = np.diff(b, prepend=0)
                rise = np.where(step == 0, np.diff(a, prepend=0), a)  # sorted by b, then a
                made.append(row(block, int(i), pack(narrow(step), narrow(g), narrow(rise), narrow(c), narrow(n),
                                                    narrow(np.diff(b2, prepend=0)), narrow(c2), narrow(n2))))
        return pa.Table.from_batches(made, ROW_ARROW)

    def answer(table: pa.Table) -> pa.Table:
        rows = table.select(["block", "bucket"]).to_pylist()
        parts, pairs = [], []
        for payload in table.column("payload"):
            step, g, rise, c, n, *two = (x.astype(np.int64) for x in unpack(payload.as_py()))
            pairs.append([np.cumsum(two[0]), *two[1:]])
            b = np.cumsum(step)
            sums, at = np.cumsum(rise), heads(b)  # a block may send a shard pairs only
            before = np.repeat(sums[at] - rise[at], np.diff(np.append(at, len(rise))))
            parts.append([b, g, sums - before, c, n])
        b, g, a, c, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        seen = n > 0
        order = np.flatnonzero(seen)[sorted_by(b[seen] * 65_537 + g[seen], a[seen], c[seen])]
        at = heads(b[order], g[order], a[order], c[order])
        one = order[at]
        name = f"shard-{rows[0]['bucket']:05d}.eft"
        save(folder, name, build(b[one], g[one], a[one], c[one], np.add.reduceat(n[order], at) if len(at) else n[:0], g[one] > 0))
        trie, made = mapped(folder, name), []
        seen_part, rest = ask(trie, b, g, a, c)
        kinds, n2 = pair_counts(*(np.concatenate(x) for x in zip(*pairs, strict=True)))
        made.append(row(-1, rows[0]["bucket"], pack(*kinds)))
        at = at2 = 0
        for r, part, pair in zip(rows, parts, pairs, strict=True):
            made.append(row(r["block"], r["bucket"], pack(seen_part[at:at + len(part[0])], rest[at:at + len(part[0])],
                                                          narrow(n2[at2:at2 + len(pair[0])]))))
            at, at2 = at + len(part[0]), at2 + len(pair[0])
        return pa.Table.from_batches(made, ROW_ARROW)

    def finish(docs_: pa.Table, parts: pa.Table) -> pa.Table:
        if not docs_.num_rows:
            return schema.empty_table()
        got = parts.column("got").to_numpy()
        keys, out, n, often, three, two = block_trigrams(docs_, in_order(parts.filter(pa.array(~got))), corpus)
        *codes, pair_n = (np.concatenate(x) for x in zip(*in_order(parts.filter(pa.array(got))), strict=True))
        below = corpus.unigram(often)
        base, level, pair = np.log10(below), values(ANSWERED), two.of[two.of >= 0]
        b2, _, _, often2 = (x[pair] for x in two.columns)
        below[two.of >= 0] = corpus.bigram(b2, often2, pair_n[pair].astype(np.int64), below[two.of >= 0])
        own = np.log10(np.minimum(1.0, level[codes[0][three.of]] + level[codes[1][three.of]] * below))
        at = np.cumsum(n) - n
        return pa.table({"doc_id": keys, "held_out": pa.array(out), "n_tokens": n, "n_known": np.add.reduceat((often > 0).astype(np.int64), at),
                         "train_tokens": np.full(len(n), corpus.n), "base_score": np.add.reduceat(base, at), "score": np.add.reduceat(own, at)}, schema)

    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                        ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    asked = doc_rows.groupBy("block").cogroup(numbers.groupBy("block")).applyInArrow(emit, ROW)
    answers = stage(asked.groupBy("bucket").applyInArrow(answer, ROW), "lm_answers")
    corpus.kinds = summed(*(unpack(r[0]) for r in answers.filter("block = -1").select("payload").collect()))  # a row per shard
    answers = answers.filter("block >= 0")
    both = numbers.withColumn("got", F.lit(False)).unionByName(answers.withColumn("got", F.lit(True)))
    return doc_rows.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(finish, OUT)
