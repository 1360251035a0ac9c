"""Groups of spelling variants: words one edit apart, found through a reduced alphabet.

Letters are dealt to a few symbols, so a word has a reduced word. Words that differ by one inserted,
deleted or replaced code point have reduced words that are equal or one edit apart. Each word
generates the one-edit neighbourhood of its reduced word, every unordered pair from one side only:
itself, every replacement of a symbol by a higher one, and every deletion. The neighbourhoods are
joined to the reduced vocabulary, and the words met there are verified on their original strings.

The number of symbols is the least for which no word length has more words than reduced words, so
that a reduced word is met by about as many words at any size of the vocabulary. Letters are dealt
in order of their frequency, back and forth, which evens out the symbols. Words over LONG code
points (whose neighbourhoods would grow with the square of their length) meet by halves instead:
one edit leaves the first or the second half of the longer word as it is.

Chains of forms rise in count by `ratio` at every step, so they are short; roots are found by
doubling the steps, and every round is written to the shared folder.

Rules. Words are the maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower case. Null
and empty texts have none. Rows that repeat a document count as they stand. Ties between forms go
to the smaller word in code-point order. An empty vocabulary gives an empty table. Only the two
columns named are read, so other columns of the rows never clash.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltloom.llm.spans import coded, flat, lowered, run_spans, slices
from voltloom.session import stage

#: Words of more code points meet by halves.
LONG = 32
#: Symbols: at least and at most. They are the characters from FIRST_SYMBOL on.
SYMBOLS, FIRST_SYMBOL = (4, 64), 48


def letter_runs(column: pa.Array, least: int):
    """Lower-cased runs of at least `least` code points: document, code, distinct (binary), their code points."""
    data, off = flat(column)
    data = lowered(data)
    two = data == 0xC3  # the lead byte of U+00C0 to U+00FF
    solid = ((data >= 97) & (data <= 122)) | two
    solid[1:] |= two[:-1]
    starts, ends, bounds = run_spans(solid, off)
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    doc = np.repeat(np.arange(len(off) - 1), np.diff(bounds))
    keep = points[ends] - points[starts] >= least
    starts, ends, doc = starts[keep], ends[keep], doc[keep]
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts], inside[ends] = 1, -1  # runs do not touch within a document ...
    inside[ends[:-1][ends[:-1] == starts[1:]]] = 0  # ... but may at a document's end
    codes, distinct = coded(data[np.cumsum(inside[:-1]).astype(bool)], np.concatenate(([0], np.cumsum(ends - starts))))
    return doc, codes, distinct


def without(word: bytes, at: int) -> bytes:
    text = word.decode()
    return (text[:at] + text[at + 1:]).encode()


def counted(keys: list, column: pa.Array, least: int, damage: int | None) -> tuple[pa.Array, np.ndarray]:
    """The words of a slice and how often they occur. `damage`: a word loses a code point in the
    documents where it divides the CRC-32 of `<key>:<word>` (never where the key is null)."""
    doc, codes, distinct = letter_runs(column, least)
    if not damage:
        return distinct, np.bincount(codes, minlength=len(distinct))
    pair = doc * np.int64(max(1, len(distinct))) + codes
    pair.sort()
    at = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))) if len(pair) else np.empty(0, np.int64)
    times = np.diff(np.append(at, len(pair)))
    doc, codes = np.divmod(pair[at], max(1, len(distinct)))
    texts = np.empty(len(distinct), object)
    texts[:] = distinct.to_pylist()
    heads = np.array([0 if k is None else zlib.crc32(b"%d:" % k) for k in keys], object)
    crc = np.fromiter(map(zlib.crc32, texts[codes], heads[doc]), np.uint32, len(codes))
    known = np.array([k is not None for k in keys], bool)
    hit = (crc % damage == 0) & known[doc]
    n = np.bincount(codes[~hit], times[~hit], len(distinct)).astype(np.int64)
    whole = np.flatnonzero(n)
    harmed = [without(w, h % len(w.decode())) for w, h in zip(texts[codes[hit]], crc[hit].tolist(), strict=True)]
    return pa.concat_arrays([distinct.take(pa.array(whole)).cast(pa.large_binary()), pa.array(harmed, pa.large_binary())]), np.concatenate((n[whole], times[hit]))


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 5, least_count: int = 3,
               damage: int | None = None) -> DataFrame:
    """word, n: the words of at least so many code points and occurrences over all documents."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                values, n = counted(part.column(0).to_pylist(), part.column(1), least_length, damage)
                yield pa.record_batch([values.cast(pa.large_string()).cast(pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

    parts = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).mapInArrow(run, "word string, n bigint")
    return (parts.filter(F.char_length("word") >= least_length).groupBy("word").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= least_count))


def symbol_count(words: DataFrame) -> int:
    """The least number of symbols for which no length has more words than reduced words."""
    need = words.groupBy(F.char_length("word").alias("length")).agg(F.count(F.lit(1)).alias("v")).agg(
        F.max(F.ceil(F.pow("v", 1 / F.col("length"))))).first()[0]
    return int(min(max(need or 0, SYMBOLS[0]), SYMBOLS[1]))


def reduction(words: DataFrame, symbols: int) -> tuple[str, str]:
    """The letters (an alphabet, so at most 90), and the symbol of each."""
    rows = words.select(F.explode(F.split("word", "")).alias("letter")).filter("letter <> ''").groupBy("letter").count().collect()
    letters = [r["letter"] for r in sorted(rows, key=lambda r: (-r["count"], r["letter"]))]
    place = [i % symbols if i // symbols % 2 == 0 else symbols - 1 - i % symbols for i in range(len(letters))]
    return "".join(letters), "".join(chr(FIRST_SYMBOL + p) for p in place)


def neighbourhood(symbols: int) -> Column:
    """Keys of the reduced word r: every replacement by a higher symbol, and every deletion."""
    every = ", ".join(f"'{chr(FIRST_SYMBOL + k)}'" for k in range(symbols)).replace("'\\'", "'\\\\'")
    raised = (f"flatten(transform(sequence(1, length(r)), i -> transform(filter(array({every}), c -> c > substring(r, i, 1)), "
              "c -> xxhash64(concat(left(r, i - 1), c, substring(r, i + 1))))))")
    shorter = "array_distinct(transform(sequence(1, length(r)), i -> xxhash64(concat(left(r, i - 1), substring(r, i + 1)))))"
    return F.expr(f"concat({raised}, {shorter})")


def halves() -> Column:
    """Keys by which a word meets those of its own length and of one code point more."""
    one = ("array(xxhash64(m, 0, left(word, m div 2)), xxhash64(m, 1, right(word, m - m div 2)))")
    return F.expr(f"array_distinct(flatten(transform(filter(array(length(word), length(word) + 1), m -> m > {LONG}), m -> {one})))")


def near_pairs(words: DataFrame) -> DataFrame:
    """a, a_n, b, b_n: every unordered pair of words (word, n) that are one edit apart, once."""
    symbols = symbol_count(words)
    letters, dealt = reduction(words, symbols)
    short = words.filter(F.char_length("word") <= LONG).withColumn("r", F.translate("word", letters, dealt))
    right = short.select(F.xxhash64("r").alias("at"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    own = F.array(F.struct(F.xxhash64("r").alias("at"), F.lit(True).alias("same")))
    around = F.transform(neighbourhood(symbols), lambda k: F.struct(k.alias("at"), F.lit(False).alias("same")))
    left = short.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.explode(F.concat(own, around)).alias("k")).select("a", "a_n", "k.at", "k.same")
    met = left.join(right, "at").filter("(not same or a < b) and levenshtein(a, b, 1) = 1").select("a", "a_n", "b", "b_n")
    half = words.filter(F.char_length("word") >= LONG).select("word", "n", F.explode(halves()).alias("at"))
    by_half = half.select(F.col("word").alias("a"), F.col("n").alias("a_n"), "at").join(
        half.select(F.col("word").alias("b"), F.col("n").alias("b_n"), "at"), "at").filter("a < b and levenshtein(a, b, 1) = 1")
    # one pair may share both halves' keys of two lengths
    long_pairs = by_half.filter(F.greatest(F.char_length("a"), F.char_length("b")) > LONG).select("a", "a_n", "b", "b_n").distinct()
    return met.unionByName(long_pairs)


def roots(forms: DataFrame) -> DataFrame:
    """word, root from word, form: the last word that forms lead to, in rounds that double the steps."""
    jumps = stage(forms.select("word", F.col("form").alias("root")), "variant_roots")
    while True:
        far = jumps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = stage(jumps.join(far, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")),
                      "variant_roots")
        jumps = after.select("word", "root")
        if not after.filter("moved").limit(1).count():
            return jumps


def groups(words: DataFrame, ratio: int = 2) -> DataFrame:
    """word, n, n_near, form, form_n, root of a vocabulary (word, n)."""
    words = stage(words, "variant_words")
    pairs = near_pairs(words)
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.struct((-F.col("b_n")).alias("n"), F.col("b").alias("form")).alias("near")),
        F.struct(F.col("b").alias("word"), F.struct((-F.col("a_n")).alias("n"), F.col("a").alias("form")).alias("near")))).alias("x")).select("x.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("near").alias("near"))
    chosen = stage(words.join(best, "word", "left").withColumn("ok", -F.col("near.n") >= ratio * F.col("n")).select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.expr("if(ok, near.form, null)").alias("form"),
        F.expr("if(ok, -near.n, null)").alias("form_n")), "variant_forms")
    last = roots(chosen.filter("form is not null"))
    return chosen.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))


def digests(docs: DataFrame) -> DataFrame:
    return groups(vocabulary(docs, damage=97)).select("word", "form", "root", "n", "n_near", "form_n")


ORACLE = r"""
WITH RECURSIVE r AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
p AS (SELECT doc_id, w, count(*) AS k, encode(doc_id || ':' || w)::BIT AS bits FROM r WHERE length(w) >= 5 GROUP BY doc_id, w),
-- CRC-32, bit by bit, each byte from its low end
h AS (SELECT w, k, xor(list_reduce([4294967295::BIGINT] || list_transform(range(bit_length(bits)),
        lambda i: get_bit(bits, (8 * (i // 8) + 7 - i % 8)::INTEGER)::BIGINT),
        lambda c, x: xor(c >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295) AS h FROM p),
d AS (SELECT CASE WHEN h % 97 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, k FROM h),
v AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM d WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
x AS (SELECT word, n, unnest(range(length(word))) AS i FROM v),
swap AS (SELECT word, n, left(word, i) || '?' || substr(word, i + 2) AS key FROM x),
less AS (SELECT DISTINCT word, n, left(word, i) || substr(word, i + 2) AS key FROM x),
near AS (SELECT a.word, b.word AS form, b.n AS form_n FROM swap a JOIN swap b ON a.key = b.key AND a.word <> b.word
         UNION ALL SELECT l.word, v.word, v.n FROM less l JOIN v ON l.key = v.word
         UNION ALL SELECT v.word, l.word, l.n FROM less l JOIN v ON l.key = v.word),
g AS (SELECT word, form, form_n, count(*) OVER (PARTITION BY word) AS n_near,
             row_number() OVER (PARTITION BY word ORDER BY form_n DESC, form) AS place FROM near),
f AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(g.n_near, 0) AS n_near, CASE WHEN g.form_n >= 2 * v.n THEN g.form END AS form,
         CASE WHEN g.form_n >= 2 * v.n THEN g.form_n END AS form_n
  FROM v LEFT JOIN g ON g.word = v.word AND g.place = 1),
chain AS (SELECT word, word AS at FROM f UNION ALL SELECT c.word, f.form FROM chain c JOIN f ON f.word = c.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n
FROM f JOIN chain c ON c.word = f.word JOIN f last ON last.word = c.at AND last.form IS NULL
"""
