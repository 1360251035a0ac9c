"""Runs of periodic words: every maximal stretch that repeats itself, and texts without the repeats.

A run of smallest period p is a maximal stretch of words in which words p apart are the same, of at
least max(LEAST, 2 p) words. It is looked for as an interval of places i with word[i] = word[i + p].

Periods are taken by octave [P, 2 P). Such an interval holds a whole boundary block: B words between
multiples of B, with B about half of what the shortest run of the octave needs. A tile is a range of
blocks with the 3 P words around it that they can reach, and it is solved by itself: for every block
and every p of the octave, fingerprints say whether the block stands p words further on too; blocks
that lie in a power of a shorter word are left out (their run has a smaller period); the others are
compared word by word, with the Z values to both sides (how far the match goes on beyond the block),
cut at a block's length, where the next block takes over. What comes out are pieces of intervals,
dealt by document and period and stitched where they touch.

Documents of up to `tile` words are one tile per octave, solved where they are read; their words
travel only if they hold a run. Longer ones are exploded into tiles that are dealt over the cluster.
The work is a few steps per word and octave, whatever the words are. The largest tile of the highest octave
holds four bytes or less for each word of its document.

Fingerprints only choose what is compared, but a block is left out as part of a power on two
remainders by primes of 31 bits alone: a wrong one has a chance of some 2^-60 per block.

Rules. Words are runs of other than white space (0x20, 0x09 to 0x0D), compared byte by byte and
numbered from 0. Null, empty and blank texts have no words, no runs and an empty text without
repeats. Rows that repeat a key, or have none, are documents of their own. Only the key and the text
are read, so other columns never clash. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltloom.llm.spans import BASE, WHITE, arrow_binary, coded, flat, mixed, narrow, pack, powers, slices, unpack, word_spans
from voltloom.session import stage

#: Words that a run has at least.
LEAST = 12
#: Words of a document or of a tile's blocks.
TILE_WORDS = 8192
#: Text that is solved at once, and places that are compared at once.
PART_BYTES, PLACES = 4 << 20, 1 << 21
PRIMES = ((2_147_483_647, 1_103_515_245), (2_147_483_629, 69_069_069))
RUN = "struct<start: bigint, period: bigint, length: bigint>"
FOUND = "row bigint, key bigint, kind string, lo bigint, hi bigint, period bigint, n bigint, payload binary, text string"
FOUND_ARROW = pa.schema([("row", pa.int64()), ("key", pa.int64()), ("kind", pa.string()), ("lo", pa.int64()), ("hi", pa.int64()),
                         ("period", pa.int64()), ("n", pa.int64()), ("payload", pa.binary()), ("text", pa.string())])


def block(octave: int) -> int:
    """The block of an octave: a match of m places holds a whole one if m >= 2 B - 1."""
    return (min(max(p, LEAST - p) for p in range(octave, 2 * octave)) + 1) // 2 if octave < LEAST else octave // 2


def needed(period: np.ndarray) -> np.ndarray:
    """Matching places that a run needs."""
    return np.maximum(period, LEAST - period)


def powers_mod(base: int, n: int, prime: int) -> np.ndarray:
    out = np.ones(max(1, n), np.uint64)
    size, step = 1, base % prime
    while size < n:
        more = min(size, n - size)
        out[size:size + more] = out[:more] * np.uint64(step) % np.uint64(prime)
        size, step = size + more, step * step % prime
    return out


def least_factors(n: int) -> np.ndarray:
    """The smallest prime factor of each number below n."""
    out = np.arange(n)
    for r in range(2, int(n ** 0.5) + 1):
        if out[r] == r:
            multiples = out[r * r::r]
            multiples[multiples == np.arange(r * r, n, r)] = r
    return out


class Words:
    """Words of documents one after the other as 64-bit marks, with their fingerprints."""

    def __init__(self, marks: np.ndarray, first: np.ndarray, last: np.ndarray):
        #: `first` and `last` bound, for every place, the document it lies in
        self.x, self.first, self.last = marks, first, last
        n = len(marks)
        self.inverse = powers(pow(BASE, -1, 1 << 64), n + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(marks * powers(BASE, n))))
        self.checks: list = []

    def seeds(self, octave: int, size: int, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """Blocks at start, start + size, ... below stop, and the periods at which their fingerprints recur."""
        n = len(self.x)
        stop = min(stop, n - octave - size + 1)
        count = max(0, -(-(stop - start) // size))
        if not count:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        prints = np.zeros(n + 2 * octave + 1, np.uint64)
        prints[:n - size + 1] = (self.sums[size:] - self.sums[:-size]) * self.inverse[:n - size + 1]
        at, period, rows = [], [], max(1, PLACES // octave)
        later = np.lib.stride_tricks.as_strided(prints[start + octave:], (count, octave), (8 * size, 8))
        for i in range(0, count, rows):
            own = prints[start + i * size:start + min(count, i + rows) * size:size][:, None]
            hit = np.flatnonzero(later[i:i + rows] == own)
            at.append(start + (i + hit // octave) * size)
            period.append(octave + hit % octave)
        a, p = np.concatenate(at), np.concatenate(period)
        inside = a + p + size <= self.last[a]
        return a[inside], p[inside]

    def same(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches at a < b have equal remainders by both primes."""
        if not self.checks:
            for prime, base in PRIMES:
                power = powers_mod(base, len(self.x) + 1, prime)
                self.checks.append((np.uint64(prime), power, np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.x % np.uint64(prime) * power[:-1] % np.uint64(prime))))))
        out = np.ones(len(a), bool)
        for prime, power, sums in self.checks:
            out &= (sums[a + length] - sums[a]) % prime * power[b - a] % prime == (sums[b + length] - sums[b]) % prime
        return out

    def primitive(self, a: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Whether the p words at a are no power of a shorter word."""
        out, rest = np.ones(len(a), bool), p.copy()
        factors = least_factors(int(p.max()) + 1) if len(p) else p
        while (open_ := np.flatnonzero(out & (rest > 1))).size:
            r = factors[rest[open_]]
            rest[open_] //= r
            q = p[open_] // r
            out[open_] = ~self.same(a[open_], a[open_] + q, p[open_] - q)
        return out

    def pieces(self, octave: int, start: int, stop: int) -> np.ndarray:
        """Rows (lo, hi, period): matches of this octave's blocks from start to stop, with their Z values."""
        size, out = block(octave), []
        a, p = self.seeds(octave, size, start, stop)
        keep = self.primitive(a, p)
        a, p = a[keep], p[keep]
        rows, around = max(1, PLACES // (3 * size)), np.arange(-size, 2 * size)
        for i in range(0, len(a), rows):
            own, period = a[i:i + rows, None], p[i:i + rows, None]
            at = own + around
            ok = (at >= self.first[own]) & (at + period < self.last[own])
            at = np.where(ok, at, own)
            ok &= self.x[at] == self.x[at + period]
            whole = ok[:, size:2 * size].all(1)
            ok = ok[whole]
            stops = np.zeros((len(ok), 1), bool)
            back = np.argmin(np.hstack((ok[:, size - 1::-1], stops)), 1)
            on = np.argmin(np.hstack((ok[:, 2 * size:], stops)), 1)
            out.append(np.stack((own[whole, 0] - back, own[whole, 0] + size + on, period[whole, 0]), 1))
        return np.concatenate(out) if out else np.empty((0, 3), np.int64)


def stitched(doc: np.ndarray, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of one document and period that touch, as one."""
    order = np.lexsort((pieces[:, 0], pieces[:, 2], doc))
    doc, pieces = doc[order], pieces[order]
    if not len(doc):
        return doc, pieces
    group = np.concatenate(([0], np.cumsum((np.diff(doc) != 0) | (np.diff(pieces[:, 2]) != 0))))
    far = np.int64(pieces[:, 1].max() + 1)
    reach = np.maximum.accumulate(pieces[:, 1] + group * far) - group * far
    new = np.concatenate(([True], (np.diff(group) != 0) | (pieces[1:, 0] > reach[:-1])))
    head = np.flatnonzero(new)
    return doc[head], np.stack((pieces[head, 0], np.maximum.reduceat(pieces[:, 1], head), pieces[head, 2]), 1)


def octaves(n: int):
    """1, 2, 4, ... while a document of n words may have a run of such a period."""
    octave = 1
    while 2 * octave <= n and n >= LEAST:
        yield octave
        octave *= 2


def solved(codes: np.ndarray, distinct: int, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """document, (lo, hi, period) of all matches long enough in whole documents of coded words."""
    n = np.diff(bounds)
    docs = np.flatnonzero(n >= LEAST)
    docs = docs[np.argsort(-n[docs], kind="stable")]  # the documents of an octave come first
    sizes = n[docs] + 1  # and a mark that nothing equals
    ends = np.cumsum(sizes)
    marks = np.arange(distinct, distinct + (int(ends[-1]) if len(ends) else 0), dtype=np.uint64)
    word = np.ones(len(marks), bool)
    word[ends - 1] = False
    starts = ends - sizes
    marks[word] = codes[np.arange(len(marks))[word] - np.repeat(starts - bounds[docs], sizes)[word]]
    text = Words(mixed(marks), np.repeat(starts, sizes), np.repeat(ends - 1, sizes))
    found = [np.empty((0, 3), np.int64)]
    for octave in octaves(int(n[docs[0]]) if len(docs) else 0):
        found.append(text.pieces(octave, 0, int(ends[np.searchsorted(-n[docs], -max(LEAST, 2 * octave), "right") - 1])))
    pieces = np.concatenate(found)
    at = np.searchsorted(ends, pieces[:, 0], "right")
    pieces[:, :2] -= starts[at][:, None]
    doc, pieces = stitched(docs[at], pieces)
    long = pieces[:, 1] - pieces[:, 0] >= needed(pieces[:, 2])
    return doc[long], pieces[long]


def tiles(codes: np.ndarray, tile: int):
    """lo, first block, end of the blocks, octave, codes of every tile of one document."""
    _, codes = np.unique(codes, return_inverse=True)
    for octave in octaves(len(codes)):
        size = block(octave)
        span = -(-max(tile, 4 * octave) // size) * size
        for first in range(0, len(codes) - octave, span):
            lo = max(0, first - size)
            yield lo, first, first + span, octave, narrow(codes[lo:first + span + size + 2 * octave])


def without_repeats(column: pa.Array, start: np.ndarray, stop: np.ndarray, doc: np.ndarray) -> pa.Array:
    """The words of every document joined by one space, without words start to stop of `doc`."""
    data, off = flat(column)
    begins, ends, bounds = word_spans(data, off)
    depth = np.zeros(len(begins) + 1, np.int64)
    np.add.at(depth, bounds[doc] + start, 1)
    np.add.at(depth, bounds[doc] + stop, -1)
    kept = np.flatnonzero(np.cumsum(depth[:-1]) == 0)
    owner = np.searchsorted(bounds, kept, "right")
    follows = np.zeros(len(kept), bool)
    follows[:-1] = owner[1:] == owner[:-1]
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, begins[kept], 1)
    np.add.at(edge, ends[kept], -1)
    keep = np.cumsum(edge[:-1]) > 0
    keep[ends[kept[follows]]] = True  # a white byte stands there, as another word follows
    out = np.where(WHITE[data], np.uint8(32), data)[keep]
    return arrow_binary(out, np.concatenate(([0], np.cumsum(keep)))[off])


def finished(texts: pa.Array, digest: bool) -> pa.Array:
    if digest:
        return pa.array([hashlib.sha256(t).hexdigest() for t in texts.to_pylist()], pa.string())
    return texts.cast(pa.large_string()).cast(pa.string())


def rows(kind: str, count: int, **columns) -> pa.RecordBatch:
    got = {"kind": pa.array([kind] * count, pa.string()), **columns}
    return pa.record_batch([pa.nulls(count, f.type) if f.name not in got else pa.array(got[f.name], f.type) if not isinstance(got[f.name], pa.Array)
                            else got[f.name].cast(f.type) for f in FOUND_ARROW], schema=FOUND_ARROW)


def collapse(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: bool = False, tile: int = TILE_WORDS) -> DataFrame:
    """key, runs (start, period, length; by start, then period) and text (the kept words joined by one
    space, or with `digest` its lower-case SHA-256) of every row. A word goes if any run holds it
    after the run's first `period` words."""
    def run(batches):
        nobody = np.empty(0, np.int64)
        for batch in batches:
            for part in slices(batch, 2, PART_BYTES):
                data, off = flat(part.column(2))
                begins, ends, bounds = word_spans(data, off)
                codes, distinct = coded(data[~WHITE[data]], np.concatenate(([0], np.cumsum(ends - begins))))
                n = np.diff(bounds)
                far = np.flatnonzero(n > tile)
                near = np.where(n > tile, 0, n)  # documents solved here
                own = codes[np.repeat(n <= tile, n)]
                doc, pieces = solved(own, len(distinct), np.concatenate(([0], np.cumsum(near))))
                plain = without_repeats(part.column(2), nobody, nobody, nobody)
                stays = np.zeros(len(n), bool)
                stays[doc], stays[far] = True, True
                some, none = (pa.array(np.flatnonzero(x)) for x in (stays, ~stays))
                row, own_key = part.column(0), part.column(1)
                yield rows("clean", len(none), row=row.take(none), key=own_key.take(none), text=finished(plain.take(none), digest))
                yield rows("words", len(some), row=row.take(some), key=own_key.take(some), text=finished(plain.take(some), False))
                yield rows("piece", len(doc), row=row.take(pa.array(doc)), lo=pieces[:, 0], hi=pieces[:, 1], period=pieces[:, 2])
                for i in far:
                    for lo, first, stop, octave, some_codes in tiles(codes[bounds[i]:bounds[i + 1]], tile):
                        yield rows("tile", 1, row=row.slice(i, 1), lo=[lo], hi=[first], n=[stop], period=[octave], payload=[pack(some_codes)])
        pa.default_memory_pool().release_unused()

    def solve_tiles(batches):
        for batch in batches:
            for r in batch.to_pylist():
                codes = unpack(r["payload"])[0].astype(np.uint64)
                n = len(codes)
                got = Words(mixed(codes), np.zeros(n, np.int64), np.full(n, n)).pieces(r["period"], r["hi"] - r["lo"], min(n, r["n"] - r["lo"]))
                _, got = stitched(np.zeros(len(got), np.int64), got)
                yield pa.record_batch([pa.array([r["row"]] * len(got), pa.int64()), *(pa.array(x, pa.int64()) for x in (
                    got[:, 0] + r["lo"], got[:, 1] + r["lo"], got[:, 2]))], names=["row", "lo", "hi", "period"])

    def drop(batches):
        for batch in batches:
            for part in slices(batch, 1, PART_BYTES):
                runs = part.column(2)
                doc = np.repeat(np.arange(part.num_rows), runs.value_lengths().fill_null(0).to_numpy())
                start, period, length = (f.to_numpy() for f in runs.flatten().flatten())
                kept = without_repeats(part.column(1), start + period, start + length, doc)
                yield pa.record_batch([part.column(0), runs, finished(kept, digest)], names=["key", "runs", "text"])

    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    found = stage(source.mapInArrow(run, FOUND), "periods", ["kind"])
    far = (found.filter("kind = 'tile'").select("row", "lo", "hi", "n", "period", "payload").repartition("row", "period", "hi")
           .mapInArrow(solve_tiles, "row bigint, lo bigint, hi bigint, period bigint"))
    pieces = found.filter("kind = 'piece'").select("row", "lo", "hi", "period").unionByName(far)
    runs = stitch(pieces).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    none = F.lit(None).cast(f"array<{RUN}>")
    repeats = (found.filter("kind = 'words'").select("row", "key", "text").join(runs, "row", "left")
               .select("key", "text", F.coalesce("runs", F.array().cast(f"array<{RUN}>")).alias("runs"))
               .mapInArrow(drop, f"key bigint, runs array<{RUN}>, text string"))
    clean = found.filter("kind = 'clean'").select("key", F.coalesce(none, F.array().cast(f"array<{RUN}>")).alias("runs"), "text")
    return clean.unionByName(repeats)


def stitch(pieces: DataFrame) -> DataFrame:
    """row, start, period, length of the runs from pieces (row, lo, hi, period) that may touch."""
    order = Window.partitionBy("row", "period").orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = pieces.withColumn("new", F.coalesce(F.col("lo") > reach, F.lit(True)).cast("int"))
    whole = (marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
             .groupBy("row", "period", "island").agg(F.min("lo").alias("start"), F.max("hi").alias("stop")))
    return whole.filter(f"stop - start >= greatest(period, {LEAST} - period)").select(
        "row", "start", "period", (F.col("stop") - F.col("start") + F.col("period")).alias("length"))


def planted(key: str, text: str) -> Column:
    """The text of a tenth of the documents, by hash of the key, with a periodic tail; others as they are."""
    rewritten = f"""transform(array(filter(split({text}, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> '')), words ->
        transform(array(named_struct('a', cast(g % size(words) as int), 'p', 1 + cast((size(words) - g % size(words)) div (3 + g % 8) as int))), s ->
            array_join(transform(words, (w, i) -> if(i < s.a, w, words[s.a + (i - s.a) % s.p])), ' '))[0])[0]"""
    hashed = F.crc32(F.col(key).cast("string").cast("binary"))
    g = f"floor(crc32(cast(cast({key} as string) as binary)) / 10)"
    return F.when((hashed % 10 == 0) & F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.expr(rewritten.replace("g %", f"{g} %"))).otherwise(F.col(text))


def digests(docs: DataFrame) -> DataFrame:
    got = collapse(docs.select("doc_id", planted("doc_id", "text").alias("text")), digest=True)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("length"), r["start"].alias("start"), r["period"].alias("period"))))
    return got.withColumn("top", longest).select(
        F.col("key").alias("doc_id"), F.size("runs").cast("bigint").alias("n_runs"), F.col("top.start").alias("start"),
        (-F.col("top.length")).alias("length"), F.col("top.period").alias("period"),
        F.expr("floor(1000 * -top.length / top.period)").cast("bigint").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.col("text").alias("collapsed_sha256"))
