"""Words, units and lines of text columns as NumPy arrays, inside Arrow batches.

All helpers take whole Arrow string columns (null counts as empty) and return flat arrays with
`bounds`: the items of document i are bounds[i] to bounds[i + 1]. White space is the six bytes
0x20 and 0x09 to 0x0D throughout.
"""

from __future__ import annotations

import io
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of one task's working slice of text.
SLICE_BYTES = 16 << 20


class Coded(NamedTuple):
    codes: np.ndarray       # of each item, its place in `distinct`
    bounds: np.ndarray      # per document
    distinct: pa.Array      # binary


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES):
    """Consecutive parts of a batch with about `limit` bytes of text each, a row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes, dtype=np.int64), 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows in one array, and where each row starts and ends."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z; other characters of UTF-8 have no such bytes."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def arrow_binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary values data[offsets[i]:offsets[i + 1]]."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1,
                                 [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)),
                                  pa.py_buffer(np.ascontiguousarray(data))])


def run_spans(solid: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of `solid` bytes, which end with their document, and bounds."""
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edge = off[(off > 0) & (off < len(solid))]
    first[edge] = solid[edge]
    last[edge - 1] = solid[edge - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of other than white space, and bounds."""
    return run_spans(~WHITE[data], off)


def words(column: pa.Array, lower: bool = False) -> Coded:
    """The words of every document, dictionary-coded."""
    data, off = flat(column)
    if lower:
        data = lowered(data)
    starts, ends, bounds = word_spans(data, off)
    codes, distinct = coded(data[~WHITE[data]], np.concatenate(([0], np.cumsum(ends - starts))))
    return Coded(codes, bounds, distinct)


def coded(data: np.ndarray, offsets: np.ndarray):
    d = arrow_binary(data, offsets).dictionary_encode()
    return d.indices.to_numpy(), d.dictionary


def units(column: pa.Array) -> Coded:
    """White space with the word after it. Cut at such places, text has the same matches of
    public_tokenizers.PATTERN as whole: no match crosses from a non-space to a space, and what a
    match looks ahead at lies in its own unit. A cut after a non-ASCII space would change the
    matches of that run of spaces and is left out."""
    data, off = flat(column)
    white = WHITE[data]
    cut = white.copy()
    if len(data):
        cut[1:] &= ~white[:-1]
        cut[0] = False
    at = np.flatnonzero(cut)
    at = at[data[at - 1] >= 0x80]
    one, two, three = (data[np.maximum(at - k, 0)] for k in (1, 2, 3))
    wide = ((two == 0xC2) & ((one == 0x85) | (one == 0xA0))
            | (three == 0xE1) & (two == 0x9A) & (one == 0x80)
            | (three == 0xE2) & (two == 0x80) & ((one <= 0x8A) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF))
            | (three == 0xE2) & (two == 0x81) & (one == 0x9F)
            | (three == 0xE3) & (two == 0x80) & (one == 0x80))
    cut[at[wide]] = False
    cut[off[:-1][np.diff(off) > 0]] = True
    begins = np.flatnonzero(cut)
    codes, distinct = coded(data, np.concatenate((begins, [len(data)])))
    return Coded(codes, np.searchsorted(begins, off), distinct)


def ragged(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places starts[i], starts[i] + 1, ... of each i, one after the other."""
    ends = np.cumsum(lengths, dtype=np.int64)
    total, top = (int(ends[-1]), int(starts.max())) if len(ends) else (0, 0)
    kind = np.int32 if total + top < 1 << 31 else np.int64
    out = np.arange(total, dtype=kind)
    out += np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    return out


def hashes(distinct: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each value."""
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(x, seed) for x in distinct.to_pylist()), np.uint64, len(distinct))


def unique(a: np.ndarray) -> np.ndarray:
    """Sorted distinct values (by a sort, which is much faster here than np.unique)."""
    a = np.sort(a)
    return a[np.concatenate(([True], a[1:] != a[:-1]))] if len(a) else a


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (in place)."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: An odd number whose powers weigh the places of a fingerprint.
BASE = 0x9E3779B97F4A7C15


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def narrow(a: np.ndarray) -> np.ndarray:
    """The same whole numbers in the smallest unsigned type."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; multi-byte numbers are laid out by byte planes."""
    out = io.BytesIO()
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.itemsize).T if a.itemsize > 1 and len(a) else a
        np.save(out, np.array([a.dtype.str.encode()]), allow_pickle=False)
        np.save(out, np.ascontiguousarray(planes), allow_pickle=False)
    return zstandard.ZstdCompressor(level=1).compress(out.getbuffer())


def unpack(value: bytes) -> list[np.ndarray]:
    raw = io.BytesIO(zstandard.ZstdDecompressor().decompress(value))
    size, out = len(raw.getbuffer()), []
    while raw.tell() < size:
        kind = np.dtype(np.load(raw, allow_pickle=False)[0].decode())
        a = np.load(raw, allow_pickle=False)
        out.append(np.ascontiguousarray(a.T).view(kind).reshape(-1) if a.ndim == 2 else a.astype(kind, copy=False))
    return out


def pack_binary(values: pa.Array, *more: np.ndarray) -> bytes:
    data, off = flat(values)
    return pack(narrow(np.diff(off)), data, *more)


def unpack_binary(value: bytes) -> tuple[pa.Array, np.ndarray | None]:
    """The values, and the numbers packed with them."""
    lengths, data, *more = unpack(value)
    return arrow_binary(data, np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))), more[0] if more else None
