"""Elias-Fano coded monotone sequences, and files of named arrays that are memory-mapped."""

from __future__ import annotations

import json
import os
import tempfile

import numpy as np

from voltloom.llm.files import Shard, opened


def coded(values: np.ndarray) -> dict[str, np.ndarray]:
    """Non-decreasing whole numbers: packed low bits, and high parts as gaps in a bit array."""
    n = len(values)
    top = int(values[-1]) if n else 0
    bits = max(0, (top // n).bit_length() - 1) if n else 0
    v = values.astype(np.uint64)
    low = (v[:, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8) if bits else np.empty((n, 0), np.uint8)
    high = np.zeros(n + (top >> bits) + 1, np.uint8)
    high[(v >> np.uint64(bits)).astype(np.int64) + np.arange(n)] = 1
    return {"head": np.array([n, bits], np.int64), "low": np.packbits(low.reshape(-1)), "high": np.packbits(high)}


def decoded(parts: dict[str, np.ndarray]) -> np.ndarray:
    n, bits = (int(x) for x in parts["head"])
    out = (np.flatnonzero(np.unpackbits(parts["high"]))[:n] - np.arange(n)) << bits
    if bits and n:
        low = np.unpackbits(parts["low"])[:n * bits].reshape(n, bits)
        for k in range(bits):
            out |= low[:, k].astype(np.int64) << k
    return out


def ranged(values: np.ndarray, pointers: np.ndarray) -> np.ndarray:
    """Ranges of increasing values as one increasing sequence: each range starts above the last
    number of the range before it. Every range holds one value at least."""
    if not len(values):
        return values
    last = values[pointers[1:] - 1] + 1
    base = np.cumsum(last) - last
    return values + 1 + np.repeat(base, np.diff(pointers))


def found(sequence: np.ndarray, pointers: np.ndarray, which: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Successor search of value[i] in range which[i] of a ranged() sequence: its place, or -1."""
    if not len(sequence):
        return np.full(len(value), -1, np.int64)
    ok = which >= 0
    start = pointers[np.where(ok, which, 0)]
    base = np.where(start > 0, sequence[np.maximum(start - 1, 0)], 0)
    target = np.where(value >= 0, value, 0) + 1 + base
    at = np.searchsorted(sequence, target)
    hit = ok & (value >= 0) & (at < pointers[np.where(ok, which, 0) + 1])
    hit &= sequence[np.minimum(at, len(sequence) - 1)] == target
    return np.where(hit, at, -1)


def save(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    out, at, index = Shard(folder, name), 0, {}
    for key, a in arrays.items():
        index[key] = [a.dtype.str, at, a.nbytes]
        at += a.nbytes
    head = json.dumps(index).encode()
    out.write(np.array([len(head)], "<i8").tobytes() + head)
    for a in arrays.values():
        out.write(np.ascontiguousarray(a).tobytes())
    out.commit()


def mapped(folder: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped; a remote file is mapped from a local copy whose name
    is gone before the first read, so that nothing stays on the executor."""
    fs, top = opened(folder)
    path, copy = f"{top}/{name}", None
    if fs.type_name != "local":
        handle, copy = tempfile.mkstemp()
        with os.fdopen(handle, "wb") as out, fs.open_input_stream(path) as source:
            while data := source.read(1 << 22):
                out.write(data)
    raw = np.memmap(copy or path, np.uint8, "r")
    if copy:
        os.unlink(copy)
    size = int(raw[:8].view("<i8")[0])
    index = json.loads(raw[8:8 + size].tobytes())
    return {k: np.frombuffer(raw[8 + size + at:8 + size + at + n].tobytes() if (8 + size + at) % 8 else raw[8 + size + at:8 + size + at + n], kind)
            for k, (kind, at, n) in index.items()}
