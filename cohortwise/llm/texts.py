"""Words, hashes and packed arrays of whole texts, as numpy code that runs inside Arrow tasks.

A task works on one piece of about PIECE bytes of text at a time, small enough for a CPU's
cache, or on one document if that is longer, and gathers what it finds for about GROUP bytes.
Words are hashed to 64 bits without a Python loop over words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
GROUP = 4 << 20
STEP = 1 << 18
U64 = np.uint64

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15
INVERSE = pow(_BASE, -1, 1 << 64)


def release() -> None:
    """Give freed memory back to the machine: a Python worker lives through many stages and would keep its peak."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def trimmed(task: Callable) -> Callable:
    """A task over batches that releases what it has freed when it ends."""

    @wraps(task)
    def run(batches, *args, **options):
        try:
            yield from task(batches, *args, **options)
        finally:
            release()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ordered hash of two hashes."""
    return mix(a * U64(0xD6E8FEB86659FD93) + mix(b) + U64(0x632BE59BD9B4E019))


_known: dict[int, np.ndarray] = {}


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    if base not in _known or len(_known[base]) < n:
        out = np.full((n + STEP) // STEP * STEP, base, U64)
        out[0] = 1
        _known[base] = np.multiply.accumulate(out)
    return _known[base][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash; `window_hash` turns differences into hashes."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * powers(len(data)), out=out[1:])
    return out


def window_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for each pair of bounds; equal content gives equal hashes."""
    raw = (sums[end] - sums[start]) * powers(len(sums), INVERSE)[start]
    return mix(raw + (end - start).astype(U64) * U64(0xA0761D6478BD642F))


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n+1 offsets) of a string or binary column; null is empty."""
    values = batch.column(batch.schema.get_field_index(name))
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if values.null_count:
        values = values.fill_null("" if pa.types.is_string(values.type) or pa.types.is_large_string(values.type) else b"")
    width = np.int64 if pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type) else np.int32
    _, offsets, data = values.buffers()
    n = len(values)
    at = np.frombuffer(offsets, width)[values.offset:values.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def pieces(batch: pa.RecordBatch, name: str = "text", most: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows with about `most` bytes."""
    raw, at = column(batch, name)
    n, first = len(at) - 1, 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield first, end, raw[at[first]:at[end]], at[first:end + 1] - at[first]
        first = end


def groups(batch: pa.RecordBatch, name: str, find, most: int = GROUP) -> Iterator[list[np.ndarray]]:
    """Concatenated arrays that `find(first row, data, offsets)` returns for the pieces of each group of rows."""
    found, size = [], 0
    for first, _, data, offsets in pieces(batch, name):
        got = find(first, data, offsets)
        if len(got[0]):
            found.append(got)
        size += len(data)
        if size >= most and found:
            yield [np.concatenate(x) for x in zip(*found)]
            found, size = [], 0
    if found:
        yield [np.concatenate(x) for x in zip(*found)]


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each maximal run of bytes other than white space (or `space`), within its row."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    solid = ~space[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True  # a row's first byte begins a word even after a word of the row before
    start = np.flatnonzero(solid & (begins[:-1] | np.concatenate(([True], ~solid[:-1]))))
    end = np.flatnonzero(solid & (begins[1:] | np.concatenate((~solid[1:], [True])))) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def ragged(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each length n, one after another."""
    lengths = np.asarray(lengths, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def binary(chunks: list[bytes]) -> pa.Array:
    return pa.array(chunks, pa.binary())
