"""Flat numpy views of Arrow text columns: words, word hashes and shingle hashes of whole texts.

Everything here runs inside a Spark task on one slice of an Arrow batch.  A
slice holds at most ``CHUNK_BYTES`` of text, or one text that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 256 << 10

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_TABLE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64)
_POSITION = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 64)
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(batch: pa.RecordBatch, column: str, max_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose ``column`` holds at most ``max_bytes`` (a longer text comes alone)."""
    n = batch.num_rows
    if not n:
        return
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    ends = np.cumsum(lengths)
    a = 0
    while a < n:
        b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + max_bytes, side="right"))
        b = max(b, a + 1)
        yield batch.slice(a, b - a)
        a = b
    pa.default_memory_pool().release_unused()  # workers are kept between tasks; what a batch needed goes back


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (from 0) of a text column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word ``[^\\x20\\x09-\\x0D]+`` and the first word of each text (n + 1 bounds)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    letter = ~_SPACE[data]
    heads = offsets[:-1][np.diff(offsets) > 0]
    before = np.empty_like(letter)
    before[0] = False
    before[1:] = letter[:-1]
    before[heads] = False
    start = np.flatnonzero(letter & ~before)
    after = np.empty_like(letter)
    after[-1] = False
    after[:-1] = letter[1:]
    after[heads[1:] - 1] = False
    end = np.flatnonzero(letter & ~after) + 1
    return start, end, np.searchsorted(start, offsets)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return _LOWER[data]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; equal bytes have equal hashes wherever they stand."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def shingles(word_hash: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text and their bounds; a text of fewer words is one shingle, none has none."""
    n = np.diff(bounds)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_bounds = np.concatenate([[0], np.cumsum(count)])
    first = np.repeat(bounds[:-1] - out_bounds[:-1], count) + np.arange(out_bounds[-1])
    padded = np.concatenate([word_hash, np.zeros(k, np.uint64)])
    rest = np.repeat(bounds[1:], count) - first
    out = np.zeros(len(first), np.uint64)
    for j in range(k):
        out += np.where(rest > j, padded[first + j] * _POSITION[j] + _POSITION[j + 32], np.uint64(0))
    return mix(out), out_bounds


def distinct(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text and their bounds."""
    parts = [np.unique(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return (np.concatenate(parts) if parts else values[:0]), np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]).astype(np.int64)


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed k-word shingles of each lower-cased text, sorted, with bounds."""
    data, offsets = flat(column)
    data = lower(data)
    start, end, bounds = words(data, offsets)
    values, at = shingles(span_hashes(data, start, end), bounds, k)
    return distinct(values, at)
