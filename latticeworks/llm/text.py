"""Vectorised helpers over Arrow string columns: words, 64-bit hashes, shingle sets.

All of them run inside a Spark task on one Arrow batch at a time; nothing here holds more than one slice of a batch.
Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, after A-Z became a-z.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that are worked on at once; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20
#: Longer words are hashed one by one.
LONG_WORD = 512

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER_BYTES = LOWER.tobytes()

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each buf[start:end]; equal bytes, equal hash."""
    size = ends - starts
    padded = np.concatenate([buf, np.zeros(16, np.uint8)])
    lanes = np.lib.stride_tricks.as_strided(padded, shape=(len(padded) - 8, 8), strides=(1, 1))
    out = np.full(len(starts), seed, dtype=np.uint64) ^ (size.astype(np.uint64) * _M1)
    todo = np.flatnonzero((size > 0) & (size <= LONG_WORD))
    at = 0
    while len(todo):
        lane = np.ascontiguousarray(lanes[starts[todo] + at]).view(np.uint64).ravel()
        lane &= _MASKS[np.minimum(size[todo] - at, 8)]
        out[todo] = mix(out[todo] * _M3 ^ lane)
        at += 8
        todo = todo[size[todo] > at]
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(buf[starts[i] : ends[i]].tobytes(), seed=seed)
    return mix(out)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Returns a worker's free memory to the system: workers live on between stages, and an executor's limit counts what they hold."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of a string column: (first row, UTF-8 bytes, row boundaries in them). A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
        row = to
    give_back()


def word_spans(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row and one past the last) of the words in lower-cased or raw bytes."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    word = ~IS_SPACE[buf]
    cut = np.zeros(len(buf) + 1, dtype=bool)
    cut[bounds] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | cut[1:-1]
    end = word.copy()
    end[:-1] &= ~word[1:] | cut[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, bounds)


def hashed_words(column: pa.Array, seed: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For slices of a column: (first row, word hashes, row boundaries in them)."""
    for row, buf, bounds in slices(column):
        low = LOWER[buf]
        starts, ends, rows = word_spans(low, bounds)
        yield row, hash_spans(low, starts, ends, seed), rows


_SHINGLE = np.array([0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], dtype=np.uint64)


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its `width`-word shingles; of a shorter text the one hash of all its words."""
    for _, words, rows in hashed_words(column):
        n = len(words)
        whole = np.zeros(max(n - width + 1, 0), np.uint64)
        for k in range(width):
            whole += words[k : n - width + 1 + k] * _SHINGLE[k % 5] * np.uint64(2 * (k // 5) + 1) if n >= width else whole
        whole = mix(whole)
        for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(whole[a : b - width + 1])
            elif b > a:
                yield mix(np.array([(words[a:b] * _SHINGLE[: b - a] if width <= 5 else words[a:b] * np.arange(1, b - a + 1, dtype=np.uint64) * _M1).sum(dtype=np.uint64)]) ^ np.uint64((b - a) * 0x5851F42D4C957F2D & (2**64 - 1)))
            else:
                yield np.zeros(0, np.uint64)
