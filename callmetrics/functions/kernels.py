"""Byte-level NumPy kernels over Arrow text columns.

Everything works on UTF-8 bytes of a few rows at a time, so memory follows the
longest single text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

# Bytes of words once punctuation is left out: ASCII letters and digits, and
# every byte of a longer code point.
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def text_buffer(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the row offsets; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = pc.fill_null(array, "")
    width = np.int64 if pa.types.is_large_string(array.type) else np.int32
    _, offsets, data = array.buffers()
    if offsets is None or len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    edges = np.frombuffer(offsets, width)[array.offset:array.offset + len(array) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), edges


def pieces(data: np.ndarray, edges: np.ndarray, budget: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) of runs of rows within a budget; a longer row comes alone."""
    row, end = 0, len(edges) - 1
    while row < end:
        stop = max(row + 1, int(np.searchsorted(edges, edges[row] + budget, "right")) - 1)
        yield row, stop, data[edges[row]:edges[stop]], edges[row:stop + 1] - edges[row]
        row = stop


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (finaliser of a multiplicative hash)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    forward, backward = np.ones(size, np.uint64), np.ones(size, np.uint64)
    forward[1:], backward[1:] = np.uint64(_BASE), np.uint64(_BASE_INVERSE)
    return np.multiply.accumulate(forward), np.multiply.accumulate(backward)


def rolling_sums(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Karp-Rabin prefix sums and the factors that make windows comparable:
    the hash of [i, j) is ``(sums[j] - sums[i]) * factors[i]`` modulo 2**64."""
    size = 1 << max(10, len(values).bit_length())
    forward, backward = _powers(size)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * forward[:len(values)], out=sums[1:])
    return sums, backward


def word_spans(data: np.ndarray, edges: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of ``inside`` bytes within a row."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    firsts = edges[:-1][edges[:-1] < edges[1:]]  # rows that are not empty
    begin[firsts] = inside[firsts]
    lasts = firsts[1:] - 1
    end[lasts] = inside[lasts]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(edges, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span."""
    sums, factors = rolling_sums(data.astype(np.uint64) + np.uint64(1))
    return mix((sums[ends] - sums[starts]) * factors[starts] + (ends - starts).astype(np.uint64))
