"""Vectorised hashing of text bytes inside Arrow batches.

All functions work on the data buffer of an Arrow string or binary column
(one contiguous uint8 array plus row offsets), so no per-word Python
objects are made. Hashes are 64-bit polynomial sums over a table of random
byte values followed by a bit mixer; they are the same in every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
BYTE_VALUES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 5
_BASE_INV = pow(_BASE, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base**i mod 2**64 for i < n (kept between calls)."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """p with p[j] - p[i] == sum(values[k] * base**k for i <= k < j)."""
    out = np.empty(len(values) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(values * powers(len(values)), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed hash of every span [start, end), independent of where it lies."""
    h = (sums[ends] - sums[starts]) * powers(len(sums) + 1, _BASE_INV)[starts]
    return mix(h + (ends - starts).astype(np.uint64))


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Mixed hash of data[i : i + width] for every i (empty if data is shorter)."""
    n = len(data) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    sums = prefix_sums(BYTE_VALUES[data])
    return mix((sums[width:] - sums[:n]) * powers(n, _BASE_INV))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=kind, count=len(column) + 1 + column.offset)[column.offset :].astype(np.int64) \
        if offs is not None else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    lo, hi = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    return raw[lo:hi], offsets - lo


def by_bytes(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at least one row and at most `limit` bytes where a row allows it."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the white-space separated words of all rows."""
    if not len(data):
        none = np.empty(0, dtype=np.int64)
        return none, none, none
    word = ~IS_SPACE[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    before = np.empty(len(data), dtype=bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | first[:-1]))
    after = np.empty(len(data), dtype=bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | first[1:])) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash (A-Z lower-cased) and row number of every word."""
    starts, ends, rows = word_spans(data, offsets)
    return span_hashes(prefix_sums(BYTE_VALUES[LOWER[data]]), starts, ends), rows


def shingle_hashes(words: np.ndarray, rows: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and row numbers of all runs of `width` words within a row; a row
    with fewer words gives one hash of its whole sequence."""
    count = np.bincount(rows, minlength=n_rows)
    sums = prefix_sums(words)
    at = np.concatenate(([0], np.cumsum(count)))
    i = np.arange(len(words), dtype=np.int64)
    full = i + width <= at[rows + 1]
    short = np.flatnonzero((count > 0) & (count < width))
    starts = np.concatenate((i[full], at[short]))
    ends = np.concatenate((i[full] + width, at[short + 1]))
    return span_hashes(sums, starts, ends), np.concatenate((rows[full], short))
