"""White-space units of Arrow text columns, coded against a bounded cache.

Tokenizers treat a text as a sequence of units that do not influence each
other. Coding a batch's units with Arrow's dictionary encoding lets each
distinct unit be tokenized once; a text's ids are then gathered with numpy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from aerokpi.llm.hashing import IS_SPACE, LOWER, buffers, by_bytes, word_spans

#: Bytes of text handled at once, unless one text is larger.
CHUNK_BYTES = 2 << 20


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of row ranges of bounded size."""
    data, offsets = buffers(column)
    for a, b in by_bytes(offsets, limit):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: ASCII marks other than the apostrophe, with which contractions begin.
_MARK = np.zeros(256, dtype=bool)
_MARK[[b for b in b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"]] = True


def may_hold_special(data: np.ndarray) -> bool:
    """Whether a special token such as <|endoftext|> may occur, within which nothing is cut."""
    return b"<|" in data.tobytes()


def inner_cuts(data: np.ndarray) -> np.ndarray:
    """Bytes before which a word is cut as well: between an ASCII letter and an ASCII mark. The
    tokenizers' patterns never join the two, so this only makes units recur more often."""
    if len(data) < 2 or may_hold_special(data):
        return np.empty(0, dtype=np.int64)
    letter, mark = _LETTER[data], _MARK[data]
    return np.flatnonzero((letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])) + 1


def folded(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased, for tokenizers that do so: not where a special token may
    occur, nor before a byte beyond ASCII, which may belong to a combining mark."""
    if len(data) < 2 or may_hold_special(data):
        return data
    plain = np.append(data[1:] < 128, True)
    return np.where(plain, LOWER[data], data)


def bare_units(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words between ASCII white space, cut at `inner_cuts`, and their rows."""
    starts, ends, rows = word_spans(data, offsets)
    cuts = inner_cuts(data)
    cuts = cuts[~np.isin(cuts, offsets)]
    if len(cuts):
        starts, ends = np.sort(np.concatenate((starts, cuts))), np.sort(np.concatenate((ends, cuts)))
        rows = np.searchsorted(offsets, starts, "right") - 1
    at = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    text = data[~IS_SPACE[data]] if len(data) else data
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(text))]), rows


def other_space(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that may hold white space outside 0x20 and 0x09-0x0D (by first bytes of its UTF-8)."""
    if len(data) < 2:
        return np.empty(0, dtype=np.int64)
    a, b = data[:-1], data[1:]
    odd = ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & (b == 0x9A)) | \
        ((a == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((a == 0xE3) & (b == 0x80))
    odd[:] |= (a >= 0x1C) & (a <= 0x1F)
    return np.unique(np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1)


def spaced_units(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Units of white space and the word after it (a row's last white space is a unit of
    its own), and their rows. A row with other white space is one unit."""
    _, ends, rows = word_spans(data, offsets)
    odd = other_space(data, offsets)
    if len(odd):
        keep = ~np.isin(rows, odd)
        ends = ends[keep]
    cut = np.zeros(len(data) + 1, dtype=bool)
    for places in (ends, offsets, inner_cuts(data)):  # every row's end closes its last unit
        cut[places] = True
    cuts = np.flatnonzero(cut)
    at = cuts.astype(np.int32)
    rows = np.searchsorted(offsets, cuts[:-1], "right") - 1
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))]), rows


class UnitCache:
    """Ids of distinct units, encoded once; emptied when it holds `limit` units."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = 600_000):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.codes: dict[bytes, int] = {}
        self.lengths = np.empty(0, dtype=np.int64)
        self.starts = np.empty(0, dtype=np.int64)
        self.flat = np.empty(0, dtype=np.uint32)

    def ids(self, units: pa.Array, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows in order, and each row's offsets into them."""
        coded = units.dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.codes) + len(words) > self.limit:
            self._clear()
        new = [w for w in words if w not in self.codes]
        if new:
            flat, lengths = self.encode(new)
            for i, w in enumerate(new, len(self.codes)):
                self.codes[w] = i
            self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(lengths) - lengths))
            self.lengths = np.concatenate((self.lengths, lengths))
            self.flat = np.concatenate((self.flat, flat))
        look = np.fromiter((self.codes[w] for w in words), dtype=np.int64, count=len(words))
        code = look[coded.indices.to_numpy()] if len(words) else np.empty(0, dtype=np.int64)
        lengths, starts = self.lengths[code], self.starts[code]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.arange(total) + np.repeat(starts - ends + lengths, lengths)]
        per_row = np.zeros(n_rows, dtype=np.int64)
        np.add.at(per_row, rows, lengths)
        return ids, np.concatenate(([0], np.cumsum(per_row)))
