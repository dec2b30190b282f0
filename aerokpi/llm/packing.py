"""Packing of token sequences by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from aerokpi.llm.units import UnitCache, bare_units, chunks, folded

#: Longest piece that shares a window with others; longer rests are cut into such pieces.
MAX_PIECE = 512
#: Pieces that are differenced together.
BLOCK = 1024
_ENCODERS: dict[str, UnitCache] = {}


def difference(lengths: np.ndarray, windows: int) -> tuple[np.ndarray, np.ndarray]:
    """Assign each length to one of `windows` windows; returns (window of each, window sums).

    Every length starts as a partial partition whose other windows are empty. The two
    partitions with the largest spread are merged, the fullest window of one with the
    emptiest of the other, until one partition is left."""
    n = len(lengths)
    parent = np.arange(n)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    heap: list[tuple[int, int]] = []
    for i, x in enumerate(lengths.tolist()):  # sums ascend
        sums = np.zeros(windows, dtype=np.int64)
        roots = np.full(windows, -1, dtype=np.int64)
        sums[-1], roots[-1] = x, i
        parts.append((sums, roots))
        heap.append((-(x - (0 if windows > 1 else x)), i))
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        (sa, ra), (sb, rb) = parts[a], parts[b]
        sb, rb = sb[::-1], rb[::-1]
        sums, roots = sa + sb, np.where(ra >= 0, ra, rb)
        both = (ra >= 0) & (rb >= 0)
        parent[rb[both]] = ra[both]
        order = np.argsort(sums, kind="stable")
        parts[a], parts[b] = (sums[order], roots[order]), None  # type: ignore[assignment]
        heapq.heappush(heap, (-int(sums[order[-1]] - sums[order[0]]), a))
    if not n:
        return np.empty(0, dtype=np.int64), np.zeros(windows, dtype=np.int64)
    sums, roots = parts[heap[0][1]]
    while True:
        up = parent[parent]
        if (up == parent).all():
            break
        parent = up
    at = np.full(n, -1, dtype=np.int64)
    at[roots[roots >= 0]] = np.flatnonzero(roots >= 0)
    return at[parent], sums


def pack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Window of each length (all at most `capacity`) and the number of windows: the
    fewest that could do, one more whenever a window exceeds the capacity."""
    windows = max(1, -(-int(lengths.sum()) // capacity))
    while True:
        at, sums = difference(lengths, windows)
        if not len(sums) or sums.max() <= capacity:
            return at, windows
        windows += 1


def cut(n_tokens: int, capacity: int, max_piece: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full windows, then a rest in pieces of up to max_piece."""
    full = n_tokens // capacity
    pieces = [(i * capacity, capacity) for i in range(full)]
    return pieces + [(s, min(max_piece, n_tokens - s)) for s in range(full * capacity, n_tokens, max_piece)]


def tokenizer_cache(path: str) -> UnitCache:
    """One cache per Python worker and tokenizer file."""
    if path not in _ENCODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        plain = re.compile("[a-z]+").fullmatch  # one word that is its own normal form
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()

        model = tokenizer.model

        def encode(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            texts = [u.decode() for u in units]
            others = iter(tokenizer.encode_batch([t for t in texts if not plain(t)], add_special_tokens=False))
            found = [[token.id for token in model.tokenize(t)] if plain(t) else next(others).ids for t in texts]
            lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            return np.fromiter((i for ids in found for i in ids), dtype=np.uint32, count=int(lengths.sum())), lengths

        _ENCODERS[path] = UnitCache(encode)
    return _ENCODERS[path]


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, separator: int = 1, id_col: str = "doc_id",
                   text_col: str = "text", max_piece: int = MAX_PIECE, block: int = BLOCK) -> DataFrame:
    """One row per piece of a document: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The tokenizer must lower-case text, drop white space and never join letters and ASCII
    marks, so words are encoded independently; `separator` ends every document. Whole windows of a document are
    sequences of their own; the rest, cut into pieces of at most `max_piece`, is packed
    `block` pieces at a time by Karmarkar-Karp differencing. Packing follows each task's
    rows, so nothing is shuffled and a task holds one block of pieces and one chunk of text;
    sequence ids are (task's partition << 40) + a count.

    A null or empty text is one separator. Repeated rows and null ids are packed like any
    other. An empty table gives no rows; other columns are ignored.
    """
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type)] + [
        T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        cache = tokenizer_cache(tokenizer_path)
        next_id = TaskContext.get().partitionId() << 40
        rest: list[tuple] = []  # (id, start, length, crc, doc_tokens)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

        def packed(pieces: list[tuple]) -> Iterator[tuple]:
            nonlocal next_id
            at, windows = pack(np.array([p[2] for p in pieces], dtype=np.int64), capacity)
            used, fill = np.full(windows, -1, dtype=np.int64), np.zeros(windows, dtype=np.int64)
            for piece, w in zip(pieces, at.tolist()):
                if used[w] < 0:
                    used[w], next_id = next_id, next_id + 1
                yield (*piece, int(used[w]), int(fill[w]))
                fill[w] += piece[2]

        for rows in batches:
            ids_of = rows.column(0).to_pylist()
            for a, b, data, offsets in chunks(rows.column(1)):
                units, unit_rows = bare_units(folded(data), offsets)
                ids, at = cache.ids(units, unit_rows, b - a)
                out: list[tuple] = []
                for i in range(b - a):
                    tokens = np.append(ids[at[i] : at[i + 1]], np.uint32(separator)).astype("<u4")
                    n = len(tokens)
                    for start, length in cut(n, capacity, max_piece):
                        row = (ids_of[a + i], start, length, zlib.crc32(tokens[start : start + length].tobytes()), n)
                        if length == capacity:
                            out.append((*row, next_id, 0))
                            next_id += 1
                        else:
                            rest.append(row)
                while len(rest) >= block:
                    out += packed(rest[:block])
                    rest = rest[block:]
                if out:
                    yield batch(out)
        if rest:
            yield batch(list(packed(rest)))

    return docs.select(id_col, text_col).mapInArrow(work, schema)
