"""Importance resampling towards a target's n-gram distribution, with bit-sliced weights."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerokpi.llm.common import written
from aerokpi.llm.hashing import LOWER
from aerokpi.llm.ranks import positions
from aerokpi.llm.units import chunks

#: Buckets of a feature; bounds what the driver gathers and what tasks hold.
BUCKETS = 10000
#: Spans of up to this many bytes are hashed side by side, longer ones one by one.
SIDE_BY_SIDE = 48

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)

_IS_WORD = np.zeros(256, dtype=bool)  # of lower-cased bytes: 0-9, a-z and all of the non-ASCII characters
_IS_WORD[0x30:0x3A] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True


def crc32_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of every span [start, end) of the bytes."""
    out = np.full(len(starts), 0xFFFFFFFF, dtype=np.uint32)
    length = ends - starts
    order = np.argsort(length, kind="stable")[::-1]  # longest first: those still open are a prefix
    order = order[length[order] <= SIDE_BY_SIDE]
    at, n = starts[order], length[order]
    state = out[order]
    for k in range(int(n[0]) if len(n) else 0):
        open_ = int(np.searchsorted(-n, -k, "left"))  # spans longer than k bytes
        c = state[:open_]
        state[:open_] = _CRC[(c ^ data[at[:open_] + k]) & 0xFF] ^ (c >> np.uint32(8))
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(length > SIDE_BY_SIDE):
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes())
    return out


def word_bytes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all words, one space between, with their starts, ends and row numbers."""
    low = LOWER[data]
    word = _IS_WORD[low]
    row_starts = np.zeros(len(data) + 1, dtype=bool)
    row_starts[offsets] = True
    edge = word.copy()
    edge[1:] &= ~word[:-1] | row_starts[1:-1]
    first = np.flatnonzero(edge)
    rows = np.searchsorted(offsets, first, "right") - 1
    number = np.cumsum(edge) - 1  # word of each byte
    number = number[word]
    out = np.full(len(number) + len(first), 0x20, dtype=np.uint8)
    out[np.arange(len(number)) + number] = low[word]
    length = np.bincount(number, minlength=len(first))
    ends = np.cumsum(length + 1) - 1 if len(first) else np.empty(0, dtype=np.int64)
    return out, ends - length, ends, rows


def features(data: np.ndarray, offsets: np.ndarray, width: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and row of every run of 1 to `width` words of a row, and words by row."""
    text, starts, ends, rows = word_bytes(data, offsets)
    found, where = [], []
    for w in range(width):
        i = np.arange(max(0, len(starts) - w))
        i = i[rows[i] == rows[i + w]] if w else i
        found.append(crc32_of(text, starts[i], ends[i + w]).astype(np.int64) % buckets)
        where.append(rows[i])
    return np.concatenate(found), np.concatenate(where), np.bincount(rows, minlength=len(offsets) - 1)


def bucket_counts(docs: DataFrame, text_col: str, width: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket; one row a bucket reaches the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                total += np.bincount(features(data, offsets, width, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    rows = docs.select(text_col).mapInArrow(work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, dtype=np.int64)
    out[rows["bucket"]] = rows["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log ratio) of each bucket's smoothed share of target and raw features."""
    s, t, buckets = raw.astype(float), target.astype(float), len(raw)
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def planes_of(values: np.ndarray) -> np.ndarray:
    """Bit planes of signed integers in two's complement, the sign's plane last: plane i holds
    bit i of every value, 64 values a word."""
    n = max(int(np.abs(values).max(initial=0)).bit_length() + 1, 1)
    words = -(-len(values) // 64)
    out = np.zeros((n, words), dtype=np.uint64)
    at = np.arange(len(values))
    for i in range(n):
        np.bitwise_or.at(out[i], at >> 6, ((values >> i) & 1).astype(np.uint64) << (at & 63).astype(np.uint64))
    return out


def weights_of(bucket: np.ndarray, row: np.ndarray, n_rows: int, gain_planes: np.ndarray, buckets: int) -> np.ndarray:
    """Sum over each row's features of their buckets' gains.

    A row's bucket counts become bit planes; a plane of the counts AND a plane of the gains
    has as many bits set as buckets have both, each worth a power of two, negative for the
    gains' sign plane. All sums are exact integers."""
    out = np.zeros(n_rows, dtype=np.int64)
    cell, count = np.unique(row * buckets + bucket, return_counts=True)
    row, bucket = cell // buckets, cell % buckets
    signs = len(gain_planes) - 1
    plane = 0
    while len(count):
        here = (count & 1) == 1
        r, b = row[here], bucket[here]
        if len(r):
            docs, dense = np.unique(r, return_inverse=True)
            word = dense * gain_planes.shape[1] + (b >> 6)  # ascending, since the cells are
            lead = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            bits = np.zeros(len(docs) * gain_planes.shape[1], dtype=np.uint64)
            bits[word[lead]] = np.bitwise_or.reduceat(np.uint64(1) << (b & 63).astype(np.uint64), lead)
            bits = bits.reshape(len(docs), -1)
            total = np.zeros(len(docs), dtype=np.int64)
            for i, gain in enumerate(gain_planes):
                both = np.bitwise_count(bits & gain).sum(axis=1, dtype=np.int64) << i
                total += -both if i == signs else both
            out[docs] += total << plane
        more = count > 1
        row, bucket, count = row[more], bucket[more], count[more] >> 1
        plane += 1
    return out


def weighed(docs: DataFrame, keep: list[str], text_col: str, gain: np.ndarray, width: int) -> DataFrame:
    """The columns `keep` with n_words, n_features and weight."""
    buckets = len(gain)
    shared = docs.sparkSession.sparkContext.broadcast(planes_of(gain))  # a few dozen planes of the buckets
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, planes = to_arrow_schema(schema), shared.value
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(len(keep))):
                bucket, row, words = features(data, offsets, width, buckets)
                n = np.bincount(row, minlength=b - a)
                weight = weights_of(bucket, row, b - a, planes, buckets)
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(a, b - a) for i in range(len(keep))]
                                                 + [pa.array(words), pa.array(n), pa.array(weight)], schema=arrow)

    return docs.select(*keep, text_col).mapInArrow(work, schema)


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise of a key, 1000 times, floored: from the first 32 bits of a SHA-256."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    uniform = (F.conv(head, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(uniform))).cast("long")


def resample_to_target(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
                       width: int = 1, buckets: int = BUCKETS, percent: int = 10, min_words: int = 20, seed: int = 2024) -> DataFrame:
    """One row per document: id, n_features, weight, score, rank (null where not drawn).

    Features are all runs of 1 to `width` words (digits, letters and non-ASCII characters,
    A-Z lower-cased), in the bucket that their CRC-32 gives. A bucket's gain compares its
    smoothed shares of the target's and of all documents' features; a document's weight is
    the exact sum of its features' gains, by bit planes. The score adds Gumbel noise from the
    id; of the documents with `min_words` words, `percent` % of the highest scores are drawn
    without replacement, ties to the smaller id, and ranked from 1. Ranks come from ranges
    of scores, so no task sees them all. The driver holds one count a bucket.

    A null or empty text has no features and weight 0. A null id has the noise of an empty
    one and comes after all ids. Rows that repeat an id and text tie and are ranked one after
    the other, in any order. An empty target makes every bucket's gain follow the documents
    alone. An empty table gives an empty result; other columns are ignored."""
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    wanted = target.select(F.coalesce(F.col(target_text), F.lit("")).alias("text"))
    gain = gains(bucket_counts(plain, "text", width, buckets), bucket_counts(wanted, "text", width, buckets))
    scored = written(weighed(plain, ["id"], "text", gain, width).withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "scored")
    able = scored.where(F.col("n_words") >= min_words)
    drawn = able.count() * percent // 100
    ranked = positions(able.withColumn("all", F.lit(0)), "all", [F.col("score").desc(), F.col("id").asc_nulls_last()], "ranked")
    rank = F.when(F.col("pos") < drawn, F.col("pos") + 1)
    columns = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    return ranked.select(*columns, rank.alias("rank")).unionByName(
        scored.where(F.col("n_words") < min_words).select(*columns, F.lit(None).cast("long").alias("rank")))


def drawn_rows(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that `resample_to_target` draws, with all their columns; rows with a null
    id are left out, rows that repeat a drawn id stay together."""
    ids = resample_to_target(docs, target, id_col, text_col, **options).where("rank IS NOT NULL").select(F.col(id_col).alias("drawn_id")).distinct()
    return docs.join(ids, docs[id_col] == ids["drawn_id"], "left_semi")
