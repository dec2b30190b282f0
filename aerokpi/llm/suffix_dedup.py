"""Removal of repeated byte strings by merging shard Burrows-Wheeler transforms."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerokpi.llm.common import discard, written
from aerokpi.llm.hashing import BYTE_VALUES, mix, prefix_sums, span_hashes, window_hashes
from aerokpi.llm.units import chunks

LENGTH = 100
#: Bytes of an anchor: every string of LENGTH bytes is looked up by the anchor that it chooses.
ANCHOR = 32
#: Blocks (the symbols of the transforms) that a string of LENGTH bytes consists of.
BLOCKS = 4
#: Text of one bucket's shards and anchors of one bucket, for sizing the number of buckets.
BUCKET_BYTES = 128 << 10
BUCKET_ANCHORS = 200_000
#: Shards that a bucket's pieces are dealt into.
SHARDS = 8
#: One text in so many is looked through for anchors that very many texts share, how many of
#: them are told apart, and sampled texts that make an anchor such a one, at every size of the
#: input. Which anchors are found only decides how the work is split, never the result.
SAMPLE = 64
HOT_CAPACITY = 1 << 16
HOT_LEAST = 32
PIECE = np.dtype([("anchor", "<u8"), ("content", "<u8"), ("doc", "<i8"), ("row", "<i8"), ("start", "<u4"), ("count", "<u2")])
RANGE = "doc long, row long, start long, stop long"


def leftmost_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost minimum of values[i : i + width] for every i."""
    best, at, span = values, np.arange(len(values), dtype=np.int32), 1
    while span < width:
        step = min(span, width - span)
        n = len(best) - step
        right = best[step:] < best[:n]
        at = np.where(right, at[step:], at[:n])
        best = np.where(right, best[step:], best[:n])
        span += step
    return at


def pieces(data: np.ndarray, offsets: np.ndarray, docs: np.ndarray, marks: np.ndarray, length: int, hot: np.ndarray | None = None) -> np.ndarray:
    """The runs of strings of `length` bytes that choose the same anchor, as PIECE records.

    A string's anchor is its leftmost ANCHOR-byte window of least hash, so equal strings
    choose anchors of equal hash at the same place within them. `content` is the hash of all
    bytes of a run's strings and of where their anchor lies. The strings of a hot anchor
    are pieces of their own, each under its own hash instead of the anchor's."""
    width = length - ANCHOR + 1
    if len(data) < length:
        return np.empty(0, dtype=PIECE)
    hashes = window_hashes(data, ANCHOR)
    anchor = leftmost_minimum(hashes, width)
    start = np.arange(len(anchor))
    row = np.searchsorted(offsets, start, "right") - 1
    inside = np.flatnonzero(start + length <= offsets[row + 1])
    if not len(inside):
        return np.empty(0, dtype=PIECE)
    anchor, row = anchor[inside], row[inside]
    new = np.ones(len(inside), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(inside)))
    begin = inside[first]
    sums = prefix_sums(BYTE_VALUES[data])
    rows = row[first]
    out = np.empty(len(first), dtype=PIECE)
    out["anchor"] = hashes[anchor[first]]
    out["content"] = mix(span_hashes(sums, begin, begin + count + length - 1) + (anchor[first] - begin).astype(np.uint64))
    out["doc"], out["row"] = docs[rows], marks[rows]
    out["start"], out["count"] = begin - offsets[rows], count
    split = np.isin(out["anchor"], hot) if hot is not None and len(hot) else np.zeros(len(out), dtype=bool)
    if not split.any():
        return out
    each = np.repeat(out[split], count[split])
    ends = np.cumsum(count[split])
    place = np.arange(len(each)) - np.repeat(ends - count[split], count[split])
    at = np.repeat(begin[split], count[split]) + place
    left, right = span_hashes(sums, at, at + length // 2), span_hashes(sums, at + length // 2, at + length)
    each["anchor"], each["content"] = mix(left ^ (right * np.uint64(3))), mix(left * np.uint64(5) + right)
    each["start"] += place.astype(np.uint32)
    each["count"] = 1
    return np.concatenate((out[~split], each))


def earliest(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pieces with equal content the earliest, and all that start later than it."""
    order = np.lexsort((found["start"], found["doc"], found["content"], found["anchor"]))
    found = found[order]
    head = np.ones(len(found), dtype=bool)
    head[1:] = (found["anchor"][1:] != found["anchor"][:-1]) | (found["content"][1:] != found["content"][:-1])
    lead = found[np.flatnonzero(head)[np.cumsum(head) - 1]] if len(found) else found
    later = (found["doc"] != lead["doc"]) | (found["start"] != lead["start"])
    return found[head], found[later]


def ranges(found: np.ndarray, length: int) -> list[np.ndarray]:
    """Columns of RANGE: the bytes that all strings of the pieces cover."""
    start = found["start"].astype(np.int64)
    return [found["doc"], found["row"], start, start + found["count"] + length - 1]


def merged_ranges(found: np.ndarray, length: int) -> list[np.ndarray]:
    """Columns of RANGE: the same bytes as `ranges`, in the longest runs that a text's pieces make."""
    doc, row, start, stop = ranges(found[np.lexsort((found["start"], found["row"], found["doc"]))], length)
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (start[1:] > stop[:-1])
    first = np.flatnonzero(new)
    return [doc[first], row[first], start[first], np.maximum.reduceat(stop, first) if len(first) else stop]


def to_buckets(records: np.ndarray, payload: list[bytes] | None, buckets: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(bucket, records, their payloads end to end), by anchor."""
    to = (records["anchor"] >> np.uint64(20)) % np.uint64(buckets)
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(buckets + 1, dtype=np.uint64))
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if b > a:
            yield i, records[order[a:b]].tobytes(), b"".join(payload[j] for j in order[a:b]) if payload else b""


class Shard:
    """Pieces of one shard and the sorted order of their suffixes, over blocks of
    length / BLOCKS bytes: a suffix is the sequence of blocks from a byte to its piece's end."""

    def __init__(self, records: np.ndarray, text: bytes, length: int):
        self.records, self.step = records, length // BLOCKS
        sizes = records["count"].astype(np.int64) + length - 1
        n = int(sizes.sum()) + len(sizes)  # each piece has one more suffix, the empty one
        self.piece = np.repeat(np.arange(len(records)), sizes + 1)
        self.within = np.arange(n) - (np.cumsum(sizes + 1) - sizes - 1)[self.piece]
        size = sizes[self.piece]
        data = np.zeros(n, dtype=np.uint8)
        data[self.within < size] = np.frombuffer(text, dtype=np.uint8)
        whole = self.within + self.step <= size  # a block begins here
        block = window_hashes(data, self.step)
        self.symbol = np.zeros(n, dtype=np.uint64)  # 0: less than a block is left
        self.symbol[: len(block)] = np.where(whole[: len(block)], block | np.uint64(1), np.uint64(0))
        self.before = np.where(self.within >= self.step, np.arange(n) - self.step, -1)
        code = np.unique(self.symbol, return_inverse=True)[1].astype(np.int64)
        rank, after = code, np.minimum(np.arange(n) + self.step, n - 1)
        for _ in range(int(sizes.max(initial=0)) // self.step):
            rank = np.unique(np.where(whole, code * n + rank[after], 0), return_inverse=True)[1]
        self.order = np.argsort(rank, kind="stable")


def merge(shards: list[Shard], rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge the shards' transforms by refining their interleave. Returns, in merged order, each
    suffix's shard and position, and the common prefix with the suffix before it, in blocks
    (`rounds` if they agree that far).

    After round j the interleave orders all suffixes by their first j blocks. A round walks the
    interleave; each suffix names, through its transform symbol, the suffix one block longer,
    which goes into its symbol's bucket. No suffixes are compared: where two neighbours fall
    apart, their common prefix is the number of rounds they stood together."""
    base = np.concatenate(([0], np.cumsum([len(s.order) for s in shards])))
    n = int(base[-1])
    shard_of = np.repeat(np.arange(len(shards), dtype=np.int16), np.diff(base))
    orders = [s.order + b for s, b in zip(shards, base)]
    symbol = np.concatenate([s.symbol for s in shards])
    before = np.concatenate([np.where(s.before >= 0, s.before + b, -1) for s, b in zip(shards, base)])
    code = np.unique(symbol, return_inverse=True)[1]
    merged = np.concatenate(orders)
    ended = merged[symbol[merged] == 0]  # suffixes without a whole block come first
    block = np.zeros(n, dtype=np.int64)  # number of the run of suffixes that agree so far
    prefix = np.full(n, rounds, dtype=np.int64)
    prefix[:1] = 0
    for j in range(rounds):
        from_ = np.flatnonzero(before[merged] >= 0)
        longer = before[merged[from_]]
        lone = symbol[longer] != 0
        from_, longer = from_[lone], longer[lone]
        order = np.argsort(code[longer], kind="stable")
        following = np.concatenate((ended, longer[order]))
        blocks = block[from_[order]]
        cut = np.ones(len(following), dtype=bool)
        cut[1 : len(ended)] = False
        k = code[following[len(ended) :]]
        cut[len(ended) + 1 :] = (k[1:] != k[:-1]) | (blocks[1:] != blocks[:-1])
        prefix[cut & (prefix == rounds)] = j
        block = np.cumsum(cut) - 1
        source = shard_of[following]
        merged = np.empty(n, dtype=np.int64)
        for i, order_ in enumerate(orders):  # the interleave says which shard's next suffix stands where
            merged[source == i] = order_
    return shard_of[merged], merged - base[shard_of[merged]], prefix


def repeated(shards: list[Shard], length: int) -> list[np.ndarray]:
    """Columns of RANGE: the strings of `length` bytes that also start earlier."""
    source, position, prefix = merge(shards, BLOCKS)
    piece_base = np.concatenate(([0], np.cumsum([len(s.records) for s in shards])))
    records = np.concatenate([s.records for s in shards])
    within = np.empty(len(source), dtype=np.int64)
    piece = np.empty(len(source), dtype=np.int64)
    for i, s in enumerate(shards):
        here = source == i
        within[here], piece[here] = s.within[position[here]], s.piece[position[here]] + piece_base[i]
    interval = np.cumsum(prefix < BLOCKS)  # suffixes that agree in all blocks
    string = np.flatnonzero(within < records["count"][piece])
    interval, within, piece = interval[string], within[string], piece[string]
    doc, at = records["doc"][piece], records["start"][piece].astype(np.int64) + within
    order = np.lexsort((at, doc, interval))
    interval, within, piece, doc, at = interval[order], within[order], piece[order], doc[order], at[order]
    head = np.ones(len(interval), dtype=bool)
    head[1:] = interval[1:] != interval[:-1]
    lead = np.flatnonzero(head)[np.cumsum(head) - 1] if len(head) else head.astype(np.int64)
    later = (doc != doc[lead]) | (at != at[lead])
    piece, within = piece[later], within[later]
    order = np.lexsort((within, piece))
    piece, within = piece[order], within[order]
    new = np.ones(len(piece), dtype=bool)
    new[1:] = (piece[1:] != piece[:-1]) | (within[1:] != within[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(piece)) - 1 if len(first) else first
    begin = records["start"][piece[first]].astype(np.int64)
    return [records["doc"][piece[first]], records["row"][piece[first]], begin + within[first], begin + within[last] + length]


def hot_anchors(docs: DataFrame, length: int) -> np.ndarray:
    """Anchors that many of the sampled texts share; at most HOT_CAPACITY, the most frequent."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for _, b, data, offsets in chunks(rows.column(0), 1 << 20):
                each = np.arange(len(offsets) - 1)
                found = pieces(data, offsets, each, each, length)
                _, once = np.unique(mix(found["anchor"] + mix(found["doc"].astype(np.uint64))), return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(found["anchor"][once].view(np.int64))], names=["anchor"])

    some = docs.where(F.pmod(F.xxhash64("doc", "text"), F.lit(SAMPLE)) == 0).select("text")
    often = some.mapInArrow(work, "anchor long").groupBy("anchor").count().where(F.col("count") >= HOT_LEAST) \
        .orderBy(F.desc("count"), "anchor").limit(HOT_CAPACITY).collect()
    return np.sort(np.array([r["anchor"] for r in often], dtype=np.int64).view(np.uint64))


def anchored(docs: DataFrame, length: int, buckets: int, hot: np.ndarray) -> DataFrame:
    """Every task's pieces by bucket, the first of equal ones; the columns of RANGE that later
    equal pieces cover have bucket -1."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            ids, marks = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            for a, b, _, _ in chunks(rows.column(2), 16 << 20):
                found = []
                for c, d, some, offs in chunks(rows.column(2).slice(a, b - a), 1 << 20):
                    found.append(pieces(some, offs, ids[a + c : a + d], marks[a + c : a + d], length, hot))
                first, later = earliest(np.concatenate(found))
                out = list(to_buckets(first, None, buckets))
                if len(later):
                    out.append((-1, np.stack(merged_ranges(later, length)).tobytes(), b""))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary()))],
                                                     names=["bucket", "records", "text"])

    return docs.select("doc", "mark", "text").mapInArrow(work, "bucket long, records binary, text binary")


def sorted_out(blobs: DataFrame, length: int) -> DataFrame:
    """(settled, and RANGE, anchor, count): merged ranges of later equal pieces, which are settled
    (anchor and count 0), and the pieces of anchors with several contents, whose strings are still to be compared."""

    def work(table: pa.Table) -> pa.Table:
        first, later = earliest(np.concatenate([np.frombuffer(x, dtype=PIECE) for x in table["records"].to_pylist()]))
        _, at, n = np.unique(first["anchor"], return_inverse=True, return_counts=True)
        open_ = first[n[at] > 1]
        gone = merged_ranges(later, length)
        columns = [np.concatenate(c) for c in zip(gone, ranges(open_, length))]
        none = np.zeros(len(gone[0]), dtype=np.int64)
        return pa.table([pa.array(np.arange(len(columns[0])) < len(none)), *map(pa.array, columns),
                         pa.array(np.concatenate((none, open_["anchor"].view(np.int64)))),
                         pa.array(np.concatenate((none, open_["count"].astype(np.int64))))],
                        names=["settled", "doc", "row", "start", "stop", "anchor", "count"])

    return blobs.where("bucket >= 0").groupBy("bucket").applyInArrow(work, f"settled boolean, {RANGE}, anchor long, count long")


def fetched(docs: DataFrame, wanted: DataFrame, length: int, buckets: int) -> DataFrame:
    """The bytes of the wanted pieces, by bucket."""
    asked = wanted.groupBy(F.col("doc").alias("of"), F.col("row").alias("of_mark")).agg(F.collect_list(F.struct("start", "anchor", "count")).alias("asked"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for a, b, data, offsets in chunks(rows.column(2), 16 << 20):
                lists = rows.column(3).slice(a, b - a)
                each = lists.flatten()
                n = np.diff(lists.offsets.to_numpy())
                records = np.empty(len(each), dtype=PIECE)
                of = np.repeat(np.arange(b - a), n)
                records["doc"], records["row"] = (rows.column(i).slice(a, b - a).to_numpy()[of] for i in (0, 1))
                for name in ("start", "anchor", "count"):
                    records[name] = each.field(name).to_numpy().astype(PIECE[name], casting="unsafe")
                begin = offsets[of] + records["start"]
                raw = data.tobytes()
                texts = [raw[s : s + c] for s, c in zip(begin.tolist(), (records["count"].astype(np.int64) + length - 1).tolist())]
                out = list(to_buckets(records, texts, buckets))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary()))],
                                                     names=["bucket", "records", "text"])

    return docs.join(asked, (docs["doc"] == asked["of"]) & (docs["mark"] == asked["of_mark"])).select("doc", "mark", "text", "asked").mapInArrow(
        work, "bucket long, records binary, text binary")


def compared(blobs: DataFrame, length: int) -> DataFrame:
    """RANGE of the strings that also start earlier, among the pieces of each bucket."""

    def work(table: pa.Table) -> pa.Table:
        records, texts = table["records"].to_pylist(), table["text"].to_pylist()
        n = max(1, min(SHARDS, len(records)))
        shards = [Shard(np.frombuffer(b"".join(records[i::n]), dtype=PIECE), b"".join(texts[i::n]), length) for i in range(n)]
        return pa.table([pa.array(c) for c in repeated(shards, length)], names=["doc", "row", "start", "stop"])

    return blobs.groupBy("bucket").applyInArrow(work, RANGE)


def id_key(id_column: Column) -> Column:
    return F.coalesce(id_column.cast("long"), F.lit(2**63 - 1))


def repeated_ranges(docs: DataFrame, length: int) -> DataFrame:
    """RANGE over `docs` (doc, mark, text), where `mark` is a text's hash: bytes covered by a string of `length` bytes that also
    starts earlier. Ranges may overlap."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(32, -(-int(total) // (BUCKET_ANCHORS * (length - ANCHOR + 2) // 2)))
    blobs = written(anchored(docs, length, buckets, hot_anchors(docs, length)), "anchors")
    sorted_ = written(sorted_out(blobs, length), "sorted")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.frombuffer(x, dtype=np.int64).reshape(4, -1)],
                                                 names=["doc", "row", "start", "stop"])

    local = blobs.where("bucket < 0").select("records").mapInArrow(unpack, RANGE)
    wanted = sorted_.where("not settled").select("doc", "row", "start", "anchor", "count")
    n_bytes = wanted.agg(F.sum(F.col("count") + length - 1)).first()[0] or 0
    texts = fetched(docs, wanted, length, max(32, -(-int(n_bytes) // BUCKET_BYTES)))
    out = written(local.union(sorted_.where("settled").select("doc", "row", "start", "stop")).union(compared(texts, length)), "ranges")
    discard(spark, blobs, sorted_)
    return out


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are UTF-8 bytes, and matches stay within documents. Every byte is removed that is
    covered by a string of `length` bytes (a multiple of BLOCKS) that also starts earlier: in
    a smaller id, or earlier in the same document. Strings are judged on the input.

    Equal strings choose equal anchors, so anchors split the work; the strings of anchors that
    very many texts share are looked up one by one, by their own hash, so that no task
    holds all that surrounds a common passage. Runs of strings around an
    anchor that recur as a whole are settled by their hash; where an anchor has several
    contexts, the pieces' Burrows-Wheeler transforms are built by shard and merged, and
    intervals of suffixes with a common prefix of `length` bytes are the repeated strings.

    A null text is empty. Ids are integers; a null id comes after all others, and null ids
    count as one id. Rows that share an id are told apart by 64 bits of their text's hash;
    rows that repeat an id and text don't remove each other; an empty table gives an empty result; other
    columns are ignored.
    """
    return _cut(docs.select(F.struct(F.col(id_col).alias("id"), F.col(text_col).alias("text")).alias("row")), "id", "text", length, False).select(
        F.col("row.id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """`docs` with the texts that `cut_repeats` leaves; all rows and columns stay. A character
    that lost some of its bytes is left out; a null text stays null."""
    rows = _cut(docs.select(F.struct(*docs.columns).alias("row")), id_col, text_col, length, True)
    text = F.when(F.col("had_text"), F.col("kept"))
    return rows.select(*[text.alias(c) if c == text_col else F.col(f"row.{c}") for c in docs.columns])


def _cut(rows: DataFrame, id_name: str, text_name: str, length: int, with_text: bool) -> DataFrame:
    """For the column `row`, a struct with an id and a text: row (its text emptied), had_text,
    n_bytes, n_removed, n_spans, kept_sha256 and maybe kept. Each text goes to Python once."""
    text, doc = F.coalesce(F.col("row")[text_name], F.lit("")), id_key(F.col("row")[id_name])
    plain = rows.select(doc.alias("doc"), F.xxhash64(text).alias("mark"), text.alias("text"))
    found = repeated_ranges(plain, length).groupBy(F.col("doc").alias("of"), F.col("row").alias("of_mark")).agg(
        F.collect_list(F.struct("start", "stop")).alias("gone"))
    fields = [rows.schema["row"], T.StructField("had_text", T.BooleanType())] + [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
    schema = T.StructType(fields + [T.StructField("kept_sha256", T.StringType())] + [T.StructField("kept", T.StringType())] * with_text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1)):
                lists = batch.column(2).slice(a, b - a)
                each = lists.flatten()
                n = np.diff(lists.offsets.to_numpy()) if len(each) else np.zeros(b - a, dtype=np.int64)
                n = np.where(np.asarray(lists.is_valid()), n, 0)
                of = np.repeat(np.arange(b - a), n)
                start, stop = (each.field(c).to_numpy() for c in ("start", "stop"))
                change = np.zeros(len(data) + 1, dtype=np.int32)
                np.add.at(change, offsets[of] + start, 1)
                np.add.at(change, offsets[of] + stop, -1)
                gone = np.cumsum(change[:-1]) > 0
                left = ~gone
                edge = gone.copy()
                edge[1:] &= left[:-1]
                heads = offsets[:-1][np.diff(offsets) > 0]
                edge[heads] = gone[heads]
                total = np.concatenate(([0], np.cumsum(gone)))
                spans = np.concatenate(([0], np.cumsum(edge)))
                kept = [data[s:e][left[s:e]].tobytes() for s, e in zip(offsets, offsets[1:])]
                columns = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a).is_valid(), pa.array(np.diff(offsets)),
                           pa.array(np.diff(total[offsets])), pa.array(np.diff(spans[offsets])), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
                columns += [pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())] * with_text
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    mine = (doc == F.col("of")) & (F.xxhash64(text) == F.col("of_mark"))
    bare = F.col("row").withField(text_name, F.lit(None).cast("string")).alias("row")
    return rows.join(found, mine, "left").select(bare, F.col("row")[text_name].alias("text"), "gone").mapInArrow(work, schema)
