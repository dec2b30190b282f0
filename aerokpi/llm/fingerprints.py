"""MinHash fingerprints of texts, and near copies by their bands."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerokpi.llm import common
from aerokpi.llm.common import discard
from aerokpi.llm.components import components
from aerokpi.llm.hashing import buffers, by_bytes, mix, shingle_hashes, word_hashes

#: Words of a shingle, and the similarity of near copies in per cent.
WIDTH = 5
PERCENT = 80
#: A fingerprint's bands and their places: two sets of similarity s share a band with
#: probability 1 - (1 - s ** ROWS) ** BANDS, 0.99995 at 0.8.
BANDS = 25
ROWS = 5
#: Hexadecimal digits of one place: 16 bits of the least hash.
DIGITS = 4
#: Pivots of a band grow by this factor a round. Members without a link have to be compared with
#: each other whatever the factor, and copies are mostly connected by the first pivot, so a large
#: factor costs few comparisons and saves rounds.
GROWTH = 16
#: Bits of the bitmap that thins out texts before they are shuffled for verification: 16 MB in
#: the driver and in every worker, at every size of the input.
FILTER_BITS = 1 << 27
#: 64-bit words of a set's sketch: what one sketch has and another lacks bounds their overlap.
SKETCH_WORDS = 16
#: Bytes of text handled at once, unless one text is larger: the arrays stay in the cache.
CHUNK_BYTES = 1 << 19

_RNG = np.random.default_rng(20241113)
_FACTORS = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)  # odd: x -> a x + b permutes 64 bits
_TERMS = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2)
_NO_WORDS = np.uint16(0xFFFF)


def written(df: DataFrame, name: str) -> DataFrame:
    """A table without its shuffle files, which would add up to more than the texts."""
    return common.written(df, name, tidy=True)


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their row numbers, ascending by row and hash."""
    data, offsets = buffers(texts)
    words, rows = word_hashes(data, offsets)
    h, r = shingle_hashes(words, rows, len(texts), width)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[new], r[new]


def minima(h: np.ndarray, r: np.ndarray, n_rows: int) -> np.ndarray:
    """The fingerprints of n_rows sets: for each permutation x -> a x + b mod 2**64, 16 bits of
    the least image; all bits set for a set without shingles."""
    out = np.full((n_rows, len(_FACTORS)), _NO_WORDS, dtype=np.uint16)
    if len(h):
        lead = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
        some, image = r[lead], np.empty_like(h)
        for k, (a, b) in enumerate(zip(_FACTORS, _TERMS)):
            np.multiply(h, a, out=image)
            np.add(image, b, out=image)
            out[some, k] = (np.minimum.reduceat(image, lead) >> np.uint64(40)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal places: estimates the Jaccard similarity. 1 for two sets without
    shingles, 0 for one of them and another."""
    same = (a == b).mean(axis=1)
    none = (a == _NO_WORDS).all(axis=1) != (b == _NO_WORDS).all(axis=1)
    return np.where(none, 0.0, same)


def as_bytes(prints: np.ndarray) -> pa.Array:
    """The places as big-endian bytes: half as long as their hexadecimal digits."""
    data, size = prints.astype(">u2").tobytes(), 2 * prints.shape[1]
    return pa.array([data[i : i + size] for i in range(0, len(data), size)], pa.binary())


def set_keys(h: np.ndarray, r: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """128 bits that stand for each row's set, and its size."""
    n = np.bincount(r, minlength=n_rows)
    keys = np.zeros((2, n_rows), dtype=np.uint64)
    if len(h):
        lead = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
        keys[0, r[lead]] = np.add.reduceat(mix(h), lead)
        keys[1, r[lead]] = np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), lead)
    return keys[0], keys[1], n


def sketches(h: np.ndarray, r: np.ndarray, n_rows: int) -> list[pa.Array]:
    """SKETCH_WORDS columns of 64 bits that hold each row's set, a shingle's hash setting one bit,
    and the number of its shingles beyond the bits set."""
    size = 64 * SKETCH_WORDS
    bits = np.zeros((n_rows, size), dtype=np.uint8)
    bits[r, (h % np.uint64(size)).astype(np.int64)] = 1
    words, spare = np.packbits(bits, axis=1).view(np.int64), np.bincount(r, minlength=n_rows) - bits.sum(axis=1, dtype=np.int64)
    return [*[pa.array(np.ascontiguousarray(words[:, i])) for i in range(SKETCH_WORDS)], pa.array(spare, pa.int64())]


_SKETCH = [*[f"s{i}" for i in range(SKETCH_WORDS)], "spare"]


def most_shared(a: str, b: str) -> Column:
    """No two sets whose sketches have these prefixes share more shingles: a bit that only one of
    them has set stands for a shingle that the other lacks."""
    both = reduce(add, [F.bit_count(F.col(a + c).bitwiseAND(F.col(b + c))) for c in _SKETCH[:-1]])
    return both + F.least(a + "spare", b + "spare")


class Signed:
    """Texts of some rows with their fingerprints, set keys and sizes."""

    def __init__(self, texts: list[str], width: int):
        self.texts = texts
        h, r = shingles(pa.array(texts, pa.large_string()), width)
        self.prints = minima(h, r, len(texts))
        self.key, self.key2, self.n = set_keys(h, r, len(texts))


def edited_text(text: str, following: str) -> str:
    """`text` with its last half (rounded down) replaced by as much of the start of `following`."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compared(texts: list[str], prints: np.ndarray, following: list[str], next_prints: np.ndarray, width: int) -> list[pa.Array]:
    """edited_sha256, edited_fingerprint, near_edited and near_next of the texts and those after them."""
    edited = [edited_text(t, f) for t, f in zip(texts, following)]
    h, r = shingles(pa.array(edited, pa.large_string()), width)
    changed = minima(h, r, len(edited))
    return [pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()), as_bytes(changed),
            pa.array(likeness(prints, changed)), pa.array(likeness(prints, next_prints))]


#: Columns of hexadecimal digits in results, of bytes in tables and shuffles.
_PRINTS = ("fingerprint", "edited_fingerprint")
_COMPARED = "edited_sha256 string, edited_fingerprint binary, near_edited double, near_next double"


def packed(docs: DataFrame) -> DataFrame:
    """The columns id, tie and packed, the text compressed: what the range shuffle moves."""
    schema = T.StructType([docs.schema["id"], docs.schema["tie"], T.StructField("packed", T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, pack = to_arrow_schema(schema), zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([pack(x.encode()) for x in batch.column(2).to_pylist()], pa.binary())], schema=arrow)

    return docs.select("id", "tie", "text").mapInArrow(work, schema)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per document, its texts read once: id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, key, key2, n_shingles.

    A fingerprint holds, for BANDS * ROWS random permutations of 64-bit shingle hashes, 16
    bits of the least image as hexadecimal digits. Beside each text its edited text is
    fingerprinted: the last floor(n_chars / 2) code points replaced by the first as many of
    the next document's, by id (after the last the first). `near_edited` and `near_next` are
    the shares of equal places with the edited text and the next document.

    Documents are range-partitioned by id, so the next one lies in the same task, but for the
    last of a range: that row is finished from the first row of the next range, two texts a
    range. A null text counts as empty; texts without words have a fingerprint of their own,
    0 like any other. Null ids come last; rows that share an id are ordered by a hash of
    their text. An empty table gives an empty result; other columns are ignored."""
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    plain = packed(plain)
    by = [F.col("id").asc_nulls_last(), F.col("tie").asc()]
    ranged = plain.repartitionByRange(*by).sortWithinPartitions(*by).select("id", "packed", F.spark_partition_id().alias("part"))
    schema = T.StructType([
        T.StructField("id", docs.schema[id_col].dataType), T.StructField("part", T.IntegerType()), T.StructField("n_chars", T.LongType()),
        T.StructField("fingerprint", T.BinaryType()), T.StructField("key", T.LongType()), T.StructField("key2", T.LongType()),
        T.StructField("n_shingles", T.LongType()), *T.StructType.fromDDL(_COMPARED).fields,
        T.StructField("head_text", T.StringType()), T.StructField("open_text", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        held: tuple | None = None  # the last row so far: id, part, text, what was signed, its place there, whether the first

        def rows(ids: list, part: int, texts: list[str], signed: list[tuple[Signed, int]], more: list[pa.Array], head: bool, open_: bool) -> pa.RecordBatch:
            n = len(texts)
            pick = lambda name: np.array([getattr(s, name)[i] for s, i in signed])
            return pa.RecordBatch.from_arrays([
                pa.array(ids, arrow.field("id").type), pa.array([part] * n, pa.int32()), pa.array([len(t) for t in texts], pa.int64()),
                as_bytes(pick("prints")), pa.array(pick("key").view(np.int64)), pa.array(pick("key2").view(np.int64)), pa.array(pick("n"), pa.int64()), *more,
                pa.array([t if head and i == 0 else None for i, t in enumerate(texts)], pa.string()),
                pa.array([t if open_ else None for t in texts], pa.string())], schema=arrow)

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            _, offsets = buffers(batch.column(1))
            for a, b in by_bytes(offsets, CHUNK_BYTES // 2):
                ids, texts = batch.column(0).slice(a, b - a).to_pylist(), [unpack(x).decode() for x in batch.column(1).slice(a, b - a).to_pylist()]
                part, signed = batch.column(2)[a].as_py(), Signed(texts, width)
                places = [(signed, i) for i in range(len(texts))]
                head = held is None
                if held is not None:
                    ids, texts, places, head = [held[0], *ids], [held[1], *texts], [held[2], *places], held[3]
                prints = np.array([s.prints[i] for s, i in places])
                if len(texts) > 1:
                    more = compared(texts[:-1], prints[:-1], texts[1:], prints[1:], width)
                    yield rows(ids[:-1], part, texts[:-1], places[:-1], more, head, False)
                held = (ids[-1], texts[-1], places[-1], head and len(texts) == 1, part)
        if held is not None:
            nothing = [pa.nulls(1, arrow.field(c).type) for c in ("edited_sha256", "edited_fingerprint", "near_edited", "near_next")]
            yield rows([held[0]], held[4], [held[1]], [held[2]], nothing, held[3], True)

    made = written(ranged.mapInArrow(work, schema), "prints")
    rest = [c for c in made.columns if c not in ("part", "head_text", "open_text")]
    heads = made.where("head_text IS NOT NULL").select(F.col("part").alias("head_part"), "head_text", F.col("fingerprint").alias("head_print"))
    order = Window.orderBy("head_part")  # one number a range
    after = heads.select("head_part").select(F.col("head_part").alias("open_part"), F.coalesce(
        F.lead("head_part").over(order), F.min("head_part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("next_part"))
    opened = made.where("open_text IS NOT NULL").drop("head_text").join(after, F.col("part") == F.col("open_part")).join(heads, F.col("next_part") == F.col("head_part"))
    left = [c for c in rest if c not in ("edited_sha256", "edited_fingerprint", "near_edited", "near_next")]
    closed_schema = T.StructType([made.schema[c] for c in left] + T.StructType.fromDDL(_COMPARED).fields)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(closed_schema)
        from_bytes = lambda column: np.array([np.frombuffer(x, ">u2") for x in column.to_pylist()], dtype=np.uint16)
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                mine = one.column("open_text").to_pylist(), from_bytes(one.column("fingerprint"))
                more = compared(*mine, one.column("head_text").to_pylist(), from_bytes(one.column("head_print")), width)
                yield pa.RecordBatch.from_arrays([one.column(c) for c in left] + more, schema=arrow)

    closed = opened.select(*left, "open_text", "head_text", "head_print").mapInArrow(close, closed_schema)
    # the many finished rows are read where they lie, not written again
    out = made.where("open_text IS NULL").select(*rest).unionByName(written(closed.select(*rest), "closed"))
    return out.select(*[F.lower(F.hex(c)).alias(c) if c in _PRINTS else c for c in rest]).withColumnRenamed("id", id_col)


def marked_bits(positions: DataFrame) -> np.ndarray:
    """A bitmap of FILTER_BITS bits, eight a byte, with those at the column `at` set."""
    n = F.col("at") + 1  # Spark counts from 1
    parts = positions.groupBy(F.bitmap_bucket_number(n).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(n)).alias("bits")).collect()
    size = FILTER_BITS // 8 // 4096
    out = np.zeros((size, 4096), dtype=np.uint8)
    for row in parts:
        out[row["part"] - 1] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return out.reshape(-1)


def sets_of(docs: DataFrame, able: DataFrame, width: int) -> DataFrame:
    """(key, key2, n, items and the columns of `sketches`), written, of the classes `able` (k, k2, rep), read from the text
    of each class's representative in `docs` (id, text).

    A bitmap of FILTER_BITS bits, whatever the number of classes, tells tasks which texts
    may be wanted, so that the others aren't shuffled; the join with `able` then decides."""
    spark = docs.sparkSession
    mask = FILTER_BITS - 1
    place = F.col("k").bitwiseXOR(F.xxhash64("rep")).bitwiseAND(F.lit(mask))
    bits = spark.sparkContext.broadcast(marked_bits(able.select(place.alias("at"))))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = buffers(batch.column(1))
            for a, b in by_bytes(offsets, CHUNK_BYTES):
                part = batch.slice(a, b - a)
                key, key2, _ = set_keys(*shingles(part.column(1), width), b - a)
                at = (key ^ part.column(0).to_numpy().view(np.uint64)) & np.uint64(mask)
                found = (bits.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
                some = pa.array(found == 1)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)).filter(some), pa.array(key2.view(np.int64)).filter(some),
                                                  part.column(0).filter(some), part.column(1).filter(some)], names=["key", "key2", "owner", "text"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = buffers(batch.column(0))
            for a, b in by_bytes(offsets, CHUNK_BYTES):
                h, r = shingles(batch.column(0).slice(a, b - a), width)
                key, key2, n = set_keys(h, r, b - a)
                at = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(key2.view(np.int64)), pa.array(n, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(at), pa.array(h.view(np.int64))), *sketches(h, r, b - a)],
                    names=["key", "key2", "n", "items", *_SKETCH])

    some = docs.select(F.xxhash64("id").alias("owner"), "text").mapInArrow(wanted, "key long, key2 long, owner long, text string")
    owners = able.select(F.col("k").alias("key"), F.col("k2").alias("key2"), F.xxhash64("rep").alias("owner"))
    keys = ["key", "key2", "owner"]
    texts = some.join(owners, keys, "left_semi").dropDuplicates(keys).select("text")
    return written(texts.mapInArrow(sets, "key long, key2 long, n long, items array<long>" + "".join(f", {c} long" for c in _SKETCH)), "sets")


def band_members(classes: DataFrame) -> DataFrame:
    """(band, x, n, centre): the classes of every band that several of them share; bands of the
    same members are one. `centre`, the members of all of a class's bands, is largest for
    the text that the others were copied from."""
    size = DIGITS * ROWS // 2  # bytes
    bands = F.array(*[F.xxhash64(F.lit(b), F.substring("fingerprint", b * size + 1, size)) for b in range(BANDS)])
    entries = classes.select(F.col("key").alias("x"), "n", F.explode(bands).alias("band"))
    shared = entries.groupBy("band").agg(F.count("*").alias("members"), F.sum(F.xxhash64("x").cast("decimal(20,0)")).alias("content")).where("members > 1")
    single = written(shared.groupBy("members", "content").agg(F.min("band").alias("band")).select("band", "members"), "shared_bands")
    found = written(entries.join(single, "band").select("band", "x", "n", "members"), "found_bands")
    centre = found.groupBy("x").agg(F.sum("members").alias("centre"))
    members = written(found.drop("members").join(centre, "x").select("band", "x", "n", "centre"), "band_members")
    discard(classes.sparkSession, single, found)
    return members


def verified_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """(a, b) links of exact similarity that leave no two linked members of a band in
    different components.

    In rounds, every band elects pivots (one, then GROWTH times as many: the best of each
    salted part, those outside the band's larger components first, then the most central,
    which the bands of a cluster share) and compares them
    exactly with its other members, unless they are connected already or their sizes or
    sketches rule a link out. A band ends when all members that were no pivots are connected, so a group of
    copies takes one round and no pairs are formed within it."""
    spark = members.sparkSession
    near = lambda both, n, m: both * 100 >= (n + m - both) * percent
    left = sets.select(F.col("key").alias("x"), F.col("items").alias("x_items"))
    right = sets.select(F.col("key").alias("p"), F.col("items").alias("p_items"))
    sketch = lambda key, to: sets.select(F.col("key").alias(key), *[F.col(c).alias(f"{to}_{c}") for c in _SKETCH])
    active = written(members.withColumn("label", F.col("x")), "active")
    links: DataFrame | None = None
    pivots = 1
    while not active.isEmpty():
        sized = active.withColumn("size", F.lit(1))  # at first every member is its own component
        if pivots > 1:
            sizes = active.groupBy(F.col("band").alias("b"), F.col("label").alias("l")).agg(F.count("*").alias("size"))
            sized = active.join(sizes, (F.col("band") == F.col("b")) & (F.col("label") == F.col("l")))
        salt = F.pmod(F.xxhash64("x", F.lit(pivots)), F.lit(pivots)).alias("salt")
        elected = written(sized.groupBy("band", salt).agg(F.min(F.struct("size", (-F.col("centre")).alias("far"), F.xxhash64("x").alias("by"), "x", "n", "label")).alias("e")).select(
            "band", F.col("e.x").alias("p"), F.col("e.n").alias("m"), F.col("e.label").alias("p_label")), "pivots")
        n, m = F.col("n"), F.col("m")
        pairs = active.join(sketch("x", "x"), "x").join(elected.join(sketch("p", "p"), "p"), "band").where(
            (F.col("x") != F.col("p")) & (F.col("label") != F.col("p_label")) & near(F.least(n, m), n, m) & near(most_shared("x_", "p_"), n, m))
        measured = pairs.select("x", "p", "n", "m").distinct().join(left, "x").join(right, "p").select(
            F.col("x").alias("a"), F.col("p").alias("b"), "n", "m", F.size(F.array_intersect("x_items", "p_items")).alias("both"))
        found = measured.where(near(F.col("both"), F.col("n"), F.col("m"))).select("a", "b")
        more = written(found if links is None else links.unionByName(found), "links")
        if links is not None:
            discard(spark, links)
        links = more
        labels = components(links)
        rest = active.join(elected.select("band", F.col("p").alias("x")), ["band", "x"], "left_anti").drop("label")
        rest = written(rest.join(labels.select(F.col("node").alias("x"), "label"), "x", "left").withColumn("label", F.coalesce("label", "x")), "rest")
        undone = rest.groupBy("band").agg((F.min("label") != F.max("label")).alias("undone")).where("undone").select("band")
        following = written(rest.join(undone, "band").select(*active.columns), "active")
        discard(spark, active, elected, rest, labels)
        active, pivots = following, pivots * GROWTH
    discard(spark, active)
    return links


def near_copies_by_bands(docs: DataFrame, prints: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                         percent: int = PERCENT) -> DataFrame:
    """`prints` (of `fingerprints`) with near_id, the smallest id reachable by links, itself
    included: documents link when their fingerprints share a band and the exact similarity
    of their shingle sets, read again from the texts of `docs`, is at least `percent` %.

    Equal sets are one class, so copies are never paired. Texts without words, and those
    whose fingerprint shares no band, are their own. A null id is linked like others but
    comes after all ids. Sets are told apart by 128 bits, their links by 64."""
    spark = docs.sparkSession
    signed = written(prints.where("n_shingles > 0").groupBy("key", "key2").agg(
        F.min(id_col).alias("rep"), F.first("n_shingles").alias("n"), F.first(F.unhex("fingerprint")).alias("fingerprint")), "signed")
    members = band_members(signed)
    classes = written(signed.select("key", "key2", "rep"), "classes")
    discard(spark, signed)
    able = written(classes.join(members.select(F.col("x").alias("key")).distinct(), "key", "left_semi").select(
        F.col("key").alias("k"), F.col("key2").alias("k2"), "rep"), "able")
    sets = sets_of(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), able, width)
    links = verified_links(members, sets, percent)
    if links is None:
        return prints.withColumn("near_id", F.col(id_col))
    labels = components(links)
    named = labels.join(classes.select("key", "rep"), F.col("node") == F.col("key"))
    smallest = written(named.groupBy("label").agg(F.min("rep").alias("near_id")), "smallest")
    found = written(named.join(smallest, "label").select(F.col("key").alias("near_key"), "near_id"), "near_ids")
    discard(spark, members, able, sets, links, labels, smallest)
    # equal sets without links of others share the class's smallest id
    own = classes.select(F.col("key").alias("c_key"), F.col("key2").alias("c_key2"), "rep").join(found, F.col("c_key") == F.col("near_key"), "left").select(
        "c_key", "c_key2", F.coalesce("near_id", "rep").alias("near_id"))
    short = prints.select(*[F.unhex(c).alias(c) if c in _PRINTS else c for c in prints.columns])
    return short.join(own, (F.col("key") == F.col("c_key")) & (F.col("key2") == F.col("c_key2")), "left").select(
        *[F.lower(F.hex(c)).alias(c) if c in _PRINTS else c for c in prints.columns], F.coalesce("near_id", id_col).alias("near_id"))
