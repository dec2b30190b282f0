"""Exact Jaccard join of shingle sets as a metric-space join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerokpi.llm.common import discard, written
from aerokpi.llm.components import components
from aerokpi.llm.hashing import mix, shingle_hashes, word_hashes
from aerokpi.llm.units import chunks

WIDTH = 5
PERCENT = 80
#: Share of the hash space whose shingles large sets send to the first filter.
SAMPLE = 0.4
#: Sets of up to this size send all their shingles.
SMALL = 64
#: Shingles of one bucket of the first filter.
BUCKET_SHINGLES = 500_000
#: Ranks up to which Spark limits a window before its shuffle (spark.sql.optimizer.windowGroupLimitThreshold).
WINDOW_LIMIT = 1000
#: Parts of a region from which more pivots than that are elected.
REGION_PARTS = 64


def distinct_shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every row, by row and ascending; and their rows."""
    words, rows = word_hashes(data, offsets)
    h, r = shingle_hashes(words, rows, len(offsets) - 1, width)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[new], r[new]


def set_keys(h: np.ndarray, r: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and 128-bit key (two halves) of each row's set. The key depends on the set only."""
    n = np.bincount(r, minlength=n_rows)
    ends = np.cumsum(n)

    def total(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(values, dtype=np.uint64)))
        return sums[ends] - sums[ends - n]

    return n, mix(total(mix(h)) + n.astype(np.uint64)), mix(total(mix(h ^ np.uint64(0x5851F42D4C957F2D))) + n.astype(np.uint64))


def missing_at_most(n: Column | np.ndarray, percent: int) -> Column | np.ndarray:
    """Elements of a set of size n that a linked set can lack at most: the overlap is at least
    percent/100 of the union, which is at least n."""
    if isinstance(n, np.ndarray):
        return n - (n * percent + 99) // 100
    return n - F.floor((n * percent + 99) / 100)


def sampled(h: np.ndarray) -> np.ndarray:
    return h < np.uint64(int(SAMPLE * 2**64))


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """id, n (set size), key, key2 (of the set), n_sampled (shingles counted by the first filter)."""
    schema = T.StructType([docs.schema["id"]] + [T.StructField(c, T.LongType()) for c in ("n", "key", "key2", "n_sampled")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for rows in batches:
            for a, b, data, offsets in chunks(rows.column(1)):
                h, r = distinct_shingles(data, offsets, width)
                n, key, key2 = set_keys(h, r, b - a)
                some = np.bincount(r, sampled(h), b - a).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).slice(a, b - a), pa.array(n), pa.array(key.view(np.int64)), pa.array(key2.view(np.int64)),
                     pa.array(np.where(n <= SMALL, n, some))], schema=arrow)

    return docs.select("id", "text").mapInArrow(work, schema)


def counted_shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingles that the rows' sets send to the first filter, their sets' keys, and which
    of them count for their own set (partners of small sets send all, but count the sample)."""
    h, r = distinct_shingles(data, offsets, width)
    n, key, _ = set_keys(h, r, len(offsets) - 1)
    low, size = sampled(h), n[r]
    use = low | (size <= SMALL * 5 // 4)
    return h[use], key[r[use]], (low | (size <= SMALL))[use]


def shared_counts(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    """(key, shared): for each set, at least the number of its counted shingles that another set has.

    A set counts all its shingles if it is small, else those of the lower SAMPLE of the hash
    space. A task settles what occurs in several sets of its own chunk and sends each
    shingle once, with its set or marked as shared, to the shingle's bucket as an array."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for a, b, _, _ in chunks(rows.column(0), 16 << 20):
                parts = [counted_shingles(data, offsets, width) for _, _, data, offsets in chunks(rows.column(0).slice(a, b - a), 1 << 20)]
                h, k, counts = map(np.concatenate, zip(*parts))
                order = np.lexsort((k, h))
                h, k, counts = h[order], k[order], counts[order]
                first = np.ones(len(h), dtype=bool)  # equal sets count once
                first[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1])
                h, k, counts = h[first], k[first], counts[first]
                head = np.ones(len(h), dtype=bool)
                head[1:] = h[1:] != h[:-1]
                group = np.cumsum(head) - 1
                several = np.bincount(group)[group] > 1 if len(h) else head
                found, inverse = np.unique(k[several & counts], return_inverse=True)
                here = np.bincount(inverse, minlength=len(found)).astype(np.int64)
                h, k = h[head], np.where(several, np.uint64(0), k)[head]
                to = (h >> np.uint64(20)) % np.uint64(buckets)
                order = np.argsort(to, kind="stable")
                cuts = np.searchsorted(to[order], np.arange(buckets + 1, dtype=np.uint64))
                h, k = h[order], k[order]
                out = [(i, h[s:e].tobytes(), k[s:e].tobytes(), False) for i, (s, e) in enumerate(zip(cuts, cuts[1:])) if e > s]
                if len(found):
                    out.append((int(found[0] % np.uint64(buckets)), found.tobytes(), here.tobytes(), True))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary(), pa.bool_()))],
                        names=["bucket", "first", "second", "settled"])

    def count(table: pa.Table) -> pa.Table:
        def joined(settled: bool, column: str) -> np.ndarray:
            picked = table.filter(pa.array(np.asarray(table["settled"]) == settled))
            return np.frombuffer(b"".join(picked[column].to_pylist()), dtype=np.uint64)

        h, k = joined(False, "first"), joined(False, "second")
        order = np.lexsort((k, h))
        h, k = h[order], k[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1])
        h, k = h[new], k[new]
        head = np.ones(len(h), dtype=bool)
        head[1:] = h[1:] != h[:-1]
        group = np.cumsum(head) - 1
        shared = (np.bincount(group)[group] > 1) | (np.bincount(group, k == 0)[group] > 0) if len(h) else head
        found, inverse = np.unique(k[shared & (k != 0)], return_inverse=True)
        keys = np.concatenate((found, joined(True, "first")))
        counts = np.concatenate((np.bincount(inverse, minlength=len(found)), joined(True, "second").view(np.int64)))
        return pa.table({"key": keys.view(np.int64), "shared": counts.astype(np.int64)})

    return docs.select("text").mapInArrow(send, "bucket long, first binary, second binary, settled boolean") \
        .groupBy("bucket").applyInArrow(count, "key long, shared long") \
        .groupBy("key").agg(F.sum("shared").alias("shared"))


def sets_of(docs: DataFrame, width: int) -> DataFrame:
    """key, key2, n and the set itself as an array of hashes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for _, b, data, offsets in chunks(rows.column(0)):
                h, r = distinct_shingles(data, offsets, width)
                n, key, key2 = set_keys(h, r, len(offsets) - 1)
                at = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(key2.view(np.int64)), pa.array(n),
                     pa.ListArray.from_arrays(pa.array(at), pa.array(h.view(np.int64)))], names=["key", "key2", "n", "items"])

    return docs.select("text").mapInArrow(work, "key long, key2 long, n long, items array<long>")


def regions_of(sets: DataFrame, percent: int) -> DataFrame:
    """(region, x, n, common, centre) of the first partition.

    Its pivots are the single shingles: a set lies at distance 1 - 1/n of the pivots it
    contains and at distance 1 of all others, and belongs to the rarest of them (ties by
    hash). A linked set can lack `missing_at_most` of its shingles, so a set is replicated
    into the regions of that many further pivots, in the same order: the first pivot that two
    linked sets have in common is among them. Pivots that one set has alone need no region;
    regions with the same members are one, under their first pivot. `common` is the number of
    a set's shingles from that pivot on that any other set has: two sets whose first common
    pivot it is overlap in no more, so a set that could not reach the similarity with the
    smallest set of its region is left out. `centre` is the mean frequency of a set's
    shingles, largest for the set the others were copied from."""
    items = sets.select(F.col("key").alias("x"), "n", F.explode("items").alias("s"))
    often = written(items.groupBy("s").agg(F.count("*").alias("df")).where("df > 1"), "often")
    ordered = items.join(often, "s").groupBy("x", "n").agg(
        F.sort_array(F.collect_list(F.struct("df", "s"))).alias("common"), F.sum("df").alias("total"))
    room = missing_at_most(F.col("n"), percent) + 1 - (F.col("n") - F.size("common"))
    entries = written(ordered.where(room > 0).select(
        "x", "n", F.size("common").cast("long").alias("k"), (F.col("total") / F.col("n")).alias("centre"),
        F.posexplode(F.slice("common", 1, room.cast("int"))).alias("place", "c")).select(
        "x", "n", (F.col("k") - F.col("place")).alias("common"), "centre", F.col("c.df").alias("df"), F.col("c.s").alias("s")), "entries")
    groups = entries.groupBy("s").agg(F.count("*").alias("members"), F.sum(F.xxhash64("x").cast("decimal(20,0)")).alias("content"),
                                      F.min("n").alias("least"), F.min("df").alias("df")).where("members > 1")
    single = written(groups.groupBy("members", "content").agg(F.min(F.struct("df", "s")).alias("pivot"), F.min("least").alias("least"))
                     .select("pivot.s", "least"), "regions")
    partner = F.greatest(F.col("least"), F.ceil(F.col("n") * percent / 100))
    members = written(entries.join(single, "s").where(linked(F.least("common", partner), F.col("n"), partner, percent))
                      .select(F.col("s").alias("region"), "x", "n", "common", "centre"), "members")
    discard(sets.sparkSession, often, entries, single)
    return members


def linked(inter: Column, n: Column, m: Column, percent: int) -> Column:
    return inter * 100 >= (n + m - inter) * percent


def first_of_regions(members: DataFrame, pivots: int) -> DataFrame:
    """Each region's first `pivots` members with their `rank`: of the smallest label (`size`),
    the most central, the smallest key. Up to WINDOW_LIMIT Spark cuts the ranks in every task
    before the shuffle; beyond, parts of a region are cut before the region is ranked."""
    order = ["size", F.desc("centre"), "x"]
    if pivots > WINDOW_LIMIT:
        part = F.row_number().over(Window.partitionBy("region", F.pmod(F.xxhash64("x"), F.lit(REGION_PARTS))).orderBy(*order))
        members = members.withColumn("rank", part).where(F.col("rank") <= pivots).drop("rank")
    return members.withColumn("rank", F.row_number().over(Window.partitionBy("region").orderBy(*order))).where(F.col("rank") <= pivots)


def links_of(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) links between sets that leave no two linked sets in different components.

    Each region elects pivots, compares its other members with them exactly, and is then
    searched again with four times as many pivots. Sets that are already connected need no
    comparison; by the triangle inequality, neither do two sets whose distances from the
    region's first pivot differ by more than the join's radius. A region ends when all
    members that weren't pivots are connected, so no pair is left out."""
    spark = sets.sparkSession
    radius = 1 - percent / 100
    active = written(regions_of(sets, percent).withColumn("label", F.col("x")).withColumn("d", F.lit(None).cast("double")), "active")
    links: DataFrame | None = None
    pivots = 1
    left = sets.select(F.col("key").alias("x"), F.col("items").alias("x_items"))
    right = sets.select(F.col("key").alias("p"), F.col("items").alias("p_items"))
    while not active.isEmpty():
        sized = active.withColumn("size", F.lit(0))
        if pivots > 1:  # later, sets outside a region's main component come first
            sizes = written(active.groupBy(F.col("region").alias("r"), F.col("label").alias("l")).agg(F.count("*").alias("size")), "sizes")
            sized = active.join(sizes, (F.col("region") == F.col("r")) & (F.col("label") == F.col("l"))).drop("r", "l")
        elected = written(first_of_regions(sized, pivots).select(
            "region", F.col("x").alias("p"), F.col("n").alias("m"), F.col("common").alias("p_common"), F.col("label").alias("p_label"), F.col("d").alias("p_d"), "rank"), "elected")
        near = active.join(elected, "region").where(
            (F.col("x") != F.col("p")) & (F.col("label") != F.col("p_label"))
            & linked(F.least("n", "m", "common", "p_common"), F.col("n"), F.col("m"), percent)
            & F.coalesce(F.abs(F.col("d") - F.col("p_d")) <= radius + 1e-9, F.lit(True)))
        pairs = near.select("x", "p", "n", "m").distinct()
        measured = written(pairs.join(left, "x").join(right, "p").select(
            "x", "p", "n", "m", F.size(F.array_intersect("x_items", "p_items")).cast("long").alias("inter")).withColumn(
            "linked", linked(F.col("inter"), F.col("n"), F.col("m"), percent)), "measured")
        found = measured.where("linked").select(F.col("x").alias("a"), F.col("p").alias("b"))
        links = written(found if links is None else links.union(found), "links")
        labels = components(links)
        rest = active.join(elected.select("region", F.col("p").alias("x")), ["region", "x"], "left_anti")
        rest = rest.drop("label").join(labels.select(F.col("node").alias("x"), "label"), "x", "left").withColumn("label", F.coalesce("label", "x"))
        if pivots == 1:  # distances from the first pivot give the windows of later rounds
            first = elected.where("rank = 1").select("region", F.col("p"))
            known = measured.select("x", "p", (1 - F.col("inter") / (F.col("n") + F.col("m") - F.col("inter"))).alias("d"))
            rest = rest.drop("d").join(first, "region").join(known, ["x", "p"], "left").drop("p")
        rest = written(rest.select(*active.columns), "rest")
        open_ = written(rest.groupBy("region").agg((F.min("label") != F.max("label")).alias("open")).where("open").select("region"), "open")
        following = written(rest.join(open_, "region"), "active")
        discard(spark, active, elected, measured, rest, open_)
        active = following
        pivots *= 4
    if links is None:
        return spark.createDataFrame([], "a long, b long")
    return links


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable by links).

    A document's set holds its distinct shingles of `width` words (A-Z lower-cased, split at
    0x20 and 0x09-0x0D); with fewer words the whole sequence is one shingle. Two documents
    link when 100 * intersection >= percent * union. Equal sets are one class, so copies are
    never paired. A counting filter drops classes that cannot have a link, and
    `links_of` joins the others exactly. Shingles are compared as 64-bit hashes, sets as
    128-bit keys.

    A null or empty text has no shingles and is its own component. A null id is linked like
    any other but comes after all ids; repeated rows are equal sets. An empty table gives an
    empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = written(signatures(plain, width), "signed")
    classes = written(signed.where("n > 0").groupBy("key", "key2").agg(
        F.min("id").alias("rep"), F.first("n").alias("n"), F.first("n_sampled").alias("n_sampled")), "classes")
    sent = classes.agg(F.sum("n_sampled")).first()[0] or 0
    shared = shared_counts(plain, width, max(32, -(-int(sent) // BUCKET_SHINGLES)))
    able = written(classes.join(shared, "key", "left").where(
        F.coalesce("shared", F.lit(0)) >= F.col("n_sampled") - missing_at_most(F.col("n"), percent))
        .select(F.col("key").alias("k"), F.col("key2").alias("k2"), F.col("rep")), "able")
    # able grows with the documents: merged at every size, never broadcast
    texts = plain.join(able.hint("merge"), plain["id"].eqNullSafe(able["rep"])).select("text")
    sets = sets_of(texts, width).join(able, (F.col("key") == able["k"]) & (F.col("key2") == able["k2"]), "left_semi")
    sets = written(sets.dropDuplicates(["key"]), "sets")
    links = links_of(sets, percent)
    labels = components(links)
    named = classes.join(labels, classes["key"] == labels["node"], "left").withColumn("label", F.coalesce("label", "key"))
    smallest = written(named.where(F.col("node").isNotNull()).groupBy("label").agg(F.min("rep").alias("component_id")), "smallest")
    found = written(named.join(smallest, "label", "left").select(
        F.col("key").alias("c_key"), F.col("key2").alias("c_key2"), F.coalesce("component_id", "rep").alias("component_id")), "class_components")
    discard(spark, able, sets, links, smallest, labels)
    return signed.join(found, (signed["key"] == found["c_key"]) & (signed["key2"] == found["c_key2"]), "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """`docs` with one document of each component, that of the smallest id; all columns stay.
    Rows with a null id stay if they are linked with no id."""
    found = near_copies(docs, id_col, text_col, width, percent)
    gone = found.where(~F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("gone_id")).distinct()
    return docs.join(gone, docs[id_col].eqNullSafe(gone["gone_id"]), "left_anti")
