"""Quality filtering by importance resampling over hashed n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerokpi.llm.common import written
from aerokpi.llm.hashing import shingle_hashes, word_hashes
from aerokpi.llm.units import chunks

#: Hash buckets of the unigram and bigram models; bounds what the driver gathers and broadcasts.
BUCKETS = 1 << 17
#: Added to every bucket's count, as a share of the mean count.
SMOOTHING = 1.0
#: N-grams that a weight stands for: documents are weighed as if all had this length, so that
#: short clean documents aren't lost to the noise and long ones don't win by length alone.
REFERENCE_LENGTH = 256
#: Labelled target documents that the target model is fitted on (a hashed sample beyond);
#: bounds the broadcast set of their ids.
MAX_TARGET_DOCS = 200_000


def features(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every word (lower half) and pair of adjacent words (upper half)."""
    words, rows = word_hashes(data, offsets)
    pairs, pair_rows = shingle_hashes(words, rows, len(offsets) - 1, 2)
    half = np.uint64(buckets // 2)
    return (np.concatenate((words % half, half + pairs % half)).astype(np.int64), np.concatenate((rows, pair_rows)))


def bucket_counts(docs: DataFrame, text_col: str, target: Column, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, raw, target): n-grams of all documents and of those where `target` holds."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), dtype=np.int64)
        for rows in batches:
            wanted = rows.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in chunks(rows.column(0)):
                bucket, row = features(data, offsets, buckets)
                total[0] += np.bincount(bucket, minlength=buckets)
                total[1] += np.bincount(bucket[wanted[a:b][row]], minlength=buckets)
        some = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0, some]), pa.array(total[1, some])], names=["bucket", "raw", "target"])

    return docs.select(F.col(text_col), target.alias("wanted")).mapInArrow(work, "bucket long, raw long, target long") \
        .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> np.ndarray:
    """log(target frequency / raw frequency) of each bucket; all 0 without target text."""
    found = counts.toPandas()  # one row a bucket at most
    raw, target = np.zeros(buckets), np.zeros(buckets)
    raw[found["bucket"]], target[found["bucket"]] = found["raw"], found["target"]
    out = np.zeros(buckets)
    for part in (slice(0, buckets // 2), slice(buckets // 2, buckets)):  # a model for words, one for pairs
        r, t = raw[part], target[part]
        if t.sum() > 0:
            p = r + smoothing * r.mean()
            p /= p.sum()
            q = t + smoothing * t.mean()  # what the target lacks has the mean frequency's share
            q /= q.sum()
            out[part] = np.log(q / p)
    return out


def log_weights(docs: DataFrame, keep: list[str], text_col: str, ratios: np.ndarray, within: str | None = None) -> DataFrame:
    """The columns `keep` with log_weight (the mean log ratio of a document's n-grams, at
    the reference length) and n_words. The text is a column, or a field of the kept struct
    `within`, so that it goes to Python once."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("log_weight", T.DoubleType()), T.StructField("n_words", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, table = to_arrow_schema(schema), shared.value
        for rows in batches:
            texts = rows.column(len(keep)) if within is None else rows.column(keep.index(within)).field(text_col)
            for a, b, data, offsets in chunks(texts):
                bucket, row = features(data, offsets, len(table))
                weight = np.bincount(row, table[bucket], b - a) / np.maximum(1, np.bincount(row, minlength=b - a)) * REFERENCE_LENGTH
                n = np.bincount(row[bucket < len(table) // 2], minlength=b - a)
                yield pa.RecordBatch.from_arrays([rows.column(i).slice(a, b - a) for i in range(len(keep))] + [pa.array(weight), pa.array(n)], schema=arrow)

    return docs.select(*keep, *([text_col] if within is None else [])).mapInArrow(work, schema)


def gumbel(key: Column, seed: int) -> Column:
    """Standard Gumbel noise that depends on the row's key and the seed only."""
    uniform = (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(uniform))


def kth_largest(table: DataFrame, value: str, k: int) -> int | None:
    """The k-th largest of a bigint column, 16 bits at a time: each round gathers counts of at
    most 65,536 prefixes, so any number of rows is ranked without sorting them."""
    if k <= 0:
        return None
    rest = table.select(F.col(value).alias("v"))
    prefix = None
    for bits in (48, 32, 16, 0):
        some = rest if prefix is None else rest.where(F.shiftright("v", bits + 16) == prefix)
        counts = some.groupBy(F.shiftright("v", bits).alias("p")).count().collect()
        for row in sorted(counts, key=lambda r: -r["p"]):
            if row["count"] >= k:
                prefix = row["p"]
                break
            k -= row["count"]
        else:
            return None
    return prefix


def weigh(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, seed: int, buckets: int) -> tuple[DataFrame, np.ndarray, int | None]:
    """The weights table (id, log_weight, n_words, key, rank_key) of all documents, the log
    ratios, and the least rank key that is kept (None: none is)."""
    good = written(labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
                   .groupBy(F.col(id_col).alias("label_id")).agg(F.max(label_col).alias("good")), "labels")
    ids = good.where("good = 1")
    n_target = ids.count()
    if n_target > MAX_TARGET_DOCS:
        ids = ids.where(F.pmod(F.xxhash64("label_id", F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * MAX_TARGET_DOCS / n_target))
    marked = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = bucket_counts(marked.join(F.broadcast(ids.select("label_id")), F.col("id") == F.col("label_id"), "left"),
                           "text", F.col("label_id").isNotNull(), buckets)
    ratios = log_ratios(counts, buckets)
    share = good.agg(F.avg((F.col("good") == 1).cast("double"))).first()[0]
    scored = written(with_keys(log_weights(marked, ["id"], "text", ratios), seed), "weights")
    n = scored.count()
    return scored, ratios, kth_largest(scored, "rank_key", n if share is None else round(n * share))


def with_keys(scored: DataFrame, seed: int) -> DataFrame:
    return scored.withColumn("key", F.col("log_weight") + gumbel(F.col("id"), seed)).withColumn("rank_key", F.round(F.col("key") * 1e6).cast("long"))


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
             seed: int = 0, buckets: int = BUCKETS) -> DataFrame:
    """One row per document: id, log_weight, key, n_words, kept.

    Two generative models over hashed words and word pairs, one of the documents labelled 1
    (the target) and one of all documents (the raw text), give each document its log
    importance weight. Its key is the weight plus Gumbel noise drawn from the id; the k
    largest keys are kept (Gumbel top-k: sampling without replacement in proportion to the
    weights), where k is the share of labels that are 1, applied to all documents.

    The raw model counts every document; the target model up to about MAX_TARGET_DOCS. A null
    text counts as empty (weight 0). With no label everything is kept. Rows that tie at the
    last key are kept together; repeated rows have equal keys; a null id has the noise of its
    own hash and is never a target. An id with labels that disagree counts as 1. An empty
    table gives an empty result; other columns are ignored.
    """
    scored, _, least = weigh(docs, labels, id_col, text_col, label_col, seed, buckets)
    kept = F.lit(False) if least is None else F.col("rank_key") >= least
    return scored.select(F.col("id").alias(id_col), "log_weight", "key", "n_words", kept.alias("kept"))


def keep_resampled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                   seed: int = 0, buckets: int = BUCKETS) -> DataFrame:
    """The rows of `docs` that `resample` keeps, with all their columns. The texts are weighed
    again where they lie instead of being shuffled to the decisions."""
    _, ratios, least = weigh(docs, labels, id_col, text_col, label_col, seed, buckets)
    if least is None:
        return docs.limit(0)
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"))
    return with_keys(log_weights(whole, ["row", "id"], text_col, ratios, "row"), seed).where(F.col("rank_key") >= least).select("row.*")
