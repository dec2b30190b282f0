"""Approximate nearest neighbours by randomly rotated one-bit codes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Width of the error bound of an estimate, in standard deviations.
ERROR_WIDTH = 3.0
#: Bits to which a component of a rotated query is rounded; what rounding loses joins the bound.
QUERY_BITS = 6
#: Bytes (eight a component) of one candidate chunk and of the queries of one block; a task
#: compares one of each, whatever the vectors' length.
CHUNK_BYTES = 4 << 20
BLOCK_BYTES = 8 << 20
#: Queries whose estimates are held at once.
AT_ONCE = 16
_SEED = 7


@lru_cache(maxsize=2)
def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(_SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def in_words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits packed into 64-bit words, the last filled up with zeros."""
    packed = np.packbits(bits, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def one_bit_codes(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs of the rotated unit vectors (64-bit words), their norms, and the inner
    product of each unit vector with its code (the correction scalar)."""
    norms = np.linalg.norm(vectors, axis=1)
    turned = (vectors / norms[:, None]) @ rotation(vectors.shape[1])
    agree = np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])
    return in_words(turned > 0), norms, agree


def rounded_queries(queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rotated queries as whole numbers of QUERY_BITS bits: their bit planes (planes x queries
    x words), the value of zero and of one step, and the sum of what rounding changed."""
    turned = queries @ rotation(queries.shape[1])
    low = turned.min(axis=1)
    step = (turned.max(axis=1) - low) / (2**QUERY_BITS - 1)
    step[step == 0] = 1.0
    whole = np.rint((turned - low[:, None]) / step[:, None]).astype(np.int64)
    lost = np.abs(turned - (low[:, None] + whole * step[:, None])).sum(axis=1)
    return np.stack([in_words((whole >> bit) & 1 == 1) for bit in range(QUERY_BITS)]), low, step, lost


def estimates(codes: np.ndarray, norms: np.ndarray, agree: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (queries x vectors) and their error bounds.

    A code's product with a rounded query is counted from packed bits: the bits that the code
    shares with each of the query's planes, times the plane's power of two, and the bits
    of the code and of the planes alone. Norm and correction scalar turn it into an estimate.
    The bound is that of the random rotation, ERROR_WIDTH deviations, and all that rounding lost."""
    dim = queries.shape[1]
    planes, low, step, lost = rounded_queries(queries)
    shared = np.zeros((len(queries), len(codes)), dtype=np.uint32)
    both, bits = np.empty(shared.shape, np.uint64), np.empty(shared.shape, np.uint8)
    for plane in planes[::-1]:  # the highest first, doubled with every further one
        shared <<= np.uint32(1)
        for word in range(codes.shape[1]):
            np.bitwise_and(codes[:, word], plane[:, word, None], out=both)
            shared += np.bitwise_count(both, out=bits)
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    whole = sum(np.bitwise_count(p).sum(axis=1, dtype=np.int64) << bit for bit, p in enumerate(planes))
    # signs are 2 b - 1, components low + step u: the sum of (2 b - 1) (low + step u)
    product = 2 * step[:, None] * shared + 2 * low[:, None] * ones - (dim * low + step * whole)[:, None]
    scale = norms / agree / np.sqrt(dim)
    spread = norms * ERROR_WIDTH * np.sqrt(np.maximum(0, 1 - agree**2) / agree**2 / max(1, dim - 1))
    return product * scale, np.linalg.norm(queries, axis=1)[:, None] * spread + lost[:, None] * scale


def nearest_in_chunk(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, codes: np.ndarray,
                     norms: np.ndarray, agree: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query number, vector numbers, exact scores) of the k best of a chunk found for each
    query; `ids` ascend.

    The vectors with the best estimates are scored exactly; the k-th best of these scores is
    a threshold, and every other vector whose estimate plus error bound reaches it is
    reranked as well."""
    first = min(len(ids), 4 * k)
    for at in range(0, len(queries), AT_ONCE):
        block = queries[at : at + AT_ONCE]
        guess, bound = estimates(codes, norms, agree, block)
        for j in range(len(block)):
            estimate = guess[j]
            estimate[ids == query_ids[at + j]] = -np.inf
            top = np.argpartition(-estimate, first - 1)[:first]
            top = top[np.isfinite(estimate[top])]
            if not len(top):
                continue
            exact = vectors[top] @ block[j]
            least = np.partition(exact, -k)[-k] if len(exact) >= k else -np.inf
            reach = (estimate + bound[j] >= least) & np.isfinite(estimate)
            reach[top] = True
            found = np.flatnonzero(reach)
            score = np.einsum("ij,j->i", vectors[found], block[j])
            if len(found) > k:  # only these can be among the best, ties included
                high = score >= np.partition(score, -k)[-k]
                found, score = found[high], score[high]
            best = np.lexsort((found, -score))[:k]
            yield at + j, found[best], score[best]


def usable(vector: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of one length as rows of doubles."""
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else pc.list_flatten(column).to_numpy()
    return flat.astype(np.float64).reshape(len(column), -1)


def coded(vectors: DataFrame) -> DataFrame:
    """Columns id, v and dim with the code, norm and correction scalar of every vector."""
    schema = T.StructType([*vectors.schema.fields, T.StructField("code", T.BinaryType()), T.StructField("norm", T.DoubleType()), T.StructField("agree", T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim in pc.unique(batch.column("dim")).to_pylist():
                rows = batch.filter(pc.equal(batch.column("dim"), dim))
                codes, norms, agree = one_bit_codes(matrix(rows.column("v")))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms), pa.array(agree)],
                                                 names=schema.names)

    return vectors.mapInArrow(work, schema)


def search(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding",
           chunk_bytes: int = CHUNK_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest of `vectors` found for each row of
    `queries` by largest inner product, ties to the smaller id; score is the inner product
    of the original vectors in double precision. A query doesn't find rows of its own id.

    Every vector is indexed by the signs of its randomly rotated direction (one bit a
    component) and two scalars. Vectors are dealt by a hash of the id into chunks and queries
    into blocks; a task holds one chunk and one block and returns k rows a query, and the
    chunks' lists are merged. Both counts follow the input's bytes, nothing is broadcast or
    dropped. Vectors travel beside their codes, in the input's own element type: the bounds of
    one-bit codes leave a large share of a chunk to rerank at lengths like 64, so
    fetching them by id would move more.

    Vectors of each length are searched among their own. Vectors that are null, zero or hold
    null or non-finite components take no part. Repeated ids: every row is a candidate; of
    repeated queries the smallest vector of each length asks, and what they find is ranked
    together. Null ids take no part. Fewer candidates than k give fewer rows, empty tables none; other columns are ignored.
    """
    id_type = vectors.schema[id_col].dataType

    def clean(df: DataFrame) -> DataFrame:
        element = df.schema[vector_col].dataType.elementType
        own = F.col(vector_col) if isinstance(element, (T.FloatType, T.DoubleType)) else F.col(vector_col).cast("array<double>")
        return df.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).alias("id"), own.alias("v")).withColumn("dim", F.size("v"))

    all_rows = clean(vectors)
    asked = clean(queries).groupBy("id", "dim").agg(F.min("v").alias("v"))

    def parts(df: DataFrame, size: int) -> int:
        return max(1, -(-8 * (df.agg(F.sum("dim")).first()[0] or 0) // size))

    n_chunks, n_blocks = parts(all_rows, chunk_bytes), parts(clean(queries), block_bytes)

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    dealt = coded(all_rows).withColumn("chunk", F.pmod(F.xxhash64("id", F.lit("chunk")), F.lit(n_chunks))).withColumn("block", every(n_blocks))
    blocks = asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), F.lit(n_blocks))).withColumn("chunk", every(n_chunks))
    schema = T.StructType([T.StructField("query_id", id_type), T.StructField("vec_id", id_type), T.StructField("score", T.DoubleType())])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        if not len(left) or not len(right):
            return arrow.empty_table()
        left, right = left.sort_by("id"), right.sort_by("id")
        codes = np.frombuffer(b"".join(left["code"].to_pylist()), dtype=np.uint64).reshape(len(left), -1)
        found = list(nearest_in_chunk(matrix(right["v"]), right["id"].to_numpy(), matrix(left["v"]), left["id"].to_numpy(), codes,
                                      left["norm"].to_numpy(), left["agree"].to_numpy(), k))
        if not found:
            return arrow.empty_table()
        asking = np.repeat([j for j, _, _ in found], [len(at) for _, at, _ in found])
        at, score = (np.concatenate(x) for x in list(zip(*found))[1:])
        return pa.Table.from_arrays([right["id"].take(pa.array(asking)), left["id"].take(pa.array(at)), pa.chunked_array([pa.array(score)])], schema=arrow)

    keys = ["dim", "chunk", "block"]
    lists = dealt.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInArrow(compare, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
