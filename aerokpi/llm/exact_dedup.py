"""Exact deduplication with a heavy-hitter split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerokpi.llm.common import written
from aerokpi.llm.heavy import keep_first

#: Counters of a Misra-Gries summary; also bounds the broadcast winners (about 100 bytes each).
CAPACITY = 1024


def text_digest(text: Column) -> Column:
    """SHA-256 of the text in UTF-8 without the characters 0x20 and 0x09-0x0D."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]", "").cast("binary"), 256))


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after white space (0x20, 0x09-0x0D) is deleted; of equal
    texts the row with the most code points, then the smallest id, stays. Only 32-byte
    digests move. Misra-Gries summaries find the digests that may hold over 1/(capacity+1)
    of the rows; their verified winners are broadcast, and only the other digests are shuffled.

    A null text counts as empty; empty texts are equal to each other. A null id comes after
    all others. Rows that repeat an id and text each get a row with the same decision. An
    empty table gives an empty result; other columns are ignored.
    """
    narrow = docs.select(
        F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("digest"),
        F.coalesce(F.length(text_col), F.lit(0)).alias("points"))
    narrow = written(narrow, "digests")
    order = [-F.col("points"), F.col("id").isNull(), F.col("id")]
    found = keep_first(narrow, "digest", order, "id", narrow.count(), capacity)
    return found.select(
        F.col("id").alias(id_col), F.col("first").alias("keep_id"), "group_size",
        F.col("id").eqNullSafe(F.col("first")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """`docs` without the rows that `exact_copies` does not keep; all columns stay."""
    gone = exact_copies(docs, id_col, text_col, capacity).where(~F.col("kept")).select(
        F.col(id_col).alias("gone_id"), F.unhex("text_sha256").alias("gone_digest")).distinct()
    return docs.join(
        gone, docs[id_col].eqNullSafe(gone["gone_id"]) & (text_digest(docs[text_col]) == gone["gone_digest"]), "left_anti")
