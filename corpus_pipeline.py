"""Training-text pipeline: quality filter, exact and near copies, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of `documents`. `run` writes each stage's result to the shared folder and reads
it back as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerokpi.llm.common import read_table, ship_package, written
from aerokpi.llm.exact_dedup import drop_exact_copies
from aerokpi.llm.jaccard import drop_near_copies
from aerokpi.llm.packing import pack_documents
from aerokpi.llm.queries import tokenizer_file
from aerokpi.llm.resampling import keep_resampled
from aerokpi.llm.suffix_dedup import without_repeats

#: None: the classifier's noise and the tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling towards documents labelled as good."""
    ship_package(spark)
    return keep_resampled(docs, read_table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal but for white space."""
    ship_package(spark)
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component under word-shingle Jaccard links."""
    ship_package(spark)
    return drop_near_copies(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 100 bytes that also start earlier; n_chars follows."""
    ship_package(spark)
    return without_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 2048 tokens."""
    ship_package(spark)
    return pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("n-gram Jaccard join", near),
          ("suffix-array dedup", passages), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage{i}")
    return docs
