"""Frequent keys by Misra-Gries summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def misra_gries(counts: pd.Series, more: pd.Series, capacity: int) -> pd.Series:
    """Merge two summaries (key -> count) into one of at most `capacity` counters:
    what the (capacity + 1)-th largest counter holds is taken from all."""
    both = counts.add(more, fill_value=0).astype("int64")
    if len(both) > capacity:
        cut = int(np.partition(both.to_numpy(), -capacity - 1)[-capacity - 1])
        both = both - cut
        both = both[both > 0]
    return both


def frequent_keys(table: DataFrame, key: str, n_rows: int, capacity: int) -> DataFrame:
    """Keys that may hold more than n_rows / (capacity + 1) rows: every key with over
    twice that share is among them. `at_least` never exceeds a key's true count, and
    the counts sum to n_rows at most, so at most capacity + 1 keys are returned.
    Each task keeps `capacity` counters. Null keys are left out."""
    kind = table.schema[key].dataType

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = pd.Series(dtype="int64")
        for batch in batches:
            found = batch.column(0).drop_null().value_counts()
            more = pd.Series(found.field("counts").to_numpy(), index=found.field("values").to_pylist())
            kept = misra_gries(kept, more, capacity)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(kept.index), type=arrow), pa.array(kept.to_numpy(), type=pa.int64())], names=[key, "at_least"])

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)
    share = max(2, -(-n_rows // (capacity + 1)))
    return (
        table.select(key).mapInArrow(summarise, f"{key} {kind.simpleString()}, at_least long")
        .groupBy(key).agg(F.sum("at_least").alias("at_least")).where(F.col("at_least") >= share)
    )


def keep_first(table: DataFrame, key: str, order: list[Column], picked: str, n_rows: int, capacity: int) -> DataFrame:
    """`table` with, for the rows of each key, `first` (the column `picked` of the row
    that comes first by `order`) and `group_size`.

    Frequent keys are settled by a partial aggregate and a broadcast of at most
    capacity + 1 verified winners to the rows where they lie; only the rows of the other
    keys, each with a bounded share of all rows, are shuffled."""
    lead = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(picked).alias("picked"))
    heavy = frequent_keys(table, key, n_rows, capacity).select(key)
    winners = (
        table.join(F.broadcast(heavy), key, "left_semi").groupBy(key)
        .agg(F.min(lead).alias("lead"), F.count("*").alias("group_size"))
        .select(key, F.col("lead.picked").alias("first"), "group_size")
    )
    from aerokpi.llm.common import written

    winners = written(winners, "winners")
    marked = table.join(F.broadcast(winners), key, "left")
    rest = Window.partitionBy(key)
    return marked.where(F.col("group_size").isNotNull()).unionByName(
        table.join(F.broadcast(winners.select(key)), key, "left_anti")
        .withColumn("first", F.min(lead).over(rest)["picked"])
        .withColumn("group_size", F.count("*").over(rest))
        .select(*marked.columns)
    )
