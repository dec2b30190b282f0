"""Places of rows in a sorted table, found without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerokpi.llm.common import written

#: monotonically_increasing_id keeps the row number of a task in its lower 33 bits.
_ROW_BITS = 33


def positions(table: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """`table`, a written table, with `pos`, the 0-based place of a row among those of its
    `group` (a column, null being a group too) by `order`, and `n`, the group's rows.

    Rows are range-partitioned by group and order, so a large group spans many tasks; what
    comes before a range is a sum over the (group, range) counts. Rows that tie lie in any
    order, in several ranges if need be."""
    tie = "place_tie"
    by = [F.col(group).asc_nulls_first(), *order, F.col(tie).asc()]
    ranged = table.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    ranged = written(ranged.drop(tie).withColumn("place_row", F.monotonically_increasing_id()), name)
    part = F.shiftright("place_row", _ROW_BITS)
    counts = ranged.groupBy(F.col(group).alias("place_group"), part.alias("place_part")).agg(
        F.count("*").alias("rows"), F.min("place_row").alias("lowest"))
    whole = Window.partitionBy("place_group")
    ahead = whole.orderBy("place_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("place_group", "place_part", (F.coalesce(F.sum("rows").over(ahead), F.lit(0)) - F.col("lowest")).alias("shift"),
                           F.sum("rows").over(whole).alias("n"))
    found = ranged.withColumn("part_here", part).join(
        starts, F.col(group).eqNullSafe(F.col("place_group")) & (F.col("part_here") == F.col("place_part")))
    return found.select(*table.columns, (F.col("place_row") + F.col("shift")).alias("pos"), "n")
