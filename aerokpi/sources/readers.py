"""Entity sources and sinks: sheets exported as CSV / Parquet, or the test-data adapter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerokpi.sources.publish import publish_folder
from aerokpi.sources.schema import conform, date_orders, elected_orders, normalize_columns


def read_entity(spark: SparkSession, path: str, entity: str, fmt: str = "parquet") -> DataFrame:
    """Read one exported sheet (CSV with header, or Parquet) as a typed entity.

    CSV is read without schema inference (every column a string) and then
    coerced leniently, so a malformed cell yields null instead of failing
    the job. Whether numeric dates put the day or the month first is elected per column
    (`schema.date_orders`), in a pass over the text columns that hold dates.
    """
    if fmt == "csv":
        raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    else:
        raw = spark.read.format(fmt).load(path)
    df = normalize_columns(raw)
    orders = elected_orders(date_orders(df, entity))
    if entity == "passenger" and "ordinal" not in df.columns:
        # "first channel" needs the source row order: by file name, then by the
        # block that a row was read from, then by its place in the block
        at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
        df = in_order(normalize_columns(raw.withColumn("_at", at)), "_at")
    return conform(df, entity, orders)



def in_order(df: DataFrame, at: str) -> DataFrame:
    """``df`` with ``ordinal``, the rank of its rows by column ``at``, which is dropped. Rows
    are range-partitioned and numbered within ranges; ranges follow each other, and
    only their order matters, so no task sees all rows."""
    ranged = df.repartitionByRange(F.col(at)).sortWithinPartitions(at)
    return ranged.withColumn("ordinal", F.monotonically_increasing_id()).drop(at)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", header: bool = True) -> None:
    """Publish a dataset (replace, as one step). CSV gets a header row, Parquet is the default."""
    publish_folder(df, path, fmt, **({"header": header} if fmt == "csv" else {}))
