"""The booking row checks on a stream of arriving bookings.

The analysed project is batch-only. Its nine per-booking data-quality
rules are pure row predicates, so they also run unchanged on a streaming
DataFrame: bookings landing as files in a folder are flagged as they
arrive, and a stateful aggregate keeps the running count per check.
Checks that need the whole table (duplicates, per-PNR channel/device
counts, leg capacity) stay in the batch job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from aerokpi.operators.dq import BOOKING_CHECKS, booking_flags, dq_booking
from aerokpi.sources.schema import DATE_LIKE, ENTITIES


def booking_schema(dates: T.DataType = T.DateType()) -> T.StructType:
    return T.StructType([T.StructField(n, dates if t == DATE_LIKE else t, True) for n, t in ENTITIES["booking"]])


def flag_bookings(bookings: DataFrame) -> DataFrame:
    """Bookings failing at least one row check, with the list of failed checks.
    Works on batch and streaming DataFrames alike."""
    b = dq_booking(bookings)
    flags = booking_flags(b)
    failed = F.filter(
        F.array(*[F.when(flags[n], F.lit(n)) for n in BOOKING_CHECKS]), lambda x: x.isNotNull()  # null flag: passes
    )
    return b.withColumn("failed_checks", failed).where(F.size("failed_checks") > 0)


def running_counts(flagged: DataFrame) -> DataFrame:
    """Stateful count of offending bookings per check."""
    return flagged.select(F.explode("failed_checks").alias("check")).groupBy("check").count()


def read_booking_stream(spark: SparkSession, source_dir: str, fmt: str = "parquet",
                        max_files_per_trigger: int = 64) -> DataFrame:
    return (
        spark.readStream.schema(booking_schema()).format(fmt)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .load(source_dir)
    )


def start_row_checks(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                     fmt: str = "parquet", available_now: bool = True) -> StreamingQuery:
    """Append offending bookings to ``sink_dir`` (exactly once via the
    checkpoint; a restarted query resumes where it stopped)."""
    flagged = flag_bookings(read_booking_stream(spark, source_dir, fmt))
    w = flagged.writeStream.format("parquet").option("checkpointLocation", checkpoint_dir).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start(sink_dir)


def start_running_counts(spark: SparkSession, source_dir: str, checkpoint_dir: str, query_name: str,
                         fmt: str = "parquet") -> StreamingQuery:
    """Complete-mode running counts per check into an in-memory table
    ``query_name`` (for monitoring; bounded by the number of checks)."""
    counts = running_counts(flag_bookings(read_booking_stream(spark, source_dir, fmt)))
    return (
        counts.writeStream.format("memory").queryName(query_name)
        .option("checkpointLocation", checkpoint_dir).outputMode("complete")
        .trigger(availableNow=True).start()
    )
