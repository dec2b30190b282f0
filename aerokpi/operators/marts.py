"""Leg-grain marts.

``leg_base`` is the only booking-sized aggregation: one pass over the
bookings at the raw leg grain (flight number, flight date, origin,
destination as delivered) that carries every sum the leg-grain datasets
need, in both null conventions:

* SQL convention: a booking whose revenue has a null part adds nothing,
  and an all-null sum stays null;
* report convention: null parts count as zero, an all-null sum is zero.

All money sums are exact (``*_u`` columns, `functions.money`), so
re-aggregating the base at a coarser grain (date-truncated keys, canonical
O&D codes, flight + date) gives the same numbers as aggregating the
bookings directly, and the hot aggregation stays on primitive longs. Partial aggregation
runs map-side, so the shuffle carries at most (legs x partitions) rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerokpi.functions import (
    canon_code, has_booking_id, money, money_resum, money_sum, parts_total, ratio, sum_value, weekday_name, with_parts,
)
from aerokpi.params import DEFAULT, KpiParams
from aerokpi.sources.schema import ANCILLARY_COLS, REVENUE_COLS

LEG_KEYS = ["flightnumber", "flight_date", "origin", "destination"]


def leg_base(booking: DataFrame) -> DataFrame:
    return with_parts(booking, *REVENUE_COLS).groupBy(*LEG_KEYS).agg(
        F.sum("passengercount").alias("pax_sum"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(has_booking_id("bookingid_pnr")).alias("n_ids"),
        F.count("cancellation_date").alias("cancels"),
        money_sum(parts_total(*REVENUE_COLS, nulls_as_zero=False)).alias("revenue_sql_u"),
        money_sum(parts_total(*REVENUE_COLS)).alias("revenue_all_u"),
        money_sum(parts_total(*ANCILLARY_COLS, nulls_as_zero=False)).alias("anc_sql_u"),
        money_sum(parts_total(*ANCILLARY_COLS)).alias("anc_all_u"),
    )


def _is_date(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, T.DateType)


def leg_sql_grain(base: DataFrame) -> DataFrame:
    """Base re-keyed at the SQL leg grain (flight date truncated to DATE)."""
    if _is_date(base, "flight_date"):
        return base  # already at that grain: no re-aggregation, no shuffle
    return base.groupBy(
        "flightnumber", F.to_date("flight_date").alias("flight_date"), "origin", "destination"
    ).agg(*[(money_resum(c) if c.endswith("_u") else F.sum(c)).alias(c) for c in base.columns if c not in LEG_KEYS])


def leg(base: DataFrame, flight: DataFrame) -> DataFrame:
    """K-1: leg mart, SQL convention; flights joined with plain equality."""
    a = leg_sql_grain(base).select(
        *LEG_KEYS,
        F.col("pax_sum").alias("pax"),
        sum_value("revenue_sql_u").alias("total_revenue"),
        F.col("cancels"),
    )
    f = flight.select(
        F.col("flightnumber").alias("f_flightnumber"),
        F.to_date("flightdate").alias("f_flightdate"),
        F.col("availablecapacity").alias("seats"),
        "timeofday",
        "routetype",
    )
    j = a.join(
        f, (a.flightnumber == f.f_flightnumber) & (a.flight_date == f.f_flightdate), "left"
    ).drop("f_flightnumber", "f_flightdate")
    return j.withColumn("leg_lf", F.when(F.col("seats") > 0, ratio("pax", "seats")))


def segment(leg_df: DataFrame) -> DataFrame:
    """K-2: sums by directed O&D."""
    return leg_df.groupBy("origin", "destination").agg(
        F.sum("pax").alias("pax"),
        F.sum("seats").cast("bigint").alias("seats"),
        sum_value(money_sum(money("total_revenue"))).alias("total_revenue"),
    )


def leg_revpp(leg_df: DataFrame) -> DataFrame:
    """K-6: revenue per passenger where pax > 0."""
    return leg_df.withColumn("rev_per_pax", F.when(F.col("pax") > 0, ratio("total_revenue", "pax")))


SEGMENT = ["origin", "destination"]
YIELD_ORDER = ["rev_per_pax", "flight_date", "flightnumber"]


def _yield_order():
    return [F.col(c).asc_nulls_last() for c in YIELD_ORDER]


def leg_yield_index_window(leg_df: DataFrame, params: KpiParams = DEFAULT) -> DataFrame:
    """K-7 with a plain window (one task per segment); the reference
    implementation that ``leg_yield_index`` is tested against."""
    w = Window.partitionBy(*SEGMENT).orderBy(*_yield_order())
    n = params.yield_buckets
    return (
        leg_revpp(leg_df)
        .withColumn("q5", F.ntile(n).over(w))
        .withColumn("yield_index", (F.col("q5") - 1).cast("double") / F.lit(float(n - 1)))
    )


def ranked_legs(leg_df: DataFrame) -> DataFrame:
    """Legs range-partitioned on (segment, revenue per pax, date, flight) and
    tagged with their range id ``rp``. A segment with many legs spans many
    ranges, so no task ever holds a whole segment. The tag must be made
    stable (written table / checkpoint) before it is used twice."""
    keys = [F.col(c).asc_nulls_last() for c in SEGMENT] + _yield_order()
    return leg_revpp(leg_df).repartitionByRange(*keys).withColumn("rp", F.spark_partition_id())


def leg_yield_index(leg_df: DataFrame, params: KpiParams = DEFAULT, stable=None) -> DataFrame:
    """K-7: quintile of revenue per pax inside the directed segment -> [0, 1].

    Nulls sort last (they land in the top buckets); ties are broken by
    flight date and flight number, so the buckets are deterministic.

    Distributed NTILE: position of a leg in its segment = legs of the
    segment in earlier ranges (a prefix sum over the small (segment, range)
    count table) + its row number inside (segment, range). With N legs in
    the segment and n buckets, the first N mod n buckets get one extra leg,
    exactly as NTILE assigns them. ``stable`` turns the range tag into data
    (default: ``DataFrame.checkpoint``).
    """
    ranged = ranked_legs(leg_df)
    ranged = stable(ranged) if stable is not None else ranged.checkpoint()
    seg = Window.partitionBy(*SEGMENT)
    counts = ranged.groupBy(*SEGMENT, "rp").count()
    offs = counts.select(
        *[F.col(c).alias(f"o_{c}") for c in SEGMENT],
        F.col("rp").alias("o_rp"),
        F.coalesce(F.sum("count").over(seg.orderBy("rp").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("count").over(seg).alias("seg_n"),
    )
    local = F.row_number().over(Window.partitionBy(*SEGMENT, "rp").orderBy(*_yield_order()))
    r = ranged.withColumn("local", local)
    cond = (r.origin.eqNullSafe(offs.o_origin) & r.destination.eqNullSafe(offs.o_destination)
            & (r.rp == offs.o_rp))
    j = r.join(offs, cond, "inner")
    n = params.yield_buckets
    pos = F.col("before") + F.col("local") - 1          # 0-based position in the segment
    q = F.floor(F.col("seg_n") / F.lit(n))               # legs per bucket
    big = F.col("seg_n") - q * n                         # buckets with one extra leg
    cut = big * (q + 1)
    bucket = F.when(pos < cut, F.floor(pos / (q + 1)) + 1).otherwise(
        F.floor((pos - cut) / F.nullif(q, F.lit(0))) + big + 1
    )
    return j.select(
        *leg_df.columns, "rev_per_pax",
        bucket.cast("int").alias("q5"),
    ).withColumn("yield_index", (F.col("q5") - 1).cast("double") / F.lit(float(n - 1)))


def leg_anc(base: DataFrame) -> DataFrame:
    """Ancillary revenue per SQL leg (null-propagating parts), exact units."""
    return leg_sql_grain(base).select(*LEG_KEYS, F.col("anc_sql_u").alias("anc_rev_u"))


def leg_report(base: DataFrame, flight: DataFrame) -> DataFrame:
    """R-4: leg table of the report convention.

    Canonical (upper, trimmed) O&D codes, flight date as delivered, null
    revenue parts as zero, an all-null pax sum as 0, and a null-safe join
    to the flights (a null date matches a null date).
    """
    a = base.groupBy(
        "flightnumber", "flight_date",
        canon_code("origin").alias("origin"), canon_code("destination").alias("destination"),
    ).agg(
        F.coalesce(F.sum("pax_sum"), F.lit(0)).cast("bigint").alias("pax"),
        sum_value(money_resum("revenue_all_u")).alias("revenue"),
        F.sum("cancels").cast("bigint").alias("cancels"),
    )
    f = flight.select(
        F.col("flightnumber").alias("f_flightnumber"), "flightdate", "availablecapacity", "timeofday", "routetype"
    )
    j = a.join(
        f,
        a.flightnumber.eqNullSafe(f.f_flightnumber) & a.flight_date.eqNullSafe(f.flightdate),
        "left",
    ).drop("f_flightnumber", "flightdate")
    return j.select(
        *LEG_KEYS, "pax", "revenue", "cancels", "availablecapacity", "timeofday", "routetype",
        F.when(F.col("availablecapacity") > 0, ratio("pax", "availablecapacity")).alias("load_factor"),
        F.when(F.col("pax") > 0, ratio("revenue", "pax")).alias("rev_per_pax"),
        weekday_name("flight_date").alias("dow"),
    )


def dq_leg(base: DataFrame, flight: DataFrame) -> DataFrame:
    """Leg table of the data-quality checks: raw keys, pax summed with nulls
    as zero, capacity joined null-safely, ``capacity_anomaly`` flag."""
    a = base.select(*LEG_KEYS, F.coalesce(F.col("pax_sum"), F.lit(0)).alias("pax"))
    f = flight.select(F.col("flightnumber").alias("f_flightnumber"), "flightdate", "availablecapacity")
    j = a.join(
        f,
        a.flightnumber.eqNullSafe(f.f_flightnumber) & a.flight_date.eqNullSafe(f.flightdate),
        "left",
    ).drop("f_flightnumber")
    return j.withColumn(
        "capacity_anomaly",
        F.coalesce(F.col("pax") > F.col("availablecapacity"), F.lit(False)) & F.col("availablecapacity").isNotNull(),
    )


def realized_by_flight(base: DataFrame) -> DataFrame:
    """Realized passengers per (flight number, date): pax (nulls as 0) minus
    one per cancelled booking; null keys dropped."""
    return (
        base.where(F.col("flightnumber").isNotNull() & F.col("flight_date").isNotNull())
        .groupBy("flightnumber", "flight_date")
        .agg((F.sum(F.coalesce(F.col("pax_sum"), F.lit(0))) - F.sum("cancels")).cast("bigint").alias("realized_pax"))
    )
