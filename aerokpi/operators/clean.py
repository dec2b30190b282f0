"""Cleaned entities and passenger-derived tables (R-1, R-2, R-3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerokpi.functions import (
    booking_id_norm,
    canon_code,
    channel_norm,
    device_norm,
    amount_value,
    parts_total,
    weekday_name,
    whole_days,
    with_parts,
)
from aerokpi.params import DEFAULT, ROUTING_DASH, KpiParams
from aerokpi.sources.schema import ANCILLARY_COLS, REVENUE_COLS


def booking_clean(booking: DataFrame) -> DataFrame:
    """R-1: typed bookings with canonical O&D and derived columns.

    Totals are summed exactly (in 1e-4 units) and converted once.
    """
    return _cleaned(_identified(booking), booking.columns)


def _identified(booking: DataFrame) -> DataFrame:
    return booking.select("*", booking_id_norm("bookingid_pnr").alias("bookingid_norm"))


def _cleaned(identified: DataFrame, columns: list[str], *more: str) -> DataFrame:
    """The cleaned ``columns`` and derived ones of ``_identified`` bookings, and ``more`` as they are."""
    dates = all(isinstance(identified.schema[c].dataType, T.DateType)
                for c in ("reservation_date", "cancellation_date", "flight_date"))
    return with_parts(identified, *REVENUE_COLS).select(
        *[canon_code(c).alias(c) if c in ("origin", "destination") else F.col(c) for c in columns],
        "bookingid_norm",
        amount_value(parts_total(*REVENUE_COLS)).alias("total_revenue"),
        F.concat(canon_code("origin"), F.lit(ROUTING_DASH), canon_code("destination")).alias("routing_canonical"),
        F.col("cancellation_date").isNotNull().alias("is_cancelled"),
        weekday_name("flight_date").alias("flight_dow"),
        whole_days("cancellation_date", "reservation_date", dates).alias("days_after_booking_to_cancel"),
        whole_days("flight_date", "cancellation_date", dates).alias("days_before_flight_to_cancel"),
        whole_days("flight_date", "reservation_date", dates).alias("lead_time_days"),
        amount_value(parts_total(*ANCILLARY_COLS)).alias("ancillary_total"),
        *more,
    )


def passenger_clean(passenger: DataFrame, params: KpiParams = DEFAULT) -> DataFrame:
    """R-2: normalised PNR id, channel (synonyms mapped) and device."""
    return passenger.select(
        "*",
        booking_id_norm("bookingid").alias("bookingid_norm"),
        channel_norm("booking_channel", params.channel_synonyms).alias("booking_channel_norm"),
        device_norm("device_used").alias("device_used_norm"),
    )


def pnr_channel(passenger: DataFrame, params: KpiParams = DEFAULT) -> DataFrame:
    """R-2: primary channel per PNR = first non-null normalised channel in
    source order (``ordinal``). PNRs with only null channels keep a null.

    ``min`` over (ordinal, channel) structs is a plain partial aggregate, so a
    PNR holding a large share of the rows is reduced map-side.
    """
    p = passenger_clean(passenger, params).where(F.col("bookingid_norm").isNotNull())
    ch = F.col("booking_channel_norm")
    first = F.min(F.when(ch.isNotNull(), F.struct(F.col("ordinal").alias("o"), ch.alias("v"))))
    return p.groupBy("bookingid_norm").agg(first.getField("v").alias("primary_channel"))


def pnr_devices(passenger: DataFrame, params: KpiParams = DEFAULT) -> DataFrame:
    """R-2: distinct non-null normalised devices per PNR in first-seen order.

    Two levels: (PNR, device) -> first ordinal, then one short list per PNR
    (bounded by the number of distinct devices, never by the PNR's rows).
    """
    p = passenger_clean(passenger, params).where(F.col("bookingid_norm").isNotNull())
    firsts = p.groupBy("bookingid_norm", "device_used_norm").agg(F.min("ordinal").alias("first_ord"))
    d = F.col("device_used_norm")
    lst = F.array_sort(F.collect_list(F.when(d.isNotNull(), F.struct(F.col("first_ord").alias("o"), d.alias("v")))))
    return firsts.groupBy("bookingid_norm").agg(F.transform(lst, lambda x: x.getField("v")).alias("devices"))


def booking_enriched(booking: DataFrame, passenger: DataFrame, params: KpiParams = DEFAULT) -> DataFrame:
    """R-3: cleaned bookings with the PNR's primary channel (left join; the
    right side has one row per PNR, so no fan-out). Bookings are joined as
    delivered and cleaned afterwards, so no derived column is shuffled."""
    joined = _identified(booking).join(pnr_channel(passenger, params), "bookingid_norm", "left")
    enriched = _cleaned(joined, booking.columns, "primary_channel")
    return enriched.select("bookingid_norm", *[c for c in enriched.columns if c != "bookingid_norm"])
