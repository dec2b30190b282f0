"""The fifteen data-quality checks (DQ-1 ... DQ-15) and their summary.

Row checks on bookings are boolean columns of one projection, so the
summary counts all of them in a single scan (``count_if`` per flag).
Passenger checks aggregate per PNR first; leg checks run on the
data-quality leg table (raw keys, null-safe capacity join). Offender sets
are filters (or semi joins) of the same frames.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerokpi.functions import amount_value, booking_id_norm, canon_code, parts_total, routing_key, with_parts
from aerokpi.params import DEFAULT, DQ_CHECKS, ROUTING_DASH, SEGMENT_ARROW, KpiParams
from aerokpi.sources.schema import REVENUE_COLS

BOOKING_CHECKS = (
    "canceled_with_checkin_ancillary",
    "cancellation_before_reservation",
    "reservation_after_flight",
    "revenue_with_zero_passengers",
    "negative_revenue_fields",
    "negative_passengers",
    "routing_inconsistent_with_od",
    "cancellation_with_positive_pax",
    "missing_flight_date",
)
PASSENGER_CHECKS = {"same_booking_multiple_channels": "booking_channel", "same_booking_multiple_devices": "device_used"}
LEG_CHECKS = ("pax_exceeds_capacity", "missing_capacity_for_leg", "capacity_out_of_range")
DUP_KEYS = ["bookingid_norm", "flightnumber", "flight_date", "origin", "destination"]


def _false_if_null(c) -> F.Column:
    return F.coalesce(c, F.lit(False))


def dq_booking(booking: DataFrame) -> DataFrame:
    """Bookings as the checks see them: raw codes, money as DOUBLE, plus the
    normalised PNR, canonical routing and the zero-filled total revenue."""
    return _checked(booking.select(*booking.columns, booking_id_norm("bookingid_pnr").alias("bookingid_norm")))


def _checked(identified: DataFrame) -> DataFrame:
    """``dq_booking`` of bookings that have ``bookingid_norm`` as their last column."""
    return with_parts(identified, *REVENUE_COLS).select(
        *identified.columns,
        F.concat(canon_code("origin"), F.lit(ROUTING_DASH), canon_code("destination")).alias("routing_canonical"),
        amount_value(parts_total(*REVENUE_COLS)).alias("total_revenue"),
    )


def booking_flags(booking: DataFrame) -> dict[str, F.Column]:
    """Check name -> predicate over ``dq_booking``.

    A predicate may be null where an input is null; in a filter or a
    ``count_if`` null acts as false, which is the rule's meaning, and
    leaving the predicate bare lets Parquet push it into the scan. Only
    the negated routing rule needs an explicit null-as-false."""
    c = F.col
    cancelled = c("cancellation_date").isNotNull()
    r_up = routing_key("routing")
    o, d = routing_key("origin"), routing_key("destination")
    consistent = (r_up == F.concat(o, F.lit(ROUTING_DASH), d)) | (r_up == F.concat(o, F.lit(SEGMENT_ARROW), d))
    return {
        "canceled_with_checkin_ancillary": cancelled & (c("revenue_per_booking_ancilliary_at_check_in") > 0),
        "cancellation_before_reservation": c("cancellation_date") < c("reservation_date"),
        "reservation_after_flight": c("reservation_date") > c("flight_date"),
        "revenue_with_zero_passengers": (c("passengercount") == 0) & (c("total_revenue") > 0),
        "negative_revenue_fields": reduce(lambda a, b: a | b, [c(x) < 0 for x in REVENUE_COLS]),
        "negative_passengers": c("passengercount") < 0,
        "routing_inconsistent_with_od": ~_false_if_null(consistent),
        "cancellation_with_positive_pax": cancelled & (c("passengercount") > 0),
        "missing_flight_date": c("flight_date").isNull(),
    }


def booking_check(booking: DataFrame, name: str) -> DataFrame:
    b = dq_booking(booking)
    return b.where(booking_flags(b)[name])


def duplicate_legs_within_pnr(booking: DataFrame, stable=None) -> DataFrame:
    """DQ-13: every booking whose (PNR, flight, date, O, D) occurs more than
    once, nulls equal. Groups are counted with a partial aggregate, then the
    offending keys are semi-joined back null-safely: a hot key never has to
    fit in one task's memory (AQE splits skewed semi-join partitions).

    ``stable`` turns the offending keys into data (a written table), whose size
    is known before the join is planned: bookings are shuffled only if the keys
    are too many to be broadcast. Derived columns are computed after the join."""
    d = duplicate_keys(booking)
    d = (stable(d) if stable is not None else d).drop("is_duplicate", "n_bookings")
    b = booking.select(*booking.columns, booking_id_norm("bookingid_pnr").alias("bookingid_norm"))
    cond = reduce(lambda x, y: x & y, [b[k].eqNullSafe(d[f"dup_{k}"]) for k in DUP_KEYS])
    return _checked(b.join(d, cond, "left_semi"))


def _passenger_ids(passenger: DataFrame) -> DataFrame:
    return passenger.withColumn("bookingid_norm", booking_id_norm("bookingid"))


def _several(c: str) -> F.Column:
    """More than one distinct value, a null counting as one (one partial aggregate)."""
    mixed = (F.count(c) > 0) & (F.count(c) < F.count(F.lit(1)))
    return F.coalesce(F.min(c) != F.max(c), F.lit(False)) | mixed


def passenger_per_pnr(passenger: DataFrame) -> DataFrame:
    """Per PNR: rows, and whether it has several raw channels (devices)."""
    p = _passenger_ids(passenger).where(F.col("bookingid_norm").isNotNull())
    return p.groupBy("bookingid_norm").agg(
        F.count(F.lit(1)).alias("n"),
        *[_several(col).alias(f"several_{name}") for name, col in PASSENGER_CHECKS.items()],
    )


def passenger_check(passenger: DataFrame, name: str) -> DataFrame:
    """DQ-4 / DQ-5: passenger rows of PNRs with more than one distinct raw
    channel (device); a null counts as a value."""
    ids = passenger_per_pnr(passenger).where(f"several_{name}").select("bookingid_norm")
    return _passenger_ids(passenger).join(ids, "bookingid_norm", "left_semi")


def leg_flags(dq_leg_df: DataFrame, params: KpiParams = DEFAULT) -> dict[str, F.Column]:
    cap = F.col("availablecapacity")
    return {
        "pax_exceeds_capacity": F.col("capacity_anomaly"),
        "missing_capacity_for_leg": cap.isNull(),
        "capacity_out_of_range": cap.isNotNull() & ((cap < params.capacity_min) | (cap > params.capacity_max)),
    }


def leg_check(dq_leg_df: DataFrame, name: str, params: KpiParams = DEFAULT) -> DataFrame:
    return dq_leg_df.where(leg_flags(dq_leg_df, params)[name])


def dq_summary(booking: DataFrame, passenger: DataFrame, dq_leg_df: DataFrame,
               params: KpiParams = DEFAULT, duplicates: DataFrame | None = None) -> DataFrame:
    """DQ-S: (check, count) for the fifteen checks, most offenders first,
    ties in check order. Four one-row aggregates (bookings, duplicate groups,
    PNRs, legs), each unpivoted to (check, count) rows and unioned: no
    offender row reaches the driver. ``duplicates`` may be a written table of
    ``duplicate_keys``."""
    b = dq_booking(booking)
    bf = booking_flags(b)
    row_counts = b.agg(*[F.count_if(bf[n]).alias(n) for n in BOOKING_CHECKS])
    dup = (
        (duplicate_keys(booking) if duplicates is None else duplicates)
        .agg(F.coalesce(F.sum("n_bookings"), F.lit(0)).cast("bigint").alias("duplicate_legs_within_pnr"))
    )
    per = passenger_per_pnr(passenger)
    pax = per.agg(*[
        F.coalesce(F.sum(F.when(F.col(f"several_{n}"), F.col("n"))), F.lit(0)).cast("bigint").alias(n)
        for n in PASSENGER_CHECKS
    ])
    lf = leg_flags(dq_leg_df, params)
    legs = dq_leg_df.agg(*[F.count_if(lf[n]).alias(n) for n in LEG_CHECKS])

    def as_rows(one_row: DataFrame, names) -> DataFrame:  # (check, count) rows
        cols = list(names)
        return one_row.select(*[F.col(n).cast("bigint").alias(n) for n in cols]).unpivot([], cols, "check", "count")

    long = reduce(DataFrame.unionByName, [
        as_rows(row_counts, BOOKING_CHECKS), as_rows(dup, ["duplicate_legs_within_pnr"]),
        as_rows(pax, PASSENGER_CHECKS), as_rows(legs, LEG_CHECKS),
    ])
    order = F.array_position(F.array(*[F.lit(n) for n in DQ_CHECKS]), F.col("check"))
    return long.orderBy(F.col("count").desc(), order)


def duplicate_keys(booking: DataFrame) -> DataFrame:
    """The (PNR, flight, date, O, D) that occur more than once, under names of their own, and how
    often they do."""
    dups = dq_booking(booking).groupBy(*DUP_KEYS).count().where(F.col("count") > 1)
    return dups.select(*[F.col(k).alias(f"dup_{k}") for k in DUP_KEYS], F.lit(True).alias("is_duplicate"), F.col("count").alias("n_bookings"))


def _exploded(df: DataFrame, flags: dict[str, F.Column]) -> DataFrame:
    """The rows of ``df`` that fail a check, once per check, with ``check``."""
    names = F.array_compact(F.array(*[F.when(flag, F.lit(n)) for n, flag in flags.items()]))
    return df.withColumn("check", F.explode(names))


def offenders(booking: DataFrame, duplicates: DataFrame, passenger: DataFrame, dq_leg_df: DataFrame,
              params: KpiParams = DEFAULT) -> DataFrame:
    """Offending rows of all fifteen checks in long form: ``check``, ``entity`` and the columns
    of bookings, passengers and legs (null where the entity lacks them).

    Bookings, passengers and legs are read once each: a row's failed checks are gathered in
    an array and exploded. ``duplicates`` is a written table of ``duplicate_keys``."""
    b = dq_booking(booking)
    cond = reduce(lambda x, y: x & y, [b[k].eqNullSafe(duplicates[f"dup_{k}"]) for k in DUP_KEYS])
    b = b.join(duplicates, cond, "left").drop(*[f"dup_{k}" for k in DUP_KEYS], "n_bookings")
    rows = _exploded(b, {**booking_flags(b), "duplicate_legs_within_pnr": F.col("is_duplicate")}).drop("is_duplicate")
    per = passenger_per_pnr(passenger).drop("n")
    several = {n: F.col(f"several_{n}") for n in PASSENGER_CHECKS}
    people = _exploded(_passenger_ids(passenger).join(per, "bookingid_norm"), several).drop(*[f"several_{n}" for n in PASSENGER_CHECKS])
    legs = _exploded(dq_leg_df, leg_flags(dq_leg_df, params))
    parts = [x.withColumn("entity", F.lit(e)) for x, e in ((rows, "booking"), (people, "passenger"), (legs, "leg"))]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
