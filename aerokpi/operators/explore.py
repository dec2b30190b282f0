"""Exploration datasets.

SQL convention (over the ``leg`` mart): K-14 ... K-20.
Report convention (over ``leg_report`` / bookings): R-5 ... R-13, R-17,
R-19, R-21. In the report convention a null group key is dropped, except
for O&D codes (kept as a group of their own).

Operators return full-precision doubles. The registry publishes averages
rounded to ``AVG_DIGITS`` decimals (``published``): the last bits of a
floating-point sum depend on the order in which partitions are combined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerokpi.functions import (
    booking_id_norm, canon_code, money, money_resum, money_resum_times, money_sum, ratio, segment_label, sum_value, weekday_name,
)
from aerokpi.operators.clean import booking_clean, pnr_channel
from aerokpi.operators.marts import leg_anc, leg_revpp
from aerokpi.operators.quantiles import quantiles
from aerokpi.params import DEFAULT, TIMES_OF_DAY, WEEKDAYS, KpiParams

#: Decimals of published averages; the snap removes order-dependent noise at exact ties.
AVG_DIGITS = 6
SNAP_DIGITS = 10


def published(c) -> F.Column:
    """A value as published: rounded to AVG_DIGITS after snapping to SNAP_DIGITS, in plain
    IEEE doubles (ties to even), so any engine doing the same operations gets the same
    bits and no value is clamped to an integer range."""
    c = F.col(c) if isinstance(c, str) else c
    for digits in (SNAP_DIGITS, AVG_DIGITS):
        p = F.lit(float(10**digits))
        c = F.rint(c * p) / p
    return c


def spine(spark: SparkSession, labels, name: str, ord_name: str) -> DataFrame:
    """A small fixed list of labels with their 1-based position, built in the
    JVM (``range`` + array lookup: no Python rows to ship)."""
    arr = F.array(*[F.lit(x) for x in labels])
    return spark.range(1, len(labels) + 1).select(
        F.element_at(arr, F.col("id").cast("int")).alias(name), F.col("id").cast("int").alias(ord_name)
    )


def calendar(spark: SparkSession) -> DataFrame:
    """7-row weekday spine (name, ordinal 1..7)."""
    return spine(spark, WEEKDAYS, "dow", "dow_ord")


def on_calendar(spark: SparkSession, df: DataFrame, key: str = "dow") -> DataFrame:
    """All seven weekdays in calendar order, values of ``df`` joined by name.

    ``df`` has at most one row per weekday, so the join is between two
    frames of <= 7 rows: broadcast has a proven bound.
    """
    cal = calendar(spark).withColumnRenamed("dow", key)
    return F.broadcast(cal).join(F.broadcast(df), key, "left").orderBy("dow_ord").drop("dow_ord")


# ---------------------------------------------------------------------------
# SQL convention over the leg mart
# ---------------------------------------------------------------------------
def lf_by_time(leg: DataFrame) -> DataFrame:
    """K-14: mean leg LF per time of day (null time of day kept)."""
    return leg.groupBy("timeofday").agg(F.avg("leg_lf").alias("avg_lf"))


def lf_by_time_ordered(spark: SparkSession, leg: DataFrame) -> DataFrame:
    """R-21: K-14 on the Morning/Afternoon/Evening spine, in that order."""
    tod = spine(spark, TIMES_OF_DAY, "timeofday", "tod_ord")
    leg = leg.where(F.col("timeofday").isin(*TIMES_OF_DAY))  # at most three groups: a proven broadcast bound
    return F.broadcast(tod).join(F.broadcast(lf_by_time(leg)), "timeofday", "left").orderBy("tod_ord").drop("tod_ord")


def anc_share_segment(base: DataFrame, leg: DataFrame) -> DataFrame:
    """K-15: ancillary (per 4-key leg) joined to legs on flight number and date
    only, then ancillary / leg revenue by the ancillary side's O&D."""
    # legs reduced to one row per (flight number, date) before the join, so a
    # flight on many O&Ds is never expanded into all pairs of them
    a = leg_anc(base)
    flights = leg.groupBy("flightnumber", "flight_date").agg(
        F.count(F.lit(1)).alias("n_legs"), money_sum(money("total_revenue")).alias("revenue_u"))
    j = a.join(flights, ["flightnumber", "flight_date"])
    return j.groupBy("origin", "destination").agg(
        ratio(sum_value(money_resum_times("anc_rev_u", "n_legs")), sum_value(money_resum("revenue_u"))).alias("anc_share")
    )


def cancel_rate_segment(leg: DataFrame) -> DataFrame:
    """K-16: mean over legs of cancels / (pax + cancels)."""
    tot = F.col("pax") + F.col("cancels")
    return leg.groupBy("origin", "destination").agg(
        F.avg(F.when(tot > 0, ratio("cancels", tot))).alias("cancel_rate")
    )


_LEG_TIES = ("flight_date", "flightnumber", "origin", "destination")


def _ties():
    return [F.col(c).asc_nulls_last() for c in _LEG_TIES]


def lf_outliers(leg: DataFrame, k: int, lowest: bool) -> DataFrame:
    """K-17 / K-18: k lowest / highest leg LF, nulls last."""
    m = F.col("leg_lf")
    return (
        leg.select("flightnumber", "flight_date", "origin", "destination", "leg_lf", "total_revenue")
        .orderBy(m.asc_nulls_last() if lowest else m.desc_nulls_last(), *_ties())
        .limit(k)
    )


def yield_outliers(leg: DataFrame, k: int, lowest: bool) -> DataFrame:
    """K-19 / K-20: k highest / lowest revenue per pax (lowest skips nulls)."""
    r = leg_revpp(leg).select("flightnumber", "flight_date", "origin", "destination", "rev_per_pax", "leg_lf")
    m = F.col("rev_per_pax")
    if lowest:
        return r.where(m.isNotNull()).orderBy(m.asc(), *_ties()).limit(k)
    return r.orderBy(m.desc_nulls_last(), *_ties()).limit(k)


def scatter_lf_revpp(leg: DataFrame) -> DataFrame:
    """R-21: complete (LF, revenue per pax) pairs of the SQL leg mart."""
    cols = ["flightnumber", "flight_date", "origin", "destination", "leg_lf", "rev_per_pax"]
    return leg_revpp(leg).select(*cols).na.drop(subset=["leg_lf", "rev_per_pax"])


# ---------------------------------------------------------------------------
# Report convention
# ---------------------------------------------------------------------------
def cancellation_by_dow(spark: SparkSession, base: DataFrame) -> DataFrame:
    """R-5: bookings, cancellations and rate per flight weekday (7 rows).

    Read from the leg base (the weekday is a function of its flight-date
    key), so this scans legs, not bookings."""
    b = base.withColumn("dow", weekday_name("flight_date")).where(F.col("dow").isNotNull())
    agg = b.groupBy("dow").agg(
        F.sum("n_rows").alias("bookings"), F.sum("cancels").alias("cancel_count")
    )
    out = on_calendar(spark, agg)
    return out.select(
        F.col("dow").alias("flight_dow"),
        F.coalesce("bookings", F.lit(0)).cast("bigint").alias("bookings"),
        F.coalesce("cancel_count", F.lit(0)).cast("bigint").alias("cancel_count"),
        F.when(F.col("bookings") > 0, ratio("cancel_count", "bookings")).alias("cancel_rate"),
    )


def cancel_days_hist(booking: DataFrame, column: str) -> DataFrame:
    """R-6: histogram of whole days among cancelled bookings (null dropped,
    negative values kept)."""
    b = booking_clean(booking).where(F.col("is_cancelled") & F.col(column).isNotNull())
    return b.groupBy(column).agg(F.count(F.lit(1)).alias("count")).orderBy(column)


def cancellation_by_channel(booking: DataFrame, passenger: DataFrame, params: KpiParams = DEFAULT) -> DataFrame:
    """R-7: bookings, cancellations and rate by the PNR's primary channel.

    Bookings are first reduced to one row per PNR (count, cancellations), so
    the join to the channel table is PNR-sized, not booking-sized.
    """
    per_pnr = (
        booking.select(booking_id_norm("bookingid_pnr").alias("bookingid_norm"), "cancellation_date")
        .where(F.col("bookingid_norm").isNotNull())
        .groupBy("bookingid_norm")
        .agg(F.count(F.lit(1)).alias("n"), F.count("cancellation_date").alias("c"))
    )
    ch = pnr_channel(passenger, params).where(F.col("primary_channel").isNotNull())
    j = per_pnr.join(ch, "bookingid_norm")
    return j.groupBy("primary_channel").agg(
        F.sum("n").cast("bigint").alias("bookings"),
        F.sum("c").cast("bigint").alias("cancels"),
    ).withColumn("cancel_rate", F.when(F.col("bookings") > 0, ratio("cancels", "bookings")))


def lf_by_dow(spark: SparkSession, leg_report: DataFrame) -> DataFrame:
    """R-8: mean over flight dates of the mean leg LF of the date, by weekday
    (7 rows, calendar order)."""
    by_date = (
        leg_report.where(F.col("flight_date").isNotNull())
        .groupBy("flight_date")
        .agg(F.avg("load_factor").alias("load"))
    )
    by_dow = by_date.groupBy(F.date_format("flight_date", "EEEE").alias("dow")).agg(F.avg("load").alias("avg_load_factor"))
    return on_calendar(spark, by_dow)


def lf_by_time_of_day(leg_report: DataFrame) -> DataFrame:
    """R-9: mean LF per time of day (null time of day dropped)."""
    return (
        leg_report.where(F.col("timeofday").isNotNull())
        .groupBy("timeofday")
        .agg(F.avg("load_factor").alias("avg_load_factor"))
    )


def lf_segment_dow_long(leg_report: DataFrame) -> DataFrame:
    """R-10 (long): mean LF by O&D and weekday, with the segment label."""
    return (
        leg_report.where(F.col("dow").isNotNull())
        .groupBy("origin", "destination", "dow")
        .agg(F.avg("load_factor").alias("load_factor"))
        .withColumn("segment", segment_label())
    )


def _weekday_order() -> F.Column:
    return F.array_position(F.array(*[F.lit(d) for d in WEEKDAYS]), F.col("dow"))


def _labelled(leg_report: DataFrame) -> DataFrame:
    """(dow, segment, load_factor) where there is a value and a label; a null label (null O&D
    code) can name neither a column nor a key and is left out, as by a pivot."""
    long = lf_segment_dow_long(leg_report).where(F.col("load_factor").isNotNull() & F.col("segment").isNotNull())
    return long.groupBy("dow", "segment").agg(F.max("load_factor").alias("load_factor"))


def lf_segment_dow_map(leg_report: DataFrame) -> DataFrame:
    """R-10 (wide, any segments): one row per weekday that has a value, in calendar order,
    with ``load_factors``, a MAP from segment to mean LF in label order. One aggregate, a
    schema that doesn't depend on the data, empty for a sheet without load factors."""
    entries = F.sort_array(F.collect_list(F.struct("segment", "load_factor")))
    return _labelled(leg_report).groupBy("dow").agg(F.map_from_entries(entries).alias("load_factors")).orderBy(_weekday_order())


def lf_segment_dow_wide(leg_report: DataFrame, segments=None) -> DataFrame:
    """R-10 (wide): one row per weekday that has a value, in calendar order, one column per
    segment that the caller names; without names, ``lf_segment_dow_map``. The plan never
    depends on the data: no segments are gathered, and a named segment that isn't flown is
    a column of nulls."""
    if segments is None:
        return lf_segment_dow_map(leg_report)
    cells = _labelled(leg_report)
    named = [F.max(F.when(F.col("segment") == x, F.col("load_factor"))).alias(x) for x in segments]
    wide = cells.groupBy("dow").agg(*named) if named else cells.select("dow").distinct()
    return wide.orderBy(_weekday_order())


def segment_kpis(base: DataFrame) -> DataFrame:
    """R-11: per canonical O&D: bookings (non-null ids), cancellations, pax,
    revenue, cancel rate, revenue per pax and ancillary share -- one
    aggregation over the leg base (no join)."""
    s = base.groupBy(canon_code("origin").alias("origin"), canon_code("destination").alias("destination")).agg(
        F.sum("n_ids").cast("bigint").alias("bookings"),
        F.sum("cancels").cast("bigint").alias("cancels"),
        F.coalesce(F.sum("pax_sum"), F.lit(0)).cast("bigint").alias("pax"),
        sum_value(money_resum("revenue_all_u")).alias("revenue"),
        sum_value(money_resum("anc_all_u")).alias("num"),
    )
    return s.select(
        "origin", "destination", "bookings", "cancels", "pax", "revenue",
        F.when(F.col("bookings") > 0, ratio("cancels", "bookings")).alias("cancel_rate"),
        F.when(F.col("pax") > 0, ratio("revenue", "pax")).alias("rev_per_pax"),
        F.col("revenue").alias("denom"),
        "num",
        F.when(F.col("revenue") > 0, ratio("num", "revenue")).alias("anc_share"),
    )


def anc_share_top_segments(base: DataFrame, k: int) -> DataFrame:
    """R-21: the k segments with most revenue, with label ``origin→destination``."""
    return (
        segment_kpis(base)
        .orderBy(F.col("revenue").desc_nulls_last(), F.col("origin").asc_nulls_last(), F.col("destination").asc_nulls_last())
        .limit(k)
        .withColumn("od", segment_label())
    )


def lf_by_segment(leg_report: DataFrame) -> DataFrame:
    return leg_report.groupBy("origin", "destination").agg(F.avg("load_factor").alias("load_factor"))


def directional_imbalance(leg_report: DataFrame) -> DataFrame:
    """R-12: mean LF of each O&D minus that of the reverse O&D (null when the
    reverse is not flown). A self-join of the segment table (segments, not
    legs, so both sides are small)."""
    s = lf_by_segment(leg_report)
    rev = s.select(
        F.col("destination").alias("origin"), F.col("origin").alias("destination"),
        F.col("load_factor").alias("load_factor_rev"),
    )
    j = s.join(rev, ["origin", "destination"], "left")
    return j.select(
        "origin", "destination",
        "load_factor",
        "load_factor_rev",
        (F.col("load_factor") - F.col("load_factor_rev")).alias("lf_diff_vs_reverse"),
    )


def rev_lf_correlation(leg_report: DataFrame, params: KpiParams = DEFAULT) -> DataFrame:
    """R-13: Pearson correlation of LF and revenue per pax over complete pairs,
    null unless there are more than ``min_corr_pairs`` pairs."""
    p = leg_report.na.drop(subset=["load_factor", "rev_per_pax"])
    return p.agg(
        F.when(F.count(F.lit(1)) > params.min_corr_pairs, F.corr("load_factor", "rev_per_pax")).alias("rev_lf_corr")
    )


TIMING_STATS = ("median_days_after_booking", "p90_days_after_booking",
                "median_days_before_flight", "p90_days_before_flight")


def cancellation_timing(booking: DataFrame, params: KpiParams = DEFAULT) -> DataFrame:
    """One row over the cancelled bookings: exact (linearly interpolated)
    median and P90 of both timings, the last-minute share and the number
    of cancellations. The quantiles are found when the plan is built, by rank
    search (``quantiles``), so no task holds a map of the distinct values."""
    b = booking_clean(booking).where("is_cancelled")
    after, before = "days_after_booking_to_cancel", "days_before_flight_to_cancel"
    flag = F.coalesce(F.col(before) <= params.last_minute_days, F.lit(False))
    found = quantiles(b, [(after, 0.5), (after, 0.9), (before, 0.5), (before, 0.9)])
    return b.agg(
        *[F.lit(x).cast("double").alias(name) for name, x in zip(TIMING_STATS, found)],
        F.avg(flag.cast("double")).alias("last_minute_share"),
        F.count(F.lit(1)).alias("n_cancel"),
    )


def cancel_timing_stats(booking: DataFrame, params: KpiParams = DEFAULT) -> DataFrame:
    """R-19: median and P90 of the two cancellation timings."""
    return cancellation_timing(booking, params).select(*TIMING_STATS)


def last_minute_share(booking: DataFrame, params: KpiParams = DEFAULT) -> DataFrame:
    """R-19: share of cancellations made at most ``last_minute_days`` before
    the flight (an unknown timing counts as not last-minute)."""
    late = F.col("days_before_flight_to_cancel") <= params.last_minute_days
    return booking_clean(booking).where("is_cancelled").agg(F.avg(F.coalesce(late, F.lit(False)).cast("double")).alias("last_minute_share"))


def ancillary_share_by_segment(base: DataFrame) -> DataFrame:
    """R-17: ancillary / revenue per canonical O&D (report convention)."""
    s = base.groupBy(canon_code("origin").alias("origin"), canon_code("destination").alias("destination")).agg(
        sum_value(money_resum("revenue_all_u")).alias("revenue"),
        sum_value(money_resum("anc_all_u")).alias("ancillary"),
    )
    return s.withColumn("aras", F.when(F.col("revenue") > 0, ratio("ancillary", "revenue"))).withColumn(
        "od", segment_label()
    )


def ancillary_share_top(base: DataFrame, k: int) -> DataFrame:
    return (
        ancillary_share_by_segment(base)
        .orderBy(F.col("revenue").desc_nulls_last(), F.col("origin").asc_nulls_last(), F.col("destination").asc_nulls_last())
        .limit(k)
    )


def network_avg_ancillary_share(base: DataFrame) -> DataFrame:
    """R-17: unweighted mean of the per-segment ancillary share."""
    return ancillary_share_by_segment(base).agg(F.avg("aras").alias("network_avg_ancillary_share"))
