"""Rule-based insight lines (R-20).

Each rule is a 0- or 1-row DataFrame computed from the exploration tables
(all of them a handful of rows), so the union never exceeds twelve rows
and nothing is collected to the driver. Columns:
``rule, subject, value, value2, text``; numbers stay numeric in ``value``
and ``value2``, the text formats them (percent with one decimal, whole
numbers, two decimals; half-to-even rounding as in Python formatting).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerokpi.operators import explore
from aerokpi.params import DEFAULT, WEEKDAYS, KpiParams

# ---------------------------------------------------------------------------
# The text of each rule. Placeholders: {name:pct} percent with
# one decimal, {name:int} whole number, {name:2f} two decimals, {name} text.
# ---------------------------------------------------------------------------
TEMPLATES = {
    "A": "No cancellations recorded on: {days} → Avoid overbooking on these days; use standard buffers only.",
    "B": "Highest cancellation rate: {dow} (rate={rate:pct}) → tighten fare fences and increase overbooking buffers on this weekday.",
    "C": "Median days after booking to cancel ≈ {med:int}, P90 ≈ {p90:int} → design refund rules & retention nudges within these windows.",
    "D": "Median days before flight to cancel ≈ {med:int}, P90 ≈ {p90:int} → calibrate overbooking and release of low fares accordingly.",
    "E": "Channel with highest cancel rate: {channel} (≈ {rate:pct}) → steer demand to direct channels or adjust partner SLAs.",
    "F": "Lowest average LF: {low} (≈ {low_v:pct}); Highest: {high} (≈ {high_v:pct}) → re-time or stimulate low days; protect yield on high days.",
    "G": "Time-of-day LF: weakest={low} (≈ {low_v:pct}), strongest={high} (≈ {high_v:pct}) → bank timing & pricing by day-part.",
    "H_low": "Rev/Pax vs LF correlation ≈ {corr:2f} → filling extra seats may dilute yield; prioritize yield protection at higher LF.",
    "H_high": "Rev/Pax vs LF correlation ≈ {corr:2f} → some headroom to fill seats without heavy dilution; targeted promos OK.",
    "I": "Largest directional imbalance: {origin}→{destination} vs reverse (ΔLF≈ {diff:pct}) → asymmetric pricing or gauge.",
    "J": "Ancillary share: low on {low_o}→{low_d} (≈ {low_v:pct}), high on {high_o}→{high_d} (≈ {high_v:pct}) → target bundles where low.",
    "K": "Last-minute cancellations (≤1 day) ≈ {share:pct} of cancels → raise buffers & pre-emptive reaccommodation in this window.",
    "L": "KPI pack to track weekly: Cancellation Rate by DOW & Channel, Median/P90 cancel timing, LF by DOW & Time-of-Day, Rev/Pax vs LF, Directional LF Imbalance, Ancillary Share by OD.",
}

_PH = re.compile(r"\{(\w+)(?::(\w+))?\}")


def template_parts(template: str) -> list[tuple[str, str | None, str | None]]:
    """Split a template into (literal, placeholder, format) triples."""
    out, pos = [], 0
    for m in _PH.finditer(template):
        out.append((template[pos:m.start()], m.group(1), m.group(2)))
        pos = m.end()
    out.append((template[pos:], None, None))
    return out


def _fmt(c, kind: str | None) -> F.Column:
    if kind == "pct":
        return F.concat(F.format_string("%.1f", F.bround(c * 100.0, 1)), F.lit("%"))
    if kind == "int":
        return F.bround(c, 0).cast("bigint").cast("string")
    if kind == "2f":
        return F.format_string("%.2f", F.bround(c, 2))
    return c.cast("string")


def render(template: str, cols: dict) -> F.Column:
    pieces = []
    for lit, name, kind in template_parts(template):
        if lit:
            pieces.append(F.lit(lit))
        if name:
            pieces.append(_fmt(cols[name], kind))
    return F.concat(*pieces)


def _row(df: DataFrame, rule: str, subject, value, value2, text) -> DataFrame:
    return df.select(
        F.lit(rule).alias("rule"),
        (subject if subject is not None else F.lit(None)).cast("string").alias("subject"),
        (value if value is not None else F.lit(None)).cast("double").alias("value"),
        (value2 if value2 is not None else F.lit(None)).cast("double").alias("value2"),
        text.alias("text"),
    )


def _ord(col: str) -> F.Column:
    return F.array_position(F.array(*[F.lit(d) for d in WEEKDAYS]), F.col(col))


def _side_by_side(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two frames of at most one row with disjoint columns -> one row with
    all columns, or no row if either is empty (a union plus a one-group
    aggregate; no join)."""
    ca, cb = a.columns, b.columns
    ua = a.select(*ca, *[F.lit(None).cast(b.schema[c].dataType).alias(c) for c in cb],
                  F.lit(1).alias("_in_a"), F.lit(0).alias("_in_b"))
    ub = b.select(*[F.lit(None).cast(a.schema[c].dataType).alias(c) for c in ca], *cb,
                  F.lit(0).alias("_in_a"), F.lit(1).alias("_in_b"))
    both = ua.unionByName(ub).agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ca + cb],
        F.max("_in_a").alias("_in_a"), F.max("_in_b").alias("_in_b"),
    )
    return both.where((F.col("_in_a") == 1) & (F.col("_in_b") == 1)).drop("_in_a", "_in_b")


def _extremes(df: DataFrame, key: str, val: str, order) -> DataFrame:
    """One row: key and value of the minimum and of the maximum of ``val``
    (nulls ignored, ties broken by ``order``)."""
    v = df.where(F.col(val).isNotNull())
    lo = v.orderBy(F.col(val).asc(), *order).limit(1).select(F.col(key).alias("low"), F.col(val).alias("low_v"))
    hi = v.orderBy(F.col(val).desc(), *order).limit(1).select(F.col(key).alias("high"), F.col(val).alias("high_v"))
    return _side_by_side(lo, hi)


def insights(spark: SparkSession, booking: DataFrame, passenger: DataFrame, base: DataFrame,
             leg_report: DataFrame, params: KpiParams = DEFAULT) -> DataFrame:
    T = TEMPLATES
    c = F.col
    rows = []

    # A: weekdays without cancellations (calendar order)
    by_dow = explore.cancellation_by_dow(spark, base).withColumn("ord", _ord("flight_dow"))
    zero = by_dow.where(c("cancel_count") == 0).agg(
        F.array_sort(F.collect_list(F.struct("ord", "flight_dow"))).alias("z")
    ).where(F.size("z") > 0)
    days = F.array_join(F.transform(c("z"), lambda x: x.getField("flight_dow")), ", ")
    rows.append(_row(zero, "A", days, F.size("z"), None, render(T["A"], {"days": days})))

    # B: weekday with the highest cancellation rate (first in calendar order)
    top = by_dow.orderBy(F.coalesce(c("cancel_rate"), F.lit(-1.0)).desc(), c("ord")).limit(1).where(
        c("cancel_rate").isNotNull()
    )
    rows.append(_row(top, "B", c("flight_dow"), c("cancel_rate"), None,
                     render(T["B"], {"dow": c("flight_dow"), "rate": c("cancel_rate")})))

    # C, D, K: cancellation timing (only when something was cancelled): one
    # aggregation over the bookings, whose row is fanned out into three lines
    timing = explore.cancellation_timing(booking, params).where(c("n_cancel") > 0)

    def line(rule: str, value: str, value2: str | None, text: F.Column) -> F.Column:
        return F.struct(F.lit(rule).alias("rule"), F.lit(None).cast("string").alias("subject"), c(value).alias("value"),
                        (c(value2) if value2 else F.lit(None).cast("double")).alias("value2"), text.alias("text"))

    lines = [line(rule, med, p90, render(T[rule], {"med": c(med), "p90": c(p90)})) for rule, med, p90 in (
        ("C", "median_days_after_booking", "p90_days_after_booking"),
        ("D", "median_days_before_flight", "p90_days_before_flight"),
    )] + [line("K", "last_minute_share", None, render(T["K"], {"share": c("last_minute_share")}))]
    rows.append(timing.select(F.explode(F.array(*lines)).alias("l")).select("l.*")
                .where(c("value").isNotNull() & ((c("rule") == "K") | c("value2").isNotNull())))

    # E: channel with the highest cancellation rate among channels with enough bookings
    ch = (
        explore.cancellation_by_channel(booking, passenger, params)
        .where(c("bookings") > params.channel_min_bookings)
        .orderBy(c("cancel_rate").desc_nulls_last(), c("primary_channel").asc_nulls_last())
        .limit(1)
        .where(c("cancel_rate").isNotNull())
    )
    rows.append(_row(ch, "E", c("primary_channel"), c("cancel_rate"), None,
                     render(T["E"], {"channel": c("primary_channel"), "rate": c("cancel_rate")})))

    # F: lowest / highest weekday LF
    f = _extremes(explore.lf_by_dow(spark, leg_report).withColumn("ord", _ord("dow")), "dow", "avg_load_factor", [c("ord")])
    cols = {k: c(k) for k in ("low", "low_v", "high", "high_v")}
    rows.append(_row(f, "F", F.concat_ws(" / ", "low", "high"), c("low_v"), c("high_v"), render(T["F"], cols)))

    # G: weakest / strongest time of day
    g = _extremes(explore.lf_by_time_of_day(leg_report), "timeofday", "avg_load_factor", [c("timeofday")])
    rows.append(_row(g, "G", F.concat_ws(" / ", "low", "high"), c("low_v"), c("high_v"), render(T["G"], cols)))

    # H: revenue per pax vs LF correlation
    corr = explore.rev_lf_correlation(leg_report, params).where(c("rev_lf_corr").isNotNull())
    text = F.when(c("rev_lf_corr") < params.correlation_cut, render(T["H_low"], {"corr": c("rev_lf_corr")})).otherwise(
        render(T["H_high"], {"corr": c("rev_lf_corr")})
    )
    rows.append(_row(corr, "H", None, c("rev_lf_corr"), None, text))

    # I: largest directional imbalance (absolute)
    imb = (
        explore.directional_imbalance(leg_report)
        .orderBy(F.abs("lf_diff_vs_reverse").desc_nulls_last(), c("origin").asc_nulls_last(), c("destination").asc_nulls_last())
        .limit(1)
        .where(c("lf_diff_vs_reverse").isNotNull())  # no line for a network without a reverse direction
    )
    rows.append(_row(imb, "I", F.concat(c("origin"), F.lit("→"), c("destination")), c("lf_diff_vs_reverse"), None,
                     render(T["I"], {"origin": c("origin"), "destination": c("destination"), "diff": c("lf_diff_vs_reverse")})))

    # J: lowest / highest ancillary share among the top segments by revenue
    top_seg = explore.anc_share_top_segments(base, params.top_segments_chart)
    ties = [c("revenue").desc_nulls_last(), c("origin").asc_nulls_last(), c("destination").asc_nulls_last()]
    lo = top_seg.orderBy(c("anc_share").asc_nulls_last(), *ties).limit(1).select(
        c("origin").alias("low_o"), c("destination").alias("low_d"), c("anc_share").alias("low_v"))
    hi = top_seg.orderBy(c("anc_share").desc_nulls_last(), *ties).limit(1).select(
        c("origin").alias("high_o"), c("destination").alias("high_d"), c("anc_share").alias("high_v"))
    j = _side_by_side(lo, hi).where(c("low_v").isNotNull() & c("high_v").isNotNull())
    jc = {k: c(k) for k in ("low_o", "low_d", "low_v", "high_o", "high_d", "high_v")}
    rows.append(_row(j, "J", F.concat(c("low_o"), F.lit("→"), c("low_d"), F.lit(" / "), c("high_o"), F.lit("→"), c("high_d")),
                     c("low_v"), c("high_v"), render(T["J"], jc)))

    # L: fixed KPI-pack line
    one = spark.range(1)
    rows.append(_row(one, "L", None, None, None, F.lit(T["L"])))

    return reduce(DataFrame.unionByName, rows).orderBy("rule")
