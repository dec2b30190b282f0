"""Weekday KPIs of the management report (R-14 ... R-18, R-21).

All inputs are leg-grain (report convention); every output has the seven
weekdays in calendar order (a missing weekday gets nulls).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerokpi.functions import ratio
from aerokpi.operators.explore import calendar, on_calendar
from aerokpi.operators.marts import realized_by_flight
from aerokpi.params import DEFAULT, KpiParams


def _fwlf(leg_report: DataFrame) -> DataFrame:
    s = leg_report.where(F.col("dow").isNotNull()).groupBy("dow").agg(
        F.sum("pax").alias("p"), F.sum("availablecapacity").alias("c")
    )
    return s.select("dow", F.when(F.col("c") > 0, ratio("p", "c")).alias("fwlf"))


def _calf(leg_report: DataFrame, base: DataFrame) -> DataFrame:
    r = realized_by_flight(base)
    j = leg_report.join(r, ["flightnumber", "flight_date"], "left")
    calf = F.when(F.col("availablecapacity") > 0, ratio("realized_pax", "availablecapacity"))
    return j.where(F.col("dow").isNotNull()).groupBy("dow").agg(F.avg(calf).alias("calf"))


def _credited(leg_report: DataFrame, params: KpiParams) -> tuple[DataFrame, F.Column]:
    """The legs with the onward mean of their weekday, and the PACS of a leg."""
    fo, fd = params.feeder_segment
    oo, od = params.onward_segment
    onward = (
        leg_report.where((F.col("origin") == oo) & (F.col("destination") == od) & F.col("dow").isNotNull())
        .groupBy("dow")
        .agg(F.avg("revenue").alias("onward_rev"))
    )
    legs = leg_report.where(F.col("dow").isNotNull()).join(F.broadcast(onward), "dow", "left")
    feeder = (F.col("origin") == fo) & (F.col("destination") == fd)
    credit = F.lit(float(params.dow_connection_value_pct)) * F.coalesce(F.col("onward_rev"), F.lit(0.0))
    rev = F.when(F.coalesce(feeder, F.lit(False)), F.col("revenue") + credit).otherwise(F.col("revenue"))
    cap = F.col("availablecapacity")
    return legs, F.when(cap > 0, ratio(rev - cap * F.lit(float(params.dow_variable_cost_per_seat_leg)), cap))


def _pacs(leg_report: DataFrame, params: KpiParams) -> DataFrame:
    legs, pacs = _credited(leg_report, params)
    return legs.groupBy("dow").agg(F.avg(pacs).alias("pacs"))


def _fwlf_pacs(leg_report: DataFrame, params: KpiParams) -> DataFrame:
    """FWLF and PACS of each weekday in one aggregation over the legs."""
    legs, pacs = _credited(leg_report, params)
    s = legs.groupBy("dow").agg(F.sum("pax").alias("p"), F.sum("availablecapacity").alias("c"), F.avg(pacs).alias("pacs"))
    return s.select("dow", F.when(F.col("c") > 0, ratio("p", "c")).alias("fwlf"), "pacs")


def fwlf_by_dow(spark: SparkSession, leg_report: DataFrame) -> DataFrame:
    """R-14: sum(pax) / sum(capacity) per weekday, null if sum(capacity) <= 0."""
    return on_calendar(spark, _fwlf(leg_report))


def calf_realized_by_dow(spark: SparkSession, leg_report: DataFrame, base: DataFrame) -> DataFrame:
    """R-15: realized LF = realized pax of the (flight number, date) / leg
    capacity, averaged per weekday. Realized pax joins on two of the leg's
    four keys, as defined (a flight number on several O&Ds fans out)."""
    return on_calendar(spark, _calf(leg_report, base))


def pacs_feeder_by_dow(spark: SparkSession, leg_report: DataFrame, params: KpiParams = DEFAULT) -> DataFrame:
    """R-16: mean PACS per weekday where only the feeder segment is credited
    with ``pct`` x the mean onward-segment revenue of the same weekday.

    The onward means form a <= 7-row table (one per weekday), so it is
    broadcast; a weekday without onward legs credits 0.
    """
    return on_calendar(spark, _pacs(leg_report, params))


def _on_calendar_many(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    """Calendar left-joined with several <= 7-row weekday tables at once."""
    out = calendar(spark)
    for p in parts:
        out = out.join(F.broadcast(p), "dow", "left")
    return out.orderBy("dow_ord").drop("dow_ord")


def kpi_summary_by_dow(spark: SparkSession, leg_report: DataFrame, base: DataFrame,
                       params: KpiParams = DEFAULT) -> DataFrame:
    """R-18: weekday table of FWLF, weekday PACS and realized CALF."""
    out = _on_calendar_many(spark, [_fwlf_pacs(leg_report, params), _calf(leg_report, base)])
    return out.select("dow", "fwlf", F.col("pacs").alias("pacs_per_seat"), "calf")


def fwlf_calf_by_dow(spark: SparkSession, leg_report: DataFrame, base: DataFrame) -> DataFrame:
    """R-21: input of the grouped FWLF / CALF bar chart."""
    return _on_calendar_many(spark, [_fwlf(leg_report), _calf(leg_report, base)]).select("dow", "fwlf", "calf")
