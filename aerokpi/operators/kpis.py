"""Core KPIs over the SQL-convention leg mart (K-3 ... K-11, K-21)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerokpi.functions import money_resum, ratio, sum_value
from aerokpi.operators.marts import leg_anc, leg_yield_index
from aerokpi.params import DEFAULT, KpiParams


def fwlf_overall(leg: DataFrame) -> DataFrame:
    """K-3: sum(pax) / sum(seats); legs without capacity still add pax."""
    return leg.agg(ratio(F.sum("pax"), F.sum("seats")).alias("fwlf"))


def fwlf_by_segment(leg: DataFrame) -> DataFrame:
    """K-4."""
    return leg.groupBy("origin", "destination").agg(ratio(F.sum("pax"), F.sum("seats")).alias("fwlf"))


def calf_overall(leg: DataFrame) -> DataFrame:
    """K-11: identical formula to FWLF, published under its own name."""
    return leg.agg(ratio(F.sum("pax"), F.sum("seats")).alias("calf"))


def pacs_leg(leg: DataFrame, params: KpiParams = DEFAULT) -> DataFrame:
    """K-5: (revenue + revenue*pct - seats*cost) / seats, per leg."""
    rev = F.col("total_revenue")
    pct = F.lit(float(params.connection_value_pct))
    cost = F.lit(float(params.variable_cost_per_seat_leg))
    conn = rev * pct
    return leg.select(
        "flightnumber", "flight_date", "origin", "destination", "seats", "total_revenue",
        conn.alias("connection_value"),
        ratio(rev + conn - F.col("seats") * cost, "seats").alias("pacs_per_seat_leg"),
    )


def pacs_top(leg: DataFrame, k: int, params: KpiParams = DEFAULT, descending: bool = True) -> DataFrame:
    """Top / bottom k legs by PACS (nulls last, ties by the leg key)."""
    p = pacs_leg(leg, params)
    m = F.col("pacs_per_seat_leg")
    order = [m.desc_nulls_last() if descending else m.asc_nulls_last()] + [
        F.col(c).asc_nulls_last() for c in ("flight_date", "flightnumber", "origin", "destination")
    ]
    return p.orderBy(*order).limit(k)


def pacs_chart(leg: DataFrame, k: int, params: KpiParams = DEFAULT, descending: bool = True) -> DataFrame:
    """R-21 chart input: top/bottom k PACS with the bar label
    ``origin→destination yyyy-MM-dd``."""
    p = pacs_top(leg, k, params, descending)
    return p.select(
        "flightnumber", "flight_date", "origin", "destination", "pacs_per_seat_leg",
        F.concat(F.col("origin"), F.lit("→"), F.col("destination"), F.lit(" "),
                 F.col("flight_date").cast("string")).alias("label"),
    )


def yalf_overall(leg: DataFrame, params: KpiParams = DEFAULT, stable=None) -> DataFrame:
    """K-8: sum(pax * yield_index) / sum(seats)."""
    y = leg_yield_index(leg, params, stable)
    return y.agg(ratio(F.sum(F.col("pax") * F.col("yield_index")), F.sum("seats")).alias("yalf"))


def aras_overall(base: DataFrame, leg: DataFrame) -> DataFrame:
    """K-9: ancillary revenue / seats over the join of ancillary per
    (flight number, date) with legs on those two keys only (a flight number
    serving several O&Ds on one date fans out, as in the definition)."""
    anc = leg_anc(base).groupBy("flightnumber", "flight_date").agg(money_resum("anc_rev_u").alias("ancillary_u"))
    j = anc.join(leg.select("flightnumber", "flight_date", "seats"), ["flightnumber", "flight_date"], "inner")
    return j.agg(ratio(sum_value(money_resum("ancillary_u")), F.sum("seats")).alias("aras"))


def srm_proxy(leg: DataFrame) -> DataFrame:
    """K-10: passenger legs per distinct flight (flight number + date)."""
    key = F.concat(F.col("flightnumber"), F.lit("_"), F.col("flight_date").cast("string"))
    return leg.agg(ratio(F.sum("pax"), F.count_distinct(key)).alias("passenger_legs_per_flight"))


def mart_checks(leg: DataFrame, params: KpiParams = DEFAULT) -> DataFrame:
    """K-21: the three mart sanity counts in one scan."""
    return leg.agg(
        F.count_if(F.col("pax") < 0).alias("cnt_bad_pax"),
        F.count_if(F.col("seats").isNull() | (F.col("seats") <= 0)).alias("cnt_bad_seats"),
        F.count_if((F.col("leg_lf") < 0) | (F.col("leg_lf") > F.lit(params.lf_upper_bound))).alias("cnt_bad_lf"),
    )
