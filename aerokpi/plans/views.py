"""Persistent KPI views (SNK-3): SQL text over published marts.

The marts hold every quantity that needs a shuffle of bookings, exact money totals or the
distributed quintiles; a view holds the formula alone, so it follows the marts whenever
they are published anew and is seen by every session of the catalog. Parameters are
literals of the text: publishing with other parameters replaces the views.

Money totals of a view are decimal sums (the same bits in any order). Amounts of more than
eight decimals are rounded to eight there, and an amount of 1e16 or more is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerokpi.functions import sum_value
from aerokpi.operators import explore, marts
from aerokpi.params import SEGMENT_ARROW, KpiParams
from aerokpi.sources.warehouse import Warehouse

_LEG_ORDER = "flight_date ASC NULLS LAST, flightnumber ASC NULLS LAST, origin ASC NULLS LAST, destination ASC NULLS LAST"
_FLIGHT = "flightnumber, flight_date"
_LEG = f"{_FLIGHT}, origin, destination"


def view_marts(w: Warehouse) -> dict[str, DataFrame]:
    """The marts that the views read."""
    leg, base = w.leg(), w.leg_base()
    return {
        "leg": leg, "leg_revpp": marts.leg_revpp(leg), "segment": marts.segment(leg), "leg_report": w.leg_report(),
        "leg_yield": marts.leg_yield_index(leg, w.params, lambda df: w.stable("leg_ranked", df)),
        "leg_ancillary": marts.leg_anc(base).select(*marts.LEG_KEYS, sum_value("anc_rev_u").alias("ancillary")),
        "segment_report": explore.segment_kpis(base).select("origin", "destination", "bookings", "cancels", "pax", "revenue", F.col("num").alias("ancillary")),
    }


def _ratio(num: str, den: str) -> str:
    return f"CAST({num} AS DOUBLE) / nullif(CAST({den} AS DOUBLE), 0D)"


def _money(x: str) -> str:
    return f"CAST({x} AS DECIMAL(24,8))"


def _published(x: str) -> str:
    """`explore.published` as text."""
    for digits in (explore.SNAP_DIGITS, explore.AVG_DIGITS):
        x = f"rint(({x}) * {10**digits}.0D) / {10**digits}.0D"
    return x


def kpi_sql(mart: str, params: KpiParams) -> dict[str, str]:
    """The text of each KPI view; ``mart`` is the marts' database."""
    pct, cost = repr(float(params.connection_value_pct)), repr(float(params.variable_cost_per_seat_leg))
    k = int(params.top_outliers)
    load, yields = f"{_LEG}, leg_lf, total_revenue", f"{_LEG}, rev_per_pax, leg_lf"
    return {
        "fwlf_overall": f"SELECT {_ratio('sum(pax)', 'sum(seats)')} AS fwlf FROM {mart}.leg",
        "fwlf_by_segment": f"SELECT origin, destination, {_ratio('sum(pax)', 'sum(seats)')} AS fwlf FROM {mart}.leg GROUP BY origin, destination",
        "calf_overall": f"SELECT {_ratio('sum(pax)', 'sum(seats)')} AS calf FROM {mart}.leg",
        "pacs_leg": f"""SELECT {_LEG}, seats, total_revenue, total_revenue * {pct}D AS connection_value,
            {_ratio(f'(total_revenue + total_revenue * {pct}D - seats * {cost}D)', 'seats')} AS pacs_per_seat_leg FROM {mart}.leg""",
        "leg_yield_index": f"SELECT * FROM {mart}.leg_yield",
        "yalf_overall": f"SELECT {_ratio('sum(pax * yield_index)', 'sum(seats)')} AS yalf FROM {mart}.leg_yield",
        "aras_overall": f"""SELECT {_ratio('sum(a.ancillary)', 'sum(l.seats)')} AS aras
            FROM (SELECT {_FLIGHT}, sum({_money('ancillary')}) AS ancillary FROM {mart}.leg_ancillary GROUP BY {_FLIGHT}) a
            JOIN {mart}.leg l USING ({_FLIGHT})""",
        "srm_proxy": f"""SELECT {_ratio('sum(pax)', "count(DISTINCT concat(flightnumber, '_', CAST(flight_date AS STRING)))")} AS passenger_legs_per_flight
            FROM {mart}.leg""",
        "lf_by_time": f"SELECT timeofday, {_published('avg(leg_lf)')} AS avg_lf FROM {mart}.leg GROUP BY timeofday",
        "anc_share_segment": f"""SELECT a.origin, a.destination, {_ratio(f"sum({_money('a.ancillary')} * CAST(f.legs AS DECIMAL(10,0)))", 'sum(f.revenue)')} AS anc_share
            FROM {mart}.leg_ancillary a
            JOIN (SELECT {_FLIGHT}, count(*) AS legs, sum({_money('total_revenue')}) AS revenue FROM {mart}.leg GROUP BY {_FLIGHT}) f USING ({_FLIGHT})
            GROUP BY a.origin, a.destination""",
        "cancel_rate_segment": f"""SELECT origin, destination,
            {_published(f"avg(CASE WHEN pax + cancels > 0 THEN {_ratio('cancels', '(pax + cancels)')} END)")} AS cancel_rate
            FROM {mart}.leg GROUP BY origin, destination""",
        "low_lf_legs": f"SELECT {load} FROM {mart}.leg ORDER BY leg_lf ASC NULLS LAST, {_LEG_ORDER} LIMIT {k}",
        "high_lf_legs": f"SELECT {load} FROM {mart}.leg ORDER BY leg_lf DESC NULLS LAST, {_LEG_ORDER} LIMIT {k}",
        "high_yield_legs": f"SELECT {yields} FROM {mart}.leg_revpp ORDER BY rev_per_pax DESC NULLS LAST, {_LEG_ORDER} LIMIT {k}",
        "low_yield_legs": f"SELECT {yields} FROM {mart}.leg_revpp WHERE rev_per_pax IS NOT NULL ORDER BY rev_per_pax ASC, {_LEG_ORDER} LIMIT {k}",
        "segment_kpis": f"""SELECT origin, destination, bookings, cancels, pax, revenue,
            CASE WHEN bookings > 0 THEN {_ratio('cancels', 'bookings')} END AS cancel_rate,
            CASE WHEN pax > 0 THEN {_ratio('revenue', 'pax')} END AS rev_per_pax, revenue AS denom, ancillary AS num,
            CASE WHEN revenue > 0 THEN {_ratio('ancillary', 'revenue')} END AS anc_share FROM {mart}.segment_report""",
        "lf_segment_dow_long": f"""SELECT origin, destination, dow, {_published('avg(load_factor)')} AS load_factor, concat(origin, '{SEGMENT_ARROW}', destination) AS segment
            FROM {mart}.leg_report WHERE dow IS NOT NULL GROUP BY origin, destination, dow""",
    }


def publish_views(spark: SparkSession, database: str, params: KpiParams) -> list[str]:
    """Create or replace the views of ``<database>_kpi`` over the tables of ``<database>_mart``.
    A table of a view's name, as earlier versions published, makes way for it."""
    names = []
    for name, text in kpi_sql(f"{database}_mart", params).items():
        view = f"{database}_kpi.{name}"
        if spark.catalog.tableExists(view) and spark.catalog.getTable(view).tableType != "VIEW":
            spark.sql(f"DROP TABLE {view}")
        spark.sql(f"CREATE OR REPLACE VIEW {view} AS {text}")
        names.append(view)
    return names
