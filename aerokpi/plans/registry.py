"""Query registry: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the test tables through the warehouse (adapter output
and leg marts written once per session) and composes the pure operators
of ``aerokpi.operators``. Nothing is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from aerokpi.functions import booking_id_norm, segment_label
from aerokpi.operators import clean, dq, explore, kpis, marts, weekday
from aerokpi.params import DQ_CHECKS
from aerokpi.sources.warehouse import Warehouse

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
# the same datasets over any warehouse (test data, exported sheets, ...)
DATASETS: dict[str, Callable[[Warehouse], DataFrame]] = {}


# averages that are published rounded; the operators return them in full
ROUNDED = {
    "lf_by_time": ["avg_lf"], "lf_by_time_ordered": ["avg_lf"], "cancel_rate_segment": ["cancel_rate"],
    "lf_by_dow": ["avg_load_factor"], "lf_by_time_of_day": ["avg_load_factor"], "lf_segment_dow_long": ["load_factor"],
    "directional_imbalance": ["load_factor", "load_factor_rev", "lf_diff_vs_reverse"], "rev_lf_correlation": ["rev_lf_corr"],
    "cancel_timing_stats": list(explore.TIMING_STATS), "last_minute_share": ["last_minute_share"],
    "network_avg_ancillary_share": ["network_avg_ancillary_share"], "calf_realized_by_dow": ["calf"],
    "pacs_feeder_by_dow": ["pacs"], "kpi_summary_by_dow": ["pacs_per_seat", "calf"], "fwlf_calf_by_dow": ["calf"],
    "insights": ["value", "value2"],
}


def as_published(name: str, df: DataFrame) -> DataFrame:
    if "load_factors" in df.columns:
        return df.withColumn("load_factors", F.transform_values("load_factors", lambda _, x: explore.published(x)))
    cols = [c for c in df.columns if c != "dow"] if name == "lf_segment_dow_wide" else ROUNDED.get(name, [])
    return df.select(*[explore.published(F.col(f"`{c}`")).alias(c) if c in cols else F.col(f"`{c}`") for c in df.columns]) if cols else df


def query(name: str):
    def deco(fn: Callable[[Warehouse], DataFrame]):
        def dataset(w: Warehouse) -> DataFrame:
            return as_published(name, fn(w))

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return dataset(Warehouse.for_testdata(spark, sf_dir))

        run.__name__ = dataset.__name__ = name
        run.__doc__ = dataset.__doc__ = fn.__doc__
        QUERIES[name] = run
        DATASETS[name] = dataset
        return fn

    return deco


# ---- sources / cleaning -------------------------------------------------------
@query("src_booking")
def _src_booking(w: Warehouse) -> DataFrame:
    """SRC-1: the typed booking entity."""
    return w.booking()


@query("src_passenger")
def _src_passenger(w: Warehouse) -> DataFrame:
    return w.passenger()


@query("src_flight")
def _src_flight(w: Warehouse) -> DataFrame:
    return w.flight()


@query("normalize_columns")
def _normalize_columns(w: Warehouse) -> DataFrame:
    """PRJ-1: the booking sheet with its display headers normalised."""
    if w.sf_dir is None:  # a warehouse over exported sheets: its typed entity
        return w.booking()
    return w.booking_sheet()


@query("booking_id_norm")
def _booking_id_norm(w: Warehouse) -> DataFrame:
    return w.booking().select("bookingid_pnr", booking_id_norm("bookingid_pnr").alias("bookingid_norm"))


@query("segment_label")
def _segment_label(w: Warehouse) -> DataFrame:
    return marts.segment(w.leg()).withColumn("segment", segment_label())


@query("booking_clean")
def _booking_clean(w: Warehouse) -> DataFrame:
    return clean.booking_clean(w.booking())


@query("passenger_clean")
def _passenger_clean(w: Warehouse) -> DataFrame:
    return clean.passenger_clean(w.passenger(), w.params)


@query("pnr_channel")
def _pnr_channel(w: Warehouse) -> DataFrame:
    return clean.pnr_channel(w.passenger(), w.params)


@query("pnr_devices")
def _pnr_devices(w: Warehouse) -> DataFrame:
    return clean.pnr_devices(w.passenger(), w.params)


@query("booking_enriched")
def _booking_enriched(w: Warehouse) -> DataFrame:
    return clean.booking_enriched(w.booking(), w.passenger(), w.params)


# ---- marts ----------------------------------------------------------------------
@query("leg")
def _leg(w: Warehouse) -> DataFrame:
    return w.leg()


@query("leg_revpp")
def _leg_revpp(w: Warehouse) -> DataFrame:
    return marts.leg_revpp(w.leg())


@query("leg_yield_index")
def _leg_yield_index(w: Warehouse) -> DataFrame:
    return marts.leg_yield_index(w.leg(), w.params, lambda df: w.stable("leg_ranked", df))


@query("leg_report")
def _leg_report(w: Warehouse) -> DataFrame:
    return w.leg_report()


@query("segment")
def _segment(w: Warehouse) -> DataFrame:
    return marts.segment(w.leg())


# ---- core KPIs ------------------------------------------------------------------
@query("fwlf_overall")
def _fwlf_overall(w: Warehouse) -> DataFrame:
    return kpis.fwlf_overall(w.leg())


@query("fwlf_by_segment")
def _fwlf_by_segment(w: Warehouse) -> DataFrame:
    return kpis.fwlf_by_segment(w.leg())


@query("pacs_leg")
def _pacs_leg(w: Warehouse) -> DataFrame:
    return kpis.pacs_leg(w.leg(), w.params)


@query("pacs_top5")
def _pacs_top5(w: Warehouse) -> DataFrame:
    return kpis.pacs_top(w.leg(), w.params.top_pacs_print, w.params)


@query("pacs_top20")
def _pacs_top20(w: Warehouse) -> DataFrame:
    return kpis.pacs_chart(w.leg(), w.params.top_pacs_chart, w.params, descending=True)


@query("pacs_bottom20")
def _pacs_bottom20(w: Warehouse) -> DataFrame:
    return kpis.pacs_chart(w.leg(), w.params.top_pacs_chart, w.params, descending=False)


@query("yalf_overall")
def _yalf_overall(w: Warehouse) -> DataFrame:
    return kpis.yalf_overall(w.leg(), w.params, lambda df: w.stable("leg_ranked", df))


@query("aras_overall")
def _aras_overall(w: Warehouse) -> DataFrame:
    return kpis.aras_overall(w.leg_base(), w.leg())


@query("srm_proxy")
def _srm_proxy(w: Warehouse) -> DataFrame:
    return kpis.srm_proxy(w.leg())


@query("calf_overall")
def _calf_overall(w: Warehouse) -> DataFrame:
    return kpis.calf_overall(w.leg())


@query("mart_checks")
def _mart_checks(w: Warehouse) -> DataFrame:
    return kpis.mart_checks(w.leg(), w.params)


# ---- weekday KPIs ---------------------------------------------------------------
@query("fwlf_by_dow")
def _fwlf_by_dow(w: Warehouse) -> DataFrame:
    return weekday.fwlf_by_dow(w.spark, w.leg_report())


@query("calf_realized_by_dow")
def _calf_realized_by_dow(w: Warehouse) -> DataFrame:
    return weekday.calf_realized_by_dow(w.spark, w.leg_report(), w.leg_base())


@query("pacs_feeder_by_dow")
def _pacs_feeder_by_dow(w: Warehouse) -> DataFrame:
    return weekday.pacs_feeder_by_dow(w.spark, w.leg_report(), w.params)


@query("kpi_summary_by_dow")
def _kpi_summary_by_dow(w: Warehouse) -> DataFrame:
    return weekday.kpi_summary_by_dow(w.spark, w.leg_report(), w.leg_base(), w.params)


@query("fwlf_calf_by_dow")
def _fwlf_calf_by_dow(w: Warehouse) -> DataFrame:
    return weekday.fwlf_calf_by_dow(w.spark, w.leg_report(), w.leg_base())


@query("ancillary_share_top10")
def _ancillary_share_top10(w: Warehouse) -> DataFrame:
    return explore.ancillary_share_top(w.leg_base(), w.params.top_segments_aras)


@query("network_avg_ancillary_share")
def _network_avg_ancillary_share(w: Warehouse) -> DataFrame:
    return explore.network_avg_ancillary_share(w.leg_base())


# ---- exploration (SQL convention) -------------------------------------------------
@query("lf_by_time")
def _lf_by_time(w: Warehouse) -> DataFrame:
    return explore.lf_by_time(w.leg())


@query("lf_by_time_ordered")
def _lf_by_time_ordered(w: Warehouse) -> DataFrame:
    return explore.lf_by_time_ordered(w.spark, w.leg())


@query("anc_share_segment")
def _anc_share_segment(w: Warehouse) -> DataFrame:
    return explore.anc_share_segment(w.leg_base(), w.leg())


@query("cancel_rate_segment")
def _cancel_rate_segment(w: Warehouse) -> DataFrame:
    return explore.cancel_rate_segment(w.leg())


@query("low_lf_legs")
def _low_lf_legs(w: Warehouse) -> DataFrame:
    return explore.lf_outliers(w.leg(), w.params.top_outliers, lowest=True)


@query("high_lf_legs")
def _high_lf_legs(w: Warehouse) -> DataFrame:
    return explore.lf_outliers(w.leg(), w.params.top_outliers, lowest=False)


@query("high_yield_legs")
def _high_yield_legs(w: Warehouse) -> DataFrame:
    return explore.yield_outliers(w.leg(), w.params.top_outliers, lowest=False)


@query("low_yield_legs")
def _low_yield_legs(w: Warehouse) -> DataFrame:
    return explore.yield_outliers(w.leg(), w.params.top_outliers, lowest=True)


@query("scatter_lf_revpp")
def _scatter_lf_revpp(w: Warehouse) -> DataFrame:
    return explore.scatter_lf_revpp(w.leg())


# ---- exploration (report convention) ----------------------------------------------
@query("cancellation_by_dow")
def _cancellation_by_dow(w: Warehouse) -> DataFrame:
    return explore.cancellation_by_dow(w.spark, w.leg_base())


@query("cancel_days_after_booking")
def _cancel_days_after_booking(w: Warehouse) -> DataFrame:
    return explore.cancel_days_hist(w.booking(), "days_after_booking_to_cancel")


@query("cancel_days_before_flight")
def _cancel_days_before_flight(w: Warehouse) -> DataFrame:
    return explore.cancel_days_hist(w.booking(), "days_before_flight_to_cancel")


@query("cancellation_by_channel")
def _cancellation_by_channel(w: Warehouse) -> DataFrame:
    return explore.cancellation_by_channel(w.booking(), w.passenger(), w.params)


@query("lf_by_dow")
def _lf_by_dow(w: Warehouse) -> DataFrame:
    return explore.lf_by_dow(w.spark, w.leg_report())


@query("lf_by_time_of_day")
def _lf_by_time_of_day(w: Warehouse) -> DataFrame:
    return explore.lf_by_time_of_day(w.leg_report())


@query("lf_segment_dow_long")
def _lf_segment_dow_long(w: Warehouse) -> DataFrame:
    return explore.lf_segment_dow_long(w.leg_report())


@query("lf_segment_dow_wide")
def _lf_segment_dow_wide(w: Warehouse) -> DataFrame:
    return explore.lf_segment_dow_wide(w.leg_report(), w.params.wide_segments)


@query("segment_kpis")
def _segment_kpis(w: Warehouse) -> DataFrame:
    return explore.segment_kpis(w.leg_base())


@query("directional_imbalance")
def _directional_imbalance(w: Warehouse) -> DataFrame:
    return explore.directional_imbalance(w.leg_report())


@query("rev_lf_correlation")
def _rev_lf_correlation(w: Warehouse) -> DataFrame:
    return explore.rev_lf_correlation(w.leg_report(), w.params)


@query("cancel_timing_stats")
def _cancel_timing_stats(w: Warehouse) -> DataFrame:
    return explore.cancel_timing_stats(w.booking(), w.params)


@query("last_minute_share")
def _last_minute_share(w: Warehouse) -> DataFrame:
    return explore.last_minute_share(w.booking(), w.params)


@query("anc_share_top_segments")
def _anc_share_top_segments(w: Warehouse) -> DataFrame:
    return explore.anc_share_top_segments(w.leg_base(), w.params.top_segments_chart)


# ---- data quality -----------------------------------------------------------------
def _dq_leg(w: Warehouse) -> DataFrame:
    return marts.dq_leg(w.leg_base(), w.flight())


def _register_dq(name: str) -> None:
    if name in dq.BOOKING_CHECKS:
        fn = lambda w: dq.booking_check(w.booking(), name)
    elif name in dq.PASSENGER_CHECKS:
        fn = lambda w: dq.passenger_check(w.passenger(), name)
    elif name in dq.LEG_CHECKS:
        fn = lambda w: dq.leg_check(_dq_leg(w), name, w.params)
    else:
        fn = lambda w: dq.duplicate_legs_within_pnr(w.booking(), lambda d: w.stable("duplicate_keys", d))
    fn.__doc__ = f"DQ check {name}: offending rows."
    query(f"dq_{name}")(fn)


for _n in DQ_CHECKS:
    _register_dq(_n)


@query("dq_summary")
def _dq_summary(w: Warehouse) -> DataFrame:
    return dq.dq_summary(w.booking(), w.passenger(), _dq_leg(w), w.params, w.stable("duplicate_keys", dq.duplicate_keys(w.booking())))


# ---- insights -----------------------------------------------------------------------
@query("insights")
def _insights(w: Warehouse) -> DataFrame:
    from aerokpi.operators.insights import insights

    return insights(w.spark, w.booking(), w.passenger(), w.leg_base(), w.leg_report(), w.params)
