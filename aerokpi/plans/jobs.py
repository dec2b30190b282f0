"""Batch jobs: publish entities, export KPI / data-quality / report datasets.

Every export is a distributed write of a lazily built DataFrame (one
action per dataset); nothing is collected to the driver. Large outputs
(leg detail, offender rows) are written as partitioned directories; the
handful-of-rows tables are coalesced to one file for readability.

CLI:
    python -m aerokpi.plans.jobs {ingest,catalog,kpis,dq,report,all} --sf-dir DIR --out DIR [--format csv|parquet] [--params FILE]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerokpi.operators import clean, dq, explore, kpis, marts, weekday
from aerokpi.operators.insights import insights
from aerokpi.params import DQ_CHECKS, TESTDATA
from aerokpi.plans.registry import DATASETS
from aerokpi.plans.views import publish_views, view_marts
from aerokpi.sources.parameters import read_params
from aerokpi.sources.publish import publish_folder, publish_table
from aerokpi.sources.readers import write_table
from aerokpi.sources.warehouse import Warehouse

def _write(df: DataFrame, path: str, fmt: str, small: bool = False) -> None:
    write_table(df.coalesce(1) if small else df, path, fmt)


def ingest(w: Warehouse, out: str, fmt: str = "parquet") -> None:
    """SNK-1: publish the three typed entities (replace)."""
    for name in ("booking", "passenger", "flight"):
        _write(getattr(w, name)(), f"{out}/raw/{name}", fmt)


def relations(w: Warehouse) -> dict[str, dict[str, DataFrame]]:
    """Every named relation by layer: raw entities, marts, KPI and exploration views."""
    kpi = ("fwlf_overall", "fwlf_by_segment", "pacs_leg", "leg_yield_index", "yalf_overall", "aras_overall", "srm_proxy", "calf_overall",
           "lf_by_time", "anc_share_segment", "cancel_rate_segment", "low_lf_legs", "high_lf_legs", "high_yield_legs", "low_yield_legs",
           "segment_kpis", "lf_segment_dow_long")
    return {"raw": {n: getattr(w, n)() for n in ("booking", "passenger", "flight")}, "mart": view_marts(w),
            "kpi": {n: DATASETS[n](w) for n in kpi}}


def publish_catalog(spark: SparkSession, w: Warehouse, database: str | None = None) -> list[str]:
    """SNK-2 / SNK-3: namespaces and named relations.

    Every relation becomes a temp view ``<layer>_<name>`` (lazy). With ``database`` set (a
    configured catalog), the layers are databases ``<database>_raw``, ``_mart`` and ``_kpi``: raw
    entities and marts are published as tables (`publish_table`), KPIs as persistent views over
    the marts (`views.publish_views`). Returns the names of the temp views."""
    names = []
    for layer, tables in relations(w).items():
        if database:
            spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}_{layer}")
        for name, df in tables.items():
            df.createOrReplaceTempView(f"{layer}_{name}")
            names.append(f"{layer}_{name}")
            if database and layer != "kpi":
                publish_table(df, f"{database}_{layer}.{name}")
    if database:
        publish_views(spark, database, w.params)
    return names


def export_kpis(w: Warehouse, out: str, fmt: str = "csv") -> None:
    """SNK-4: the six KPI datasets."""
    p = w.params
    leg = w.leg()
    _write(kpis.fwlf_overall(leg), f"{out}/fwlf_overall", fmt, small=True)
    _write(kpis.fwlf_by_segment(leg), f"{out}/fwlf_by_segment", fmt)
    _write(kpis.pacs_leg(leg, p), f"{out}/pacs_leg", fmt)
    stable = lambda df: w.stable("leg_ranked", df)
    _write(kpis.yalf_overall(leg, p, stable), f"{out}/yalf_overall", fmt, small=True)
    _write(kpis.aras_overall(w.leg_base(), leg), f"{out}/aras_overall", fmt, small=True)
    _write(marts.leg_yield_index(leg, p, stable), f"{out}/leg_detail", fmt)


def export_dq(w: Warehouse, out: str, fmt: str = "csv") -> None:
    """SNK-5: the summary, one offender dataset per check, and all offenders in long form
    (``offenders``, Parquet, a partition per check)."""
    dq_leg = marts.dq_leg(w.leg_base(), w.flight())
    duplicates = w.stable("duplicate_keys", dq.duplicate_keys(w.booking()))
    publish_folder(dq.offenders(w.booking(), duplicates, w.passenger(), dq_leg, w.params), f"{out}/offenders", "parquet", ("check",))
    _write(dq.dq_summary(w.booking(), w.passenger(), dq_leg, w.params, duplicates), f"{out}/dq_summary", fmt, small=True)
    for name in DQ_CHECKS:
        if name in dq.BOOKING_CHECKS:
            df = dq.booking_check(w.booking(), name)
        elif name in dq.PASSENGER_CHECKS:
            df = dq.passenger_check(w.passenger(), name)
        elif name in dq.LEG_CHECKS:
            df = dq.leg_check(dq_leg, name, w.params)
        else:
            df = dq.duplicate_legs_within_pnr(w.booking(), lambda _: duplicates)
        _write(df, f"{out}/{name}", fmt)


def export_report(w: Warehouse, out: str, fmt: str = "csv") -> None:
    """SNK-6 / SNK-7: report tables, the weekday KPI table and the insight text."""
    s, p = w.spark, w.params
    lr, base, b = w.leg_report(), w.leg_base(), w.booking()
    wide = explore.lf_segment_dow_wide(lr, p.wide_segments)
    small = {
        "cancellation_by_dow": explore.cancellation_by_dow(s, base),
        "cancellation_days_after_booking": explore.cancel_days_hist(b, "days_after_booking_to_cancel"),
        "cancellation_days_before_flight": explore.cancel_days_hist(b, "days_before_flight_to_cancel"),
        "cancellation_by_channel": explore.cancellation_by_channel(b, w.passenger(), p).orderBy(F.col("bookings").desc()),
        "lf_by_dow": explore.lf_by_dow(s, lr),
        "lf_by_time_of_day": explore.lf_by_time_of_day(lr),
        "lf_by_segment_by_dow_long": explore.lf_segment_dow_long(lr),
        "lf_by_segment_by_dow_wide": wide if p.wide_segments is not None or fmt != "csv" else wide.withColumn("load_factors", F.to_json("load_factors")),
        "segment_kpis": explore.segment_kpis(base).orderBy(F.col("revenue").desc()),
        "directional_imbalance": explore.directional_imbalance(lr).orderBy(F.col("lf_diff_vs_reverse").desc()),
        "rev_lf_correlation": explore.rev_lf_correlation(lr, p),
        "kpi_summary_by_dow": weekday.kpi_summary_by_dow(s, lr, base, p),
    }
    bounded = {"cancellation_by_dow", "lf_by_dow", "lf_by_time_of_day", "lf_by_segment_by_dow_wide", "rev_lf_correlation", "kpi_summary_by_dow"}
    for name, df in small.items():  # one file only where the number of rows is fixed
        _write(df, f"{out}/tables/{name}", fmt, small=name in bounded)
    _write(lr, f"{out}/tables/leg_table", fmt)
    _write(clean.booking_clean(b), f"{out}/tables/booking_clean", fmt)
    lines = insights(s, b, w.passenger(), base, lr, p).select(F.concat(F.lit("- "), "text").alias("value"))
    publish_folder(lines.coalesce(1), f"{out}/insights", "text")  # <= 12 rows


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="aerokpi.plans.jobs")
    ap.add_argument("job", choices=["ingest", "catalog", "kpis", "dq", "report", "all"])
    ap.add_argument("--sf-dir", help="test-data directory (TPC-style tables through the adapter)")
    ap.add_argument("--booking", help="Booking sheet (CSV with header or Parquet)")
    ap.add_argument("--passenger", help="Passenger sheet")
    ap.add_argument("--flight", help="Flight sheet")
    ap.add_argument("--input-format", default="csv", choices=["csv", "parquet"])
    ap.add_argument("--out", required=True)
    ap.add_argument("--database", help="prefix of the raw, mart and kpi databases of a configured catalog")
    ap.add_argument("--format", default="csv", choices=["csv", "parquet"])
    ap.add_argument("--params", help="JSON or YAML file of KPI parameters that replace the defaults")
    a = ap.parse_args(argv)
    spark = SparkSession.builder.appName(f"aerokpi-{a.job}").getOrCreate()
    if a.booking:
        params = read_params(spark, a.params) if a.params else None
        w = Warehouse.from_sheets(spark, a.booking, a.passenger, a.flight, a.input_format, params)
    elif a.sf_dir:
        w = Warehouse.for_testdata(spark, a.sf_dir)
        if a.params:
            w = w.with_params(read_params(spark, a.params, TESTDATA))
    else:
        ap.error("give --sf-dir or --booking/--passenger/--flight")
    if a.job in ("ingest", "all"):
        ingest(w, a.out, "parquet")
    if a.job in ("catalog", "all"):
        publish_catalog(spark, w, a.database)
    if a.job in ("kpis", "all"):
        export_kpis(w, f"{a.out}/kpis", a.format)
    if a.job in ("dq", "all"):
        export_dq(w, f"{a.out}/dq", a.format)
    if a.job in ("report", "all"):
        export_report(w, f"{a.out}/report", a.format)


if __name__ == "__main__":
    main()
