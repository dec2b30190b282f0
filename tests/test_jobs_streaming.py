"""Sinks and the streaming row checks."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from conftest import SF0001, booking

from aerokpi.operators import dq
from aerokpi.params import DQ_CHECKS
from aerokpi.plans import jobs
from aerokpi.sources.warehouse import Warehouse
from aerokpi.streaming.row_checks import flag_bookings, start_row_checks, start_running_counts


@pytest.mark.skipif(not os.path.isdir(SF0001), reason="test data not present")
def test_dq_export_writes_every_check(spark, tmp_path):
    w = Warehouse.for_testdata(spark, SF0001)
    out = str(tmp_path / "dq")
    jobs.export_dq(w, out, "parquet")
    summary = {r["check"]: r["count"] for r in spark.read.parquet(f"{out}/dq_summary").collect()}
    assert set(summary) == set(DQ_CHECKS)
    for name in ("negative_passengers", "missing_capacity_for_leg", "same_booking_multiple_devices"):
        assert spark.read.parquet(f"{out}/{name}").count() == summary[name]


@pytest.mark.skipif(not os.path.isdir(SF0001), reason="test data not present")
def test_report_export_writes_insights(spark, tmp_path):
    w = Warehouse.for_testdata(spark, SF0001)
    out = str(tmp_path / "report")
    jobs.export_report(w, out, "csv")
    lines = [r.value for r in spark.read.text(f"{out}/insights").collect()]
    assert 1 <= len(lines) <= 12 and all(x.startswith("- ") for x in lines)
    assert spark.read.option("header", True).csv(f"{out}/tables/cancellation_by_dow").count() == 7


@pytest.mark.skipif(not os.path.isdir(SF0001), reason="test data not present")
def test_every_layer_has_named_relations(spark, tmp_path):
    w = Warehouse.for_testdata(spark, SF0001)
    names = jobs.publish_catalog(spark, w)
    assert {"raw_booking", "mart_leg", "mart_segment", "kpi_fwlf_by_segment", "kpi_yalf_overall", "kpi_anc_share_segment"} <= set(names)
    assert spark.sql("select count(*) as n from mart_leg").first().n == w.leg().count()
    assert all(spark.table(n).columns for n in names)
    jobs.export_report(w, str(tmp_path / "r"), "parquet")
    assert spark.read.parquet(str(tmp_path / "r/tables/booking_clean")).count() == w.booking().count()


def _rows(spark):
    return booking(spark, [
        dict(bookingid_pnr="PNR-1", passengercount=-1),
        dict(bookingid_pnr="PNR-2", flight_date=None, routing="XXX"),
        dict(bookingid_pnr="PNR-3"),
        dict(bookingid_pnr="PNR-4", cancellation_date=dt.date(2025, 1, 1)),
    ])


def test_flag_bookings_batch(spark):
    got = {r.bookingid_pnr: sorted(r.failed_checks) for r in flag_bookings(_rows(spark)).collect()}
    assert got["PNR-1"] == ["negative_passengers"]
    assert got["PNR-2"] == ["missing_flight_date", "routing_inconsistent_with_od"]
    assert "PNR-3" not in got
    assert sorted(got["PNR-4"]) == ["cancellation_before_reservation", "cancellation_with_positive_pax"]
    # same answer as the batch checks
    assert dq.booking_check(_rows(spark), "negative_passengers").count() == 1


def test_streaming_row_checks(spark, tmp_path):
    src = str(tmp_path / "in")
    _rows(spark).write.parquet(src)
    q = start_row_checks(spark, src, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.bookingid_pnr for r in out.collect()) == ["PNR-1", "PNR-2", "PNR-4"]
    q2 = start_running_counts(spark, src, str(tmp_path / "ckpt2"), "aerokpi_dq_counts")
    q2.awaitTermination(120)
    counts = {r["check"]: r["count"] for r in spark.table("aerokpi_dq_counts").collect()}
    assert counts["negative_passengers"] == 1 and counts["missing_flight_date"] == 1


@pytest.mark.skipif(not os.path.isdir(SF0001), reason="test data not present")
def test_kpi_export_and_ingest(spark, tmp_path):
    w = Warehouse.for_testdata(spark, SF0001)
    out = str(tmp_path)
    jobs.export_kpis(w, f"{out}/kpis", "csv")
    jobs.ingest(w, out, "parquet")
    read = lambda p: spark.read.option("header", True).csv(p)
    assert float(read(f"{out}/kpis/fwlf_overall").first().fwlf) == pytest.approx(0.14494495466885476, rel=1e-12)
    assert read(f"{out}/kpis/fwlf_by_segment").count() == 25
    detail = read(f"{out}/kpis/leg_detail")
    assert detail.count() == 5584 and {"q5", "yield_index", "rev_per_pax"} <= set(detail.columns)
    assert spark.read.parquet(f"{out}/raw/booking").count() == 6000
    assert spark.read.parquet(f"{out}/raw/flight").count() == 5439
