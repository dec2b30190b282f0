"""End to end over exported sheets (CSV with display headers)."""

from __future__ import annotations

import pytest

from aerokpi.plans.registry import DATASETS
from aerokpi.sources.warehouse import Warehouse

BOOKING = """BookingID (PNR),Reservation Date,Cancellation Date,Flight Date,Origin,Destination,Routing,FlightNumber,Revenue per Booking (Ticket),Revenue per Booking (Ancilliary pre Check in),Revenue per Booking (Ancilliary at Check in),PassengerCount
PNR-001,2025-02-20 10:00:00,,2025-03-03 07:00:00,FRA,FCO,FRA-FCO,XY100,100.10,10.20,,2
PNR-002,2025-02-21 09:00:00,2025-02-27 12:00:00,2025-03-03 07:00:00,fra ,FCO,FRA→FCO,XY100,50.00,5.00,5.00,1
PNR-003,2025-02-22 08:00:00,,2025-03-04 07:00:00,FCO,FRA,FCO - FRA,XY101,80.00,8.00,1.00,3
PNR-004,bad date,,,FCO,PMO,FCO-PMO,XY102,x,0,0,
"""
PASSENGER = """BookingID,Booking Channel,Device Used
PNR 001,,Mobile
PNR 001, Web ,desktop
PNR 002,online travel agency,
PNR 003,App,Mobile
"""
FLIGHT = """FlightNumber,FlightDate,AvailableCapacity,TimeOfDay,RouteType
XY100,2025-03-03 00:00:00,180,Morning,Outbound
XY101,2025-03-04 00:00:00,170,Evening,Inbound
"""


@pytest.fixture(scope="module")
def wh(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sheets")
    paths = {}
    for name, text in (("booking", BOOKING), ("passenger", PASSENGER), ("flight", FLIGHT)):
        p = d / f"{name}.csv"
        p.write_text(text, encoding="utf-8")
        paths[name] = str(p)
    return Warehouse.from_sheets(spark, paths["booking"], paths["passenger"], paths["flight"], "csv")


def test_sql_leg_truncates_dates_and_propagates_null_parts(wh):
    legs = {(r.flightnumber, r.origin): r for r in DATASETS["leg"](wh).collect()}
    fra = legs[("XY100", "FRA")]
    assert str(fra.flight_date) == "2025-03-03"
    assert fra.total_revenue is None          # its only booking has a null part
    assert fra.seats == 180                   # both sides truncated to DATE before joining
    raw = legs[("XY100", "fra ")]             # raw codes are not canonicalised in the SQL mart
    assert raw.total_revenue == 60.0 and raw.pax == 1


def test_report_leg_canonical_codes_and_zero_filled_revenue(wh):
    rows = {(r.flightnumber, r.origin): r for r in DATASETS["leg_report"](wh).collect()}
    r = rows[("XY100", "FRA")]
    assert r.pax == 3 and r.revenue == pytest.approx(100.10 + 10.20 + 60.0)
    assert r.cancels == 1 and r.dow == "Monday"
    # the report convention keeps full timestamps: 07:00 does not meet 00:00
    assert r.availablecapacity is None and r.load_factor is None


def test_dq_and_channels(wh):
    summary = {x["check"]: x["count"] for x in DATASETS["dq_summary"](wh).collect()}
    assert summary["missing_flight_date"] == 1
    assert summary["routing_inconsistent_with_od"] == 0
    assert summary["same_booking_multiple_channels"] == 2   # PNR 001: null and " Web "
    ch = {x.bookingid_norm: x.primary_channel for x in DATASETS["pnr_channel"](wh).collect()}
    assert ch == {"001": "website", "002": "ota", "003": "condor app"}


def test_day_differences_floor_timestamps(wh):
    b = {x.bookingid_pnr: x for x in DATASETS["booking_clean"](wh).collect()}
    assert b["PNR-002"].days_after_booking_to_cancel == 6      # 6 days 3 hours
    assert b["PNR-002"].days_before_flight_to_cancel == 3      # 3 days 19 hours
    assert b["PNR-004"].reservation_date is None and b["PNR-004"].revenue_per_booking_ticket is None


def test_every_dataset_runs_on_sheets(wh):
    for name, fn in DATASETS.items():
        fn(wh).collect()
