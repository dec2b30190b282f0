"""Scalar functions and lenient parsing (micro-fixtures)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from aerokpi.functions import booking_id_norm, channel_norm, routing_key, weekday_name, whole_days
from aerokpi.sources.readers import read_entity
from aerokpi.sources.schema import normalize_name


def _col(spark, values, typ="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {typ}")


def test_booking_ids(spark):
    out = _col(spark, ["PNR-00 12", "abc", None, " 123 "]).select(booking_id_norm("x").alias("y")).collect()
    assert [r.y for r in out] == ["0012", None, None, "123"]


def test_channel_synonyms(spark):
    vals = [" Condor-App ", "OTA", "online travel agency", "Mobile App", None, " Web ", "App"]
    out = _col(spark, vals).select(channel_norm("x").alias("y")).collect()
    assert [r.y for r in out] == ["condor app", "ota", "ota", "mobile app", None, "website", "condor app"]


def test_day_floor_on_timestamps(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2025, 1, 2, 0, 0), dt.datetime(2025, 1, 4, 12, 0))], "c timestamp_ntz, r timestamp_ntz"
    )
    assert df.select(whole_days("c", "r").alias("d")).first().d == -3


def test_day_difference_on_dates(spark):
    df = spark.createDataFrame([(dt.date(2025, 3, 10), dt.date(2025, 3, 1))], "a date, b date")
    assert df.select(whole_days("a", "b").alias("d")).first().d == 9


def test_weekday_name(spark):
    days = [dt.date(2025, 3, 1) + dt.timedelta(days=i) for i in range(7)]
    df = spark.createDataFrame([(d,) for d in days] + [(None,)], "d date")
    got = [r.w for r in df.select(weekday_name("d").alias("w")).collect()]
    assert got == [d.strftime("%A") for d in days] + [None]


def test_routing_key_removes_all_blanks(spark):
    out = _col(spark, ["fra - fco", "MIDDLE EAST→ASIA"]).select(routing_key("x").alias("y")).collect()
    assert [r.y for r in out] == ["FRA-FCO", "MIDDLEEAST→ASIA"]


def test_normalize_name():
    assert normalize_name(" Revenue per Booking (Ticket) ") == "revenue_per_booking_ticket"
    assert normalize_name("BookingID (PNR)") == "bookingid_pnr"
    assert normalize_name("Flight Date") == "flight_date"


def test_bad_values_become_null(spark, tmp_path):
    p = tmp_path / "booking.csv"
    p.write_text(
        "BookingID (PNR),Reservation Date,Flight Date,Revenue per Booking (Ticket),PassengerCount,FlightNumber\n"
        "PNR-1,zz,2025-03-01,x,2,XY1\n"
        "PNR-2,2025-02-01 10:30:00,2025-03-02,12.5,y,XY1\n"
    )
    rows = read_entity(spark, str(p), "booking", fmt="csv").orderBy("bookingid_pnr").collect()
    assert rows[0].reservation_date is None
    assert rows[0].revenue_per_booking_ticket is None
    assert rows[0].passengercount == 2
    assert rows[1].revenue_per_booking_ticket == 12.5
    assert rows[1].passengercount is None
    assert rows[1].reservation_date == dt.datetime(2025, 2, 1, 10, 30)
    # absent optional columns are typed nulls
    assert rows[0].routing is None and rows[0].cancellation_date is None
    assert F is not None
