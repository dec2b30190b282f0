"""No value is cut, clamped or dropped on the way from the sheet to the published table."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from aerokpi.operators import clean, dq, explore
from aerokpi.operators.insights import insights
from aerokpi.params import TESTDATA
from aerokpi.plans.registry import DATASETS
from aerokpi.sources.readers import read_entity
from aerokpi.sources.schema import conform, unparsed_cells
from aerokpi.sources.warehouse import Warehouse, checkpoint_root
from conftest import booking, flight, passenger, warehouse


@pytest.mark.parametrize("x", [0.1234565, 2e9, 1e12, -1e12, 123456789012345.0])
def test_published_rounding_never_clamps(spark, x):
    got = spark.range(1).select(explore.published(F.lit(x)).alias("x")).first().x
    assert got == pytest.approx(x, rel=1e-12, abs=1e-6)


def test_large_averages_survive(spark):
    from aerokpi.operators.weekday import pacs_feeder_by_dow

    legs = spark.createDataFrame(
        [("Monday", "A", "B", 2e12, 10), ("Monday", "A", "B", 4e12, 10)], "dow string, origin string, destination string, revenue double, availablecapacity int")
    out = {r.dow: r.pacs for r in pacs_feeder_by_dow(spark, legs, TESTDATA).collect()}
    assert out["Monday"] == pytest.approx(3e11, rel=1e-6)


def test_ingest_is_total(spark):
    nan, inf = float("nan"), float("inf")
    raw = spark.createDataFrame(
        [("P1", nan, "NaN", "03/01/2025"), ("P2", inf, "2.9", "1 Mar 2025"), ("P3", -inf, "2.0", "2025-03-01"), ("P4", 1.5, "x", "20250301"),
         ("P5", 2.5, "", "25/03/2025"), ("P6", 3.5, "7", "someday")],
        "bookingid_pnr string, revenue_per_booking_ticket double, passengercount string, flight_date string")
    out = {r.bookingid_pnr: r for r in conform(raw, "booking").collect()}
    assert [out[f"P{i}"].revenue_per_booking_ticket for i in range(1, 7)] == [None, None, None, 1.5, 2.5, 3.5]
    assert [out[f"P{i}"].passengercount for i in range(1, 7)] == [None, None, 2, None, None, 7]
    march = dt.datetime(2025, 3, 1)
    assert [out[f"P{i}"].flight_date for i in range(1, 7)] == [march, march, march, march, dt.datetime(2025, 3, 25), None]
    lost = {r.column: r.unparsed for r in unparsed_cells(raw, "booking").collect()}
    assert lost == {"bookingid_pnr": 0, "revenue_per_booking_ticket": 3, "passengercount": 3, "flight_date": 1}


def test_a_sheet_with_nan_feeds_every_leg_dataset(spark):
    b = booking(spark, [{"bookingid_pnr": "P1"}, {"bookingid_pnr": "P2", "revenue_per_booking_ticket": float("nan"), "passengercount": 3}])
    w = warehouse(spark, conform(b, "booking"))
    assert DATASETS["leg_report"](w).first().revenue == pytest.approx(120.0)
    assert DATASETS["leg"](w).first().total_revenue == pytest.approx(110.0)


def test_first_channel_follows_file_order(spark, tmp_path):
    folder = tmp_path / "passengers"
    folder.mkdir()
    (folder / "part-0.csv").write_text("BookingID,Booking Channel,Device Used\nPNR 1,Web,Mobile\n")
    rows = "".join(f"PNR {i},OTA,Desktop and a longer text\n" for i in [1, *range(2, 4000)])
    (folder / "part-1.csv").write_text("BookingID,Booking Channel,Device Used\n" + rows)
    p = read_entity(spark, str(folder), "passenger", "csv")
    first = {r.bookingid_norm: r.primary_channel for r in clean.pnr_channel(p, TESTDATA).collect()}
    assert first["1"] == "website" and first["2"] == "ota"


def test_ancillary_share_without_pairs(spark):
    n = 1000
    b = booking(spark, [{"bookingid_pnr": f"P{i}", "origin": f"O{i:04d}", "destination": "X"} for i in range(n)])
    w = warehouse(spark, b)
    out = DATASETS["anc_share_segment"](w)
    rows = out.collect()
    assert len(rows) == n
    # ancillary 10 of each O&D meets the revenue 110 of all n legs of the flight, n times
    assert all(r.anc_share == pytest.approx(10.0 * n / (110.0 * n)) for r in rows)
    joined = w.leg_base().groupBy("flightnumber", "flight_date").count()
    assert joined.count() == 1


def test_one_way_network_has_no_imbalance_line(spark):
    w = warehouse(spark, booking(spark, [{}, {"bookingid_pnr": "P2"}]))
    lines = insights(spark, w.booking(), w.passenger(), w.leg_base(), w.leg_report(), w.params).collect()
    assert "I" not in {r.rule for r in lines}
    assert not any("n%" in r.text or "NaN" in r.text for r in lines)


def test_several_values_count_null_as_one(spark):
    p = passenger(spark, [dict(bookingid="1", ordinal=i, booking_channel=c, device_used=d) for i, (c, d) in enumerate([("Web", None), ("Web", None)])]
                  + [dict(bookingid="2", ordinal=5, booking_channel=None, device_used="a"), dict(bookingid="2", ordinal=6, booking_channel="x", device_used="b")])
    out = {r.bookingid_norm: r for r in dq.passenger_per_pnr(p).collect()}
    several = {k: tuple(r[c] for c in r.asDict() if c.startswith("several_")) for k, r in out.items()}
    assert several == {"1": (False, False), "2": (True, True)}


def test_changed_input_gives_new_answers(spark, tmp_path):
    def sheets(n):
        for name, df in (("lineitem", 0), ("orders", 0), ("customer", 0), ("supplier", 0), ("nation", 0), ("region", 0)):
            spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(n).write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")

    sheets(10)
    assert Warehouse.for_testdata(spark, str(tmp_path)).passenger().count() == 10
    sheets(7)
    assert Warehouse.for_testdata(spark, str(tmp_path)).passenger().count() == 7


def test_warehouse_lies_in_the_configured_folder(spark):
    assert os.path.basename(checkpoint_root(spark))
    w = Warehouse.for_testdata(spark, "/root/testdata/sf0.001")
    assert w.root.startswith(checkpoint_root(spark))
