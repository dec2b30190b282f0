from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from aerokpi.params import TESTDATA  # noqa: E402
from aerokpi.sources.schema import ENTITIES, DATE_LIKE  # noqa: E402
from aerokpi.sources.warehouse import Warehouse  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .appName("aerokpi-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


def _struct(entity: str) -> T.StructType:
    return T.StructType([
        T.StructField(n, T.DateType() if t == DATE_LIKE else t, True) for n, t in ENTITIES[entity]
    ])


BOOKING_DEFAULTS = dict(
    bookingid_pnr="PNR-1", reservation_date=dt.date(2025, 2, 1), cancellation_date=None,
    flight_date=dt.date(2025, 3, 3), origin="FRA", destination="FCO", routing="FRA-FCO", flightnumber="XY1000",
    revenue_per_booking_ticket=100.0, revenue_per_booking_ancilliary_pre_check_in=10.0,
    revenue_per_booking_ancilliary_at_check_in=0.0, passengercount=1,
)


def make(spark, entity: str, rows: list[dict], defaults: dict | None = None):
    st = _struct(entity)
    d = defaults or {}
    data = [tuple({**d, **r}.get(f.name) for f in st.fields) for r in rows]
    return spark.createDataFrame(data, st)


def booking(spark, rows):
    return make(spark, "booking", rows, BOOKING_DEFAULTS)


def flight(spark, rows):
    return make(spark, "flight", rows, dict(flightnumber="XY1000", flightdate=dt.date(2025, 3, 3),
                                            availablecapacity=180, timeofday="Morning", routetype="Outbound"))


def passenger(spark, rows):
    return make(spark, "passenger", rows, dict(bookingid="1", ordinal=1, booking_channel="Web", device_used="Mobile"))


def warehouse(spark, b, p=None, f=None, params=TESTDATA) -> Warehouse:
    p = p if p is not None else passenger(spark, [{}])
    f = f if f is not None else flight(spark, [{}])
    return Warehouse.of(spark, b, p, f, params)
