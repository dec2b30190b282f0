"""Persistent KPI views over published marts."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from conftest import SF0001, booking, flight, warehouse

from aerokpi.params import DEFAULT
from aerokpi.plans import jobs
from aerokpi.plans.registry import DATASETS
from aerokpi.plans.views import kpi_sql
from aerokpi.sources.warehouse import Warehouse


@pytest.fixture
def database(spark, tmp_path):
    for layer in ("raw", "mart", "kpi"):
        spark.sql(f"CREATE DATABASE viewtest_{layer} LOCATION '{tmp_path}/{layer}.db'")
    yield "viewtest"
    for layer in ("kpi", "mart", "raw"):
        spark.sql(f"DROP DATABASE viewtest_{layer} CASCADE")


def rows(df):
    columns = sorted(df.columns)
    rounded = lambda x: float(f"{x:.11e}") if isinstance(x, float) else x
    return columns, sorted((tuple(rounded(r[c]) for c in columns) for r in df.collect()), key=str)


@pytest.mark.skipif(not os.path.isdir(SF0001), reason="test data not present")
def test_another_session_reads_every_kpi(spark, database):
    w = Warehouse.for_testdata(spark, SF0001)
    jobs.publish_catalog(spark, w, database)
    other = spark.newSession()
    names = kpi_sql(f"{database}_mart", w.params)
    assert {t.name for t in other.catalog.listTables(f"{database}_kpi") if not t.isTemporary} == set(names)
    for name in names:
        assert other.catalog.getTable(f"{database}_kpi.{name}").tableType == "VIEW"
        assert rows(other.table(f"{database}_kpi.{name}")) == rows(DATASETS[name](w)), name


def test_views_follow_the_data_and_the_parameters(spark, database):
    spark.range(3).write.saveAsTable(f"{database}_kpi.fwlf_overall")  # a table of an earlier version makes way
    day = dt.date(2025, 3, 4)
    odd = [{}, dict(passengercount=None, revenue_per_booking_ticket=None), dict(origin=None), dict(flightnumber="XY2", flight_date=day, passengercount=0),
           dict(flightnumber="XY3", flight_date=None), dict(destination="MUC", revenue_per_booking_ancilliary_pre_check_in=0.0)]
    flights = flight(spark, [{}, dict(flightnumber="XY2", flightdate=day, availablecapacity=0)])
    for data, params in ((odd[:1], DEFAULT), (odd, DEFAULT.with_values({"connection_value_pct": 0.5, "top_outliers": 2}))):
        w = warehouse(spark, booking(spark, data), f=flights, params=params)
        jobs.publish_catalog(spark, w, database)
        other = spark.newSession()
        assert other.catalog.getTable(f"{database}_kpi.fwlf_overall").tableType == "VIEW"
        for name in ("fwlf_overall", "pacs_leg", "aras_overall", "anc_share_segment", "low_lf_legs", "segment_kpis"):
            assert rows(other.table(f"{database}_kpi.{name}")) == rows(DATASETS[name](w)), name
