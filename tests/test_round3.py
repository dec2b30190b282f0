"""Wide tables without a driver list, date orders, long-form offenders, publishing, parameters."""

from __future__ import annotations

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from aerokpi.operators import dq, explore, kpis, marts
from aerokpi.params import DEFAULT, DQ_CHECKS, TESTDATA, WEEKDAYS, params_from_text
from aerokpi.plans import jobs
from aerokpi.plans.registry import DATASETS
from aerokpi.sources.parameters import params_of, read_params
from aerokpi.sources.publish import publish_folder, publish_table
from aerokpi.sources.readers import read_entity, write_table
from aerokpi.sources.schema import DAY_FIRST, MONTH_FIRST, conform, date_orders, elected_orders, unparsed_cells
from aerokpi.sources.warehouse import Warehouse
from conftest import SF0001, booking, flight, passenger, warehouse

MONDAY = dt.date(2025, 3, 3)


# ---- the wide weekday table ------------------------------------------------------
def legs(spark):
    b = booking(spark, [dict(flight_date=MONDAY), dict(flight_date=MONDAY + dt.timedelta(days=2), origin="FCO", destination="FRA", passengercount=90),
                        dict(flight_date=MONDAY, origin=None)])
    return warehouse(spark, b, f=flight(spark, [dict(flightdate=MONDAY), dict(flightdate=MONDAY + dt.timedelta(days=2))]))


def test_wide_table_as_a_map(spark):
    w = legs(spark)
    rows = explore.lf_segment_dow_wide(w.leg_report()).collect()
    assert [(r.dow, dict(r.load_factors)) for r in rows] == [("Monday", {"FRA→FCO": 1 / 180}), ("Wednesday", {"FCO→FRA": 0.5})]


def test_wide_table_with_named_columns(spark):
    wide = explore.lf_segment_dow_wide(legs(spark).leg_report(), ["FRA→FCO", "not flown"])
    assert wide.columns == ["dow", "FRA→FCO", "not flown"]
    assert [tuple(r) for r in wide.collect()] == [("Monday", 1 / 180, None), ("Wednesday", None, None)]
    assert [r.dow for r in explore.lf_segment_dow_wide(legs(spark).leg_report(), []).collect()] == ["Monday", "Wednesday"]


def test_wide_table_of_a_sheet_without_load_factors(spark, tmp_path):
    w = warehouse(spark, booking(spark, [{}]), f=flight(spark, [dict(availablecapacity=None)]), params=DEFAULT)
    assert explore.lf_segment_dow_map(w.leg_report()).collect() == []
    empty = explore.lf_segment_dow_wide(w.leg_report(), ())
    assert empty.columns == ["dow"] and empty.collect() == []
    assert DATASETS["lf_segment_dow_wide"](w).collect() == []
    jobs.export_report(w, str(tmp_path / "report"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "report/tables/lf_by_segment_by_dow_wide")).count() == 0


# ---- one date order per column ---------------------------------------------------
def sheet(spark, cells, column="flight_date"):
    return spark.createDataFrame([(f"P{i}", c) for i, c in enumerate(cells)], f"bookingid_pnr string, {column} string")


def read(spark, cells):
    df = sheet(spark, cells)
    orders = elected_orders(date_orders(df, "booking"))
    return orders["flight_date"], [r.flight_date for r in conform(df, "booking", orders).orderBy(F.length("bookingid_pnr"), "bookingid_pnr").collect()], orders


def test_a_day_first_column_is_read_wholly_day_first(spark):
    order, dates, _ = read(spark, ["03/04/2025", "13/04/2025", "2025-04-05", "04/04/2025 7:30", "6 Apr 2025", None, "04/25/2025", "30/04/2025"])
    assert order == DAY_FIRST
    assert dates == [dt.datetime(2025, 4, 3), dt.datetime(2025, 4, 13), dt.datetime(2025, 4, 5), dt.datetime(2025, 4, 4, 7, 30), dt.datetime(2025, 4, 6), None, None,
                     dt.datetime(2025, 4, 30)]


def test_the_order_that_reads_more_cells_wins(spark):
    order, dates, orders = read(spark, ["04/13/2025", "04/14/2025", "13/04/2025", "03/04/2025"])
    assert order == MONTH_FIRST and dates == [dt.datetime(2025, 4, 13), dt.datetime(2025, 4, 14), None, dt.datetime(2025, 3, 4)]
    lost = {r.column: r.unparsed for r in unparsed_cells(sheet(spark, ["04/13/2025", "13/04/2025"]), "booking", orders).collect()}
    assert lost["flight_date"] == 1


def test_ambiguous_columns_are_reported(spark):
    df = sheet(spark, ["03/04/2025", "05/06/2025", "x", "", None, "2025-01-02"]).withColumn("reservation_date", F.lit("13/04/2025")).withColumn("cancellation_date", F.lit("2025-01-02"))
    out = {r.column: r for r in date_orders(df, "booking").collect()}
    f, r, c = out["flight_date"], out["reservation_date"], out["cancellation_date"]
    assert (f.cells, f.month_first, f.day_first, f.only_month_first, f.only_day_first, f.elected, f.ambiguous) == (4, 2, 2, 0, 0, MONTH_FIRST, True)
    assert (r.elected, r.ambiguous, r.only_day_first) == (DAY_FIRST, False, 6)
    assert (c.elected, c.ambiguous) == (None, False)
    assert date_orders(booking(spark, [{}]), "booking").collect() == []  # typed dates need no election


def test_a_sheet_is_read_by_its_elected_orders(spark, tmp_path):
    (tmp_path / "f.csv").write_text("FlightNumber,FlightDate,AvailableCapacity\nXY1,03/04/2025,180\nXY2,13/04/2025,180\n")
    got = {r.flightnumber: r.flightdate.date() for r in read_entity(spark, str(tmp_path / "f.csv"), "flight", "csv").collect()}
    assert got == {"XY1": dt.date(2025, 4, 3), "XY2": dt.date(2025, 4, 13)}


# ---- offenders in long form ------------------------------------------------------
@pytest.mark.skipif(not os.path.isdir(SF0001), reason="test data not present")
def test_offenders_by_check_equal_the_summary(spark, tmp_path):
    w = Warehouse.for_testdata(spark, SF0001)
    jobs.export_dq(w, str(tmp_path / "dq"), "parquet")
    summary = {r["check"]: r["count"] for r in spark.read.parquet(str(tmp_path / "dq/dq_summary")).collect()}
    long = spark.read.parquet(str(tmp_path / "dq/offenders"))
    counts = {r["check"]: r["count"] for r in long.groupBy("check").count().collect()}
    assert {n: counts.get(n, 0) for n in DQ_CHECKS} == summary
    partitions = {x.split("=")[1] for x in os.listdir(tmp_path / "dq/offenders") if x.startswith("check=")}
    assert partitions == {n for n, c in summary.items() if c}
    one = dq.booking_check(w.booking(), "negative_passengers")
    same = long.where("`check` = 'negative_passengers'").select(*one.columns)
    assert sorted(map(str, one.collect())) == sorted(map(str, same.collect()))


def test_bookings_are_scanned_once(spark, tmp_path):
    b, p, f = booking(spark, [{}, {}, dict(bookingid_pnr="PNR-2", passengercount=-1)]), passenger(spark, [{}]), flight(spark, [{}])
    for name, df in (("b", b), ("p", p), ("l", marts.dq_leg(marts.leg_base(b), f)), ("d", dq.duplicate_keys(b))):
        df.write.parquet(str(tmp_path / name))
    b, p, leg, d = (spark.read.parquet(str(tmp_path / n)) for n in "bpld")
    out = dq.offenders(b, d, p, leg)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("revenue_per_booking_ticket#") and plan.count("Relation [bookingid_pnr") == 1
    got = sorted((r["check"], r.entity, r.bookingid_pnr) for r in out.collect())
    assert got == [("duplicate_legs_within_pnr", "booking", "PNR-1")] * 2 + [("negative_passengers", "booking", "PNR-2")]


# ---- publishing as one step ------------------------------------------------------
def failing(spark):
    return spark.range(1000).repartition(4).select(F.when(F.col("id") == 999, F.raise_error("broken cell")).otherwise(F.col("id").cast("string")).alias("x"))


def test_a_failed_write_leaves_the_published_folder(spark, tmp_path):
    path = str(tmp_path / "out/table")
    write_table(spark.range(5).select(F.col("id").cast("string").alias("x")), path)
    with pytest.raises(Exception, match="broken cell"):
        publish_folder(failing(spark), path)
    assert spark.read.parquet(path).count() == 5
    write_table(spark.range(7).select(F.col("id").cast("string").alias("x")), path, "csv")
    assert spark.read.option("header", True).csv(path).count() == 7
    assert os.listdir(tmp_path / "out") == ["table"]


def test_a_table_is_switched_to_its_new_version(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS pubtest LOCATION '{tmp_path}/pubtest.db'")
    try:
        old = publish_table(spark.range(5).toDF("n"), "pubtest.t")
        other = spark.newSession()
        assert other.table("pubtest.t").count() == 5
        with pytest.raises(Exception, match="broken cell"):
            publish_table(failing(spark), "pubtest.t")
        assert other.table("pubtest.t").count() == 5
        reader = spark.read.parquet(old)  # a query under way
        publish_table(spark.range(6).toDF("n"), "pubtest.t")
        assert spark.newSession().table("pubtest.t").count() == 6 and reader.count() == 5
        other.catalog.refreshTable("pubtest.t")
        assert other.table("pubtest.t").count() == 6
        publish_table(spark.range(7).toDF("other"), "pubtest.t")
        assert spark.table("pubtest.t").columns == ["other"] and not os.path.exists(old)
    finally:
        spark.sql("DROP DATABASE pubtest CASCADE")


# ---- parameters as data ----------------------------------------------------------
def test_a_changed_percentage_changes_pacs(spark, tmp_path):
    (tmp_path / "p.yaml").write_text("# costs\npacs:\n  connection_value_pct: 0.5\n  variable_cost_per_seat_leg: 10  # per seat\nfeeder_segment: [\"A\", \"B\"]\n")
    params = read_params(spark, str(tmp_path / "p.yaml"))
    assert (params.connection_value_pct, params.variable_cost_per_seat_leg, params.feeder_segment) == (0.5, 10.0, ("A", "B"))
    w = warehouse(spark, booking(spark, [{}]), params=params)
    r = DATASETS["pacs_leg"](w).first()
    assert r.pacs_per_seat_leg == pytest.approx((110 * 1.5 - 180 * 10) / 180)
    assert kpis.pacs_leg(w.leg(), DEFAULT).first().pacs_per_seat_leg == pytest.approx((110 * 1.15 - 180 * 25) / 180)


def test_parameters_from_json_and_a_relation(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"capacity_min": 100, "wide_segments": ["A→B"], "channel_synonyms": {"www": "website"}}))
    params = read_params(spark, str(tmp_path / "p.json"), TESTDATA)
    assert (params.capacity_min, params.wide_segments, params.feeder_segment) == (100, ("A→B",), TESTDATA.feeder_segment)
    row = spark.sql("SELECT CAST(0.2 AS DECIMAL(4,2)) AS CONNECTION_VALUE_PCT, 30 AS variable_cost_per_seat_leg, CAST(NULL AS INT) AS yield_buckets")
    params = params_of(row)
    assert (params.connection_value_pct, params.variable_cost_per_seat_leg, params.yield_buckets) == (0.2, 30.0, 5)
    with pytest.raises(ValueError, match="one row"):
        params_of(row.union(row))


@pytest.mark.parametrize("text,message", [
    ("conection_value_pct: 0.2", "unknown parameters: conection_value_pct"), ("connection_value_pct: 15", "between 0 and 1"), ("capacity_min: many", "capacity_min"),
    ("capacity_min: 300", "exceeds"), ("top_outliers: 0", "at least 1"), ("yield_buckets: true", "yield_buckets"), ("feeder_segment: [\"A\"]", "feeder_segment"),
    ("capacity_min: 1\ncapacity_min: 2", "twice"), ("capacity_min", "line 1")])
def test_impossible_parameters_are_errors(text, message):
    with pytest.raises(ValueError, match=message):
        params_from_text(text)


@pytest.mark.skipif(not os.path.isdir(SF0001), reason="test data not present")
def test_other_parameters_over_the_same_warehouse(spark):
    w = Warehouse.for_testdata(spark, SF0001)
    w.leg()
    other = w.with_params(TESTDATA.with_values({"connection_value_pct": 1, "top_pacs_print": 3}))
    assert DATASETS["pacs_top5"](other).count() == 3 and DATASETS["pacs_top5"](w).count() == 5
    assert sorted(WEEKDAYS) == sorted(r.dow for r in DATASETS["lf_by_dow"](other).collect())
