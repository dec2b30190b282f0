"""One micro-fixture per semantic trap (null conventions, fan-out, ties, spines)."""

from __future__ import annotations

import datetime as dt

import pytest
from conftest import booking, flight, passenger, warehouse

from aerokpi.operators import clean, dq, explore, kpis, marts, weekday
from aerokpi.params import TESTDATA, WEEKDAYS

D = dt.date(2025, 3, 3)  # a Monday


def _legs(w):
    return {(r.origin, r.destination): r for r in w.leg().collect()}


def test_null_parts_sql_vs_report(spark):
    b = booking(spark, [
        dict(revenue_per_booking_ticket=100.0, revenue_per_booking_ancilliary_pre_check_in=10.0,
             revenue_per_booking_ancilliary_at_check_in=None),
        dict(revenue_per_booking_ticket=50.0, revenue_per_booking_ancilliary_pre_check_in=5.0,
             revenue_per_booking_ancilliary_at_check_in=5.0),
    ])
    w = warehouse(spark, b)
    assert w.leg().first().total_revenue == 60.0
    assert w.leg_report().first().revenue == 170.0


def test_all_null_sum(spark):
    b = booking(spark, [dict(passengercount=None), dict(passengercount=None)])
    w = warehouse(spark, b)
    assert w.leg().first().pax is None
    assert w.leg_report().first().pax == 0


def test_null_date_join(spark):
    b = booking(spark, [dict(flight_date=None)])
    f = flight(spark, [dict(flightdate=None, availablecapacity=170)])
    w = warehouse(spark, b, f=f)
    assert w.leg().first().seats is None          # SQL: null never equals null
    assert w.leg_report().first().availablecapacity == 170   # report: null-safe


def test_fan_out_on_two_keys(spark):
    b = booking(spark, [
        dict(origin="FRA", destination="FCO", revenue_per_booking_ancilliary_pre_check_in=10.0),
        dict(origin="FRA", destination="PMO", revenue_per_booking_ancilliary_pre_check_in=30.0),
    ])
    f = flight(spark, [dict(availablecapacity=100)])
    w = warehouse(spark, b, f=f)
    # ancillary per (flight, date) = 40 pairs with both legs (seats 100 each):
    # (40 + 40) / (100 + 100)
    assert kpis.aras_overall(w.leg_base(), w.leg()).first().aras == pytest.approx(0.4)
    # each O&D's ancillary row pairs with both legs: it counts twice against
    # the revenue of both legs (110 + 130)
    shares = {(r.origin, r.destination): r.anc_share for r in explore.anc_share_segment(w.leg_base(), w.leg()).collect()}
    assert shares[("FRA", "FCO")] == pytest.approx(2 * 10 / 240)
    assert shares[("FRA", "PMO")] == pytest.approx(2 * 30 / 240)


def test_ntile_small_nulls_last_ties_by_date(spark):
    b = booking(spark, [
        dict(flight_date=dt.date(2025, 3, 1), revenue_per_booking_ticket=100.0, passengercount=1),
        dict(flight_date=dt.date(2025, 3, 2), revenue_per_booking_ticket=100.0, passengercount=1),
        dict(flight_date=dt.date(2025, 3, 3), revenue_per_booking_ticket=100.0, passengercount=0),
    ])
    f = flight(spark, [dict(flightdate=dt.date(2025, 3, d)) for d in (1, 2, 3)])
    w = warehouse(spark, b, f=f)
    y = {r.flight_date.day: (r.q5, r.yield_index) for r in marts.leg_yield_index(w.leg(), TESTDATA).collect()}
    assert y == {1: (1, 0.0), 2: (2, 0.25), 3: (3, 0.5)}


def test_zero_seats_no_exception(spark):
    w = warehouse(spark, booking(spark, [{}]), f=flight(spark, [dict(availablecapacity=0)]))
    leg = w.leg().first()
    assert leg.leg_lf is None
    assert kpis.pacs_leg(w.leg()).first().pacs_per_seat_leg is None
    assert w.leg_report().first().load_factor is None


def test_no_tuesday_spine_and_pivot(spark):
    # one leg on each weekday but Tuesday (2025-03-03 is a Monday)
    days = [D + dt.timedelta(days=i) for i in range(7) if i != 1]
    b = booking(spark, [dict(flight_date=d) for d in days])
    f = flight(spark, [dict(flightdate=d) for d in days])
    w = warehouse(spark, b, f=f)
    by_dow = explore.lf_by_dow(spark, w.leg_report()).collect()
    assert [r.dow for r in by_dow] == list(WEEKDAYS)
    assert by_dow[1].avg_load_factor is None
    assert len(explore.cancellation_by_dow(spark, w.leg_base()).collect()) == 7
    assert len(weekday.fwlf_by_dow(spark, w.leg_report()).collect()) == 7
    wide = explore.lf_segment_dow_wide(w.leg_report()).collect()
    assert sorted(r.dow for r in wide) == sorted(set(WEEKDAYS) - {"Tuesday"})


def test_first_channel_by_ordinal(spark):
    p = passenger(spark, [
        dict(bookingid="PNR 7", ordinal=3, booking_channel="App"),
        dict(bookingid="PNR 7", ordinal=1, booking_channel=None),
        dict(bookingid="PNR 7", ordinal=2, booking_channel=" Web "),
    ])
    r = clean.pnr_channel(p, TESTDATA).collect()
    assert [(x.bookingid_norm, x.primary_channel) for x in r] == [("7", "website")]


def test_devices_in_first_seen_order(spark):
    p = passenger(spark, [
        dict(bookingid="1", ordinal=5, device_used="Mobile"),
        dict(bookingid="1", ordinal=2, device_used="Desktop "),
        dict(bookingid="1", ordinal=3, device_used=None),
        dict(bookingid="1", ordinal=9, device_used="desktop"),
    ])
    assert clean.pnr_devices(p, TESTDATA).first().devices == ["desktop", "mobile"]


def test_nunique_counts_null_as_value(spark):
    p = passenger(spark, [
        dict(bookingid="1", ordinal=1, booking_channel="Web"),
        dict(bookingid="1", ordinal=2, booking_channel=None),
        dict(bookingid="2", ordinal=3, booking_channel="Web"),
        dict(bookingid="2", ordinal=4, booking_channel="Web"),
    ])
    rows = dq.passenger_check(p, "same_booking_multiple_channels").collect()
    assert sorted(r.ordinal for r in rows) == [1, 2]


def test_correlation_needs_more_than_two_pairs(spark):
    days = [D, D + dt.timedelta(days=1)]
    b = booking(spark, [dict(flight_date=d, passengercount=i + 1) for i, d in enumerate(days)])
    w = warehouse(spark, b, f=flight(spark, [dict(flightdate=d) for d in days]))
    assert explore.rev_lf_correlation(w.leg_report(), TESTDATA).first().rev_lf_corr is None


def test_one_way_segment_has_null_reverse(spark):
    w = warehouse(spark, booking(spark, [{}]))
    r = explore.directional_imbalance(w.leg_report()).first()
    assert r.load_factor_rev is None and r.lf_diff_vs_reverse is None


def test_routing_check(spark):
    b = booking(spark, [
        dict(bookingid_pnr="PNR-1", routing="fra - fco"),
        dict(bookingid_pnr="PNR-2", routing="FRA→FCO"),
        dict(bookingid_pnr="PNR-3", routing="FRA-PMO"),
        dict(bookingid_pnr="PNR-4", routing=None),
    ])
    bad = sorted(r.bookingid_pnr for r in dq.booking_check(b, "routing_inconsistent_with_od").collect())
    assert bad == ["PNR-3", "PNR-4"]


def test_percentiles_are_interpolated(spark):
    # days after booking to cancel: 1, 2, 3, 4
    b = booking(spark, [
        dict(bookingid_pnr=f"PNR-{i}", reservation_date=dt.date(2025, 2, 1),
             cancellation_date=dt.date(2025, 2, 1) + dt.timedelta(days=i))
        for i in (1, 2, 3, 4)
    ])
    r = explore.cancel_timing_stats(b).first()
    assert r.median_days_after_booking == 2.5
    assert r.p90_days_after_booking == pytest.approx(3.7)


def test_duplicates_null_keys_equal(spark):
    b = booking(spark, [
        dict(bookingid_pnr="PNR-1", flight_date=None),
        dict(bookingid_pnr="PNR-1", flight_date=None),
        dict(bookingid_pnr="PNR-2"),
    ])
    rows = dq.duplicate_legs_within_pnr(b).collect()
    assert len(rows) == 2 and all(r.bookingid_pnr == "PNR-1" for r in rows)


def test_feeder_credit(spark):
    # feeder A->B and onward B->C on the same Monday; seats 100, cost 40, pct 0.25
    b = booking(spark, [
        dict(origin="A", destination="B", flightnumber="F1", revenue_per_booking_ticket=1000.0,
             revenue_per_booking_ancilliary_pre_check_in=0.0),
        dict(origin="B", destination="C", flightnumber="F2", revenue_per_booking_ticket=400.0,
             revenue_per_booking_ancilliary_pre_check_in=0.0),
    ])
    f = flight(spark, [dict(flightnumber="F1", availablecapacity=100), dict(flightnumber="F2", availablecapacity=100)])
    params = TESTDATA.__class__(feeder_segment=("A", "B"), onward_segment=("B", "C"))
    w = warehouse(spark, b, f=f, params=params)
    mon = {r.dow: r.pacs for r in weekday.pacs_feeder_by_dow(spark, w.leg_report(), params).collect()}["Monday"]
    feeder = (1000 + 0.25 * 400 - 100 * 40) / 100
    onward = (400 - 100 * 40) / 100
    assert mon == pytest.approx((feeder + onward) / 2)


def test_distributed_ntile_equals_window_ntile(spark):
    import random

    rnd = random.Random(7)
    rows = []
    for i in range(400):
        seg = rnd.choice([("A", "B"), ("A", "C"), ("B", "A"), (None, "A")])
        rows.append(dict(
            bookingid_pnr=f"PNR-{i}", origin=seg[0], destination=seg[1],
            flight_date=D + dt.timedelta(days=rnd.randrange(40)), flightnumber=rnd.choice(["F1", "F2", "F3"]),
            revenue_per_booking_ticket=float(rnd.choice([50, 100, 150, 200])),  # many ties
            passengercount=rnd.choice([0, 1, 2, None]),                          # null rev/pax
        ))
    b = booking(spark, rows).repartition(5)
    w = warehouse(spark, b)
    leg = w.leg()
    key = ["origin", "destination", "flight_date", "flightnumber"]
    dist = {tuple(r[k] for k in key): r.q5 for r in marts.leg_yield_index(leg, TESTDATA).collect()}
    ref = {tuple(r[k] for k in key): r.q5 for r in marts.leg_yield_index_window(leg, TESTDATA).collect()}
    assert dist == ref and len(dist) == leg.count()


@pytest.mark.parametrize("n_legs", [1, 2, 4, 5, 6, 11, 12])
def test_distributed_ntile_small_segments(spark, n_legs):
    rows = [dict(bookingid_pnr=f"P{i}", flight_date=D + dt.timedelta(days=i), revenue_per_booking_ticket=float(i))
            for i in range(n_legs)]
    w = warehouse(spark, booking(spark, rows))
    got = sorted(r.q5 for r in marts.leg_yield_index(w.leg(), TESTDATA).collect())
    ref = sorted(r.q5 for r in marts.leg_yield_index_window(w.leg(), TESTDATA).collect())
    assert got == ref


def test_duplicate_legs_are_found_from_a_written_key_table(spark):
    """DQ-13 with written keys: the bookings aren't shuffled, and the summary takes its count from the keys."""
    import inspect

    from aerokpi.operators import clean, dq

    assert "stable" in inspect.signature(dq.duplicate_legs_within_pnr).parameters
    columns = "bookingid_pnr string, reservation_date date, cancellation_date date, flight_date date, origin string, destination string, routing string, flightnumber string, " \
        "revenue_per_booking_ticket double, revenue_per_booking_ancilliary_pre_check_in double, revenue_per_booking_ancilliary_at_check_in double, passengercount long"
    row = lambda pnr, flight: (pnr, None, None, None, "a ", "B", None, flight, 1.5, None, 2.0, 1)
    b = spark.createDataFrame([row("P-1", "TX1"), row("x1", "TX1"), row("P-2", "TX1"), row(None, None), row("no", None), row("P-3", None)], columns)
    plain = dq.duplicate_legs_within_pnr(b)
    kept = dq.duplicate_legs_within_pnr(b, lambda d: d.localCheckpoint())
    show = lambda df: sorted(map(str, df.collect()))
    assert show(plain) == show(kept) and plain.count() == 4 and plain.columns == dq.dq_booking(b).columns
    assert {r.total_revenue for r in kept.collect()} == {3.5}
    p = spark.createDataFrame([("pnr 1", 1, "App", None)], "bookingid string, ordinal long, booking_channel string, device_used string")
    enriched = clean.booking_enriched(b, p)
    plan = enriched._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ancillary_total") < plan.index("Join LeftOuter")  # derived above the join
    assert enriched.columns == ["bookingid_norm", *[c for c in clean.booking_clean(b).columns if c != "bookingid_norm"], "primary_channel"]
    assert [r.primary_channel for r in enriched.orderBy("bookingid_pnr").collect()].count("condor app") == 2
