"""Exact sums of amounts of any scale."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from aerokpi.functions import amount_value, money, money_resum_times, money_sum, money_total, sum_value
from aerokpi.operators import explore, marts
from conftest import booking, flight


def exact(x):
    """The number that an amount stands for: a decimal on the common scale, else itself."""
    u = round(x * 10000)
    on = abs(x * 10000 - u) <= max(1e-9, abs(u) * 4e-16) and abs(u) <= 2**53
    return Fraction(u, 10000) if on else Fraction(x)


def nearest(xs):
    total = sum(map(exact, xs), Fraction(0))
    return total.numerator / total.denominator  # int / int is rounded once, correctly


def total(spark, xs, parts=1):
    df = spark.createDataFrame([(float(x),) for x in xs], "x double").repartition(parts)
    return df.agg(sum_value(money_sum(money("x"))).alias("s")).first().s


OFF = [0.123456, 1e15, -1e15 + 0.5, 1 / 3, -7.00000001, 2.0**-100, 3e40, -3e40, 1e-30, 123456.789012, 9.1e11 + 0.0625]


def test_fine_and_huge_amounts_in_one_column(spark):
    assert total(spark, [0.123456, 1e15]) == math.fsum([0.123456, 1e15])
    assert total(spark, OFF) == math.fsum(OFF) == nearest(OFF)
    assert total(spark, [1e40, 0.123456, -1e40]) == 0.123456


def test_same_bits_under_every_partitioning(spark):
    rng = random.Random(11)
    xs = [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randint(-20, 30) for _ in range(400)] + [round(rng.uniform(-500, 500), 4) for _ in range(400)]
    want = nearest(xs)
    for parts in (1, 3, 16):
        rng.shuffle(xs)
        assert total(spark, xs, parts) == want


@pytest.mark.parametrize("xs", [[1e15, 0.12345678, 0.12345678], [2.0**53 + 2, 0.99999], [2.0**60, 2.0**7, 2.0**-60], [2.0**60, 2.0**7, -(2.0**-60)],
                                [2.0**60, -(2.0**6), 2.0**-90], [-(2.0**100), 0.1], [1e-30], [-1e-30, 1e-30], [0.00001] * 7])
def test_one_rounding_to_the_nearest(spark, xs):
    assert total(spark, xs) == nearest(xs)


def test_decimals_of_the_common_scale_stay_decimals(spark):
    assert total(spark, [0.1] * 10) == 1.0
    assert total(spark, [0.1 + 0.2, -0.3]) == 0.0
    assert total(spark, [9e10 + 0.01, 10.1234]) == nearest([9e10 + 0.01, 10.1234])
    big = [9e11] * 3000
    assert total(spark, big) == 9e11 * 3000


def test_nulls_and_what_is_no_amount(spark):
    df = spark.createDataFrame([(1, None, None), (2, 1.5, None), (3, 0.123456, 1.0), (4, float("nan"), 2.0), (5, float("inf"), 1e300)], "id int, a double, b double")
    out = {r.id: r for r in df.select("id", amount_value(money_total("a", "b")).alias("zero"), amount_value(money_total("a", "b", nulls_as_zero=False)).alias("null")).collect()}
    assert [out[i].zero for i in range(1, 6)] == [0.0, 1.5, 1.123456, 2.0, 0.0]
    assert [out[i].null for i in range(1, 6)] == [None, None, 1.123456, None, None]
    assert df.where("id = 1").agg(sum_value(money_sum(money("a"))).alias("s")).first().s is None


def test_resum_and_times(spark):
    df = spark.createDataFrame([(i % 5, i % 2, x) for i, x in enumerate(OFF * 3)], "k int, g int, x double")
    fine = df.groupBy("g", "k").agg(money_sum(money("x")).alias("t"))
    got = {r.g: r.s for r in fine.groupBy("g").agg(sum_value(money_resum_times("t", F.lit(3))).alias("s")).collect()}
    for g in (0, 1):
        assert got[g] == nearest([x for i, x in enumerate(OFF * 3) if i % 2 == g] * 3)


def test_marts_take_amounts_of_any_scale(spark):
    b = booking(spark, [{"bookingid_pnr": f"P{i}", "revenue_per_booking_ticket": x, "revenue_per_booking_ancilliary_pre_check_in": 0.123456,
                         "revenue_per_booking_ancilliary_at_check_in": None if i == 2 else 1e-7} for i, x in enumerate([1e15, -1e15, 5.0, 0.1, 1e39])])
    base = marts.leg_base(b)
    leg = marts.leg(base, flight(spark, [{}])).first()
    xs = [v for i, x in enumerate([1e15, -1e15, 5.0, 0.1, 1e39]) if i != 2 for v in (x, 0.123456, 1e-7)]
    assert leg.total_revenue == nearest(xs)
    seg = explore.segment_kpis(base).first()
    assert seg.num == nearest([0.123456] * 5 + [1e-7] * 4)


def test_parts_add_up_like_totals(spark):
    from aerokpi.functions import amount_value, money_total, parts_total, with_parts

    rows = [(1.25, 2.5), (None, 3.0), (0.1 + 2.0**-60, -7.75), (float("nan"), 1e200), (2.0**70, -0.00011), (None, None), (-1.5, 1e300)]
    df = with_parts(spark.createDataFrame(rows, "a double, b double"), "a", "b")
    for zero in (True, False):
        both = df.select(amount_value(money_total("a", "b", nulls_as_zero=zero)).alias("x"), amount_value(parts_total("a", "b", nulls_as_zero=zero)).alias("y"))
        assert both.where("NOT (x <=> y)").count() == 0


def test_leg_sums_have_no_decimal_buffers(spark):
    """Legs with amounts on and off the scale, null keys, and ids without a digit."""
    from decimal import Decimal
    from fractions import Fraction

    from aerokpi.functions import booking_id_norm, money_sum, money_total, sum_value
    from aerokpi.operators import marts
    from aerokpi.sources.schema import REVENUE_COLS
    from pyspark.sql import functions as F

    amounts = [(1.25, 2.5, 0.75), (None, 3.0, 1.0), (1e-7 / 3, 2.0**-40, 5.0), (2.0**90, -(2.0**90), 0.01), (float("inf"), None, 2.0)]
    rows = [(i, None if i % 5 == 4 else "TX1", None if i % 7 == 6 else "2024-01-01", "A", "B", f"p {i}" if i % 3 else "none", None, 1, *amounts[i % 5 if i % 2 else 0])
            for i in range(60)]
    schema = "i int, flightnumber string, flight_date string, origin string, destination string, bookingid_pnr string, cancellation_date string, passengercount long, "
    b = spark.createDataFrame(rows, schema + ", ".join(f"{c} double" for c in REVENUE_COLS)).withColumn("flight_date", F.to_date("flight_date"))
    got = marts.leg_base(b)
    want = b.groupBy(*marts.LEG_KEYS).agg(sum_value(money_sum(money_total(*REVENUE_COLS))).alias("r"), F.count(booking_id_norm("bookingid_pnr")).alias("n"))
    keys = lambda df: {(r.flightnumber, r.flight_date): (r.r, r.n) for r in df.collect()}
    found = keys(got.select("flightnumber", "flight_date", sum_value("revenue_all_u").alias("r"), F.col("n_ids").alias("n")))
    assert found == keys(want) and len(found) == 4
    # long sums alone for every booking: no decimal buffer is read and written by row
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "sum(cast(" not in plan
    exact = sum(Fraction(Decimal(x)) for r in rows if r[1] == "TX1" and r[2] for x in r[8:] if x is not None and abs(x) != float("inf"))
    total = [v[0] for k, v in found.items() if k[0] == "TX1" and k[1]]
    assert len(total) == 1 and abs(Fraction(total[0]) - exact) < Fraction(1, 100)
