"""Invariants on the sf0.001 test data: partitioning-independence, totals,
bounds, antisymmetry, summary = offender counts."""

from __future__ import annotations

import os

import pytest
from conftest import SF0001
from pyspark.sql import functions as F

from aerokpi.operators import dq, explore, marts
from aerokpi.params import DQ_CHECKS, TESTDATA
from aerokpi.sources.warehouse import Warehouse
from __spark_entry__ import queries

pytestmark = pytest.mark.skipif(not os.path.isdir(SF0001), reason="test data not present")


@pytest.fixture(scope="module")
def wh(spark):
    return Warehouse.for_testdata(spark, SF0001)


def _set(df):
    return sorted((tuple((x is None, str(x)) for x in r) for r in df.collect()))


def test_repartitioned_input_gives_same_results(spark, wh):
    shuffled = Warehouse.of(
        spark,
        wh.booking().repartition(7).sortWithinPartitions(F.rand(3)),
        wh.passenger().repartition(5),
        wh.flight().repartition(3),
        TESTDATA,
    )
    assert _set(shuffled.leg()) == _set(wh.leg())
    assert _set(explore.segment_kpis(shuffled.leg_base())) == _set(explore.segment_kpis(wh.leg_base()))
    assert _set(dq.dq_summary(shuffled.booking(), shuffled.passenger(),
                              marts.dq_leg(shuffled.leg_base(), shuffled.flight()))) == \
        _set(queries()["dq_summary"](spark, SF0001))


def test_leg_pax_equals_booking_pax(wh):
    legs = wh.leg().agg(F.sum("pax")).first()[0]
    books = wh.booking().agg(F.sum("passengercount")).first()[0]
    assert legs == books


def test_yield_index_bounds(wh):
    r = marts.leg_yield_index(wh.leg(), TESTDATA).agg(F.min("yield_index"), F.max("yield_index")).first()
    assert 0.0 <= r[0] <= r[1] <= 1.0


def test_imbalance_antisymmetric(wh):
    rows = {(r.origin, r.destination): r.lf_diff_vs_reverse for r in explore.directional_imbalance(wh.leg_report()).collect()}
    for (o, d), v in rows.items():
        if v is not None and (d, o) in rows:
            assert v == pytest.approx(-rows[(d, o)], abs=2e-6)


def test_summary_equals_offender_counts(spark):
    q = queries()
    summary = {r["check"]: r["count"] for r in q["dq_summary"](spark, SF0001).collect()}
    assert list(summary) == sorted(summary, key=lambda n: (-summary[n], DQ_CHECKS.index(n)))
    for name in DQ_CHECKS:
        assert q[f"dq_{name}"](spark, SF0001).count() == summary[name], name


def test_expected_fixture_values(spark):
    """Values every engine must reproduce on the sf0.001 adapter."""
    q = queries()
    assert q["leg"](spark, SF0001).count() == 5584
    assert q["src_flight"](spark, SF0001).count() == 5439
    assert q["fwlf_overall"](spark, SF0001).first().fwlf == pytest.approx(0.14494495466885476, rel=1e-12)
    assert q["srm_proxy"](spark, SF0001).first()[0] == pytest.approx(25.21700827040633, rel=1e-12)
