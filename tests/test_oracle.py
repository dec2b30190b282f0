"""Every registered query vs its DuckDB oracle statement on the sf0.001 tables.

Rows are compared as order-insensitive multisets after sorting columns by
name (as the driver does); doubles must agree to 1e-9 relative.
"""

from __future__ import annotations

import math
import os

import duckdb
import pytest
from conftest import SF0001

from __spark_entry__ import entry, oracle_sql, queries
from aerokpi.plans.registry import QUERIES  # the optional subpackage's queries have tests of their own

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF0001), reason="test data not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    return c


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in recs]
    out.sort(key=lambda t: tuple((x is None, str(x)) for x in t))
    return [cols[i] for i in order], out


def _close(a, b):
    if a == b:
        return True
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= 1e-9 * max(1.0, abs(a), abs(b))
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(_close(x, y) for x, y in zip(a, b))
    return False


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(oracle_sql()) and set(QUERIES) <= set(queries())
    assert set(oracle_sql()) <= set(queries())
    assert len(QUERIES) >= 70


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.columns == ["origin", "destination", "fwlf"]
    assert df.count() == 25


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = queries()[name](spark, SF0001)
    sc, sr = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(oracle_sql()[name])
    oc, orr = _rows([d[0] for d in cur.description], cur.fetchall())
    assert sc == oc
    assert len(sr) == len(orr)
    bad = [(x, y) for x, y in zip(sr, orr) if not _close(x, y)]
    assert not bad, bad[:3]
