"""Quantiles by rank search against Spark's own percentile."""

import random

import pytest
from pyspark.sql import functions as F

from aerokpi.operators import quantiles as Q

SHARES = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]


def plain(df, column):
    return list(df.agg(*[F.percentile(column, F.lit(s)).alias(f"q{i}") for i, s in enumerate(SHARES)]).first())


@pytest.mark.parametrize("make", [
    lambda r: r.uniform(-3.0, 3.0), lambda r: float(r.randint(0, 40)), lambda r: r.gauss(0, 1) * 10.0 ** r.randint(-6, 6),
    lambda r: 2.0 ** r.randint(-60, 60), lambda r: r.choice([-1.7e308, 1.7e308, 0.0, 5e-324]),
])
def test_equal_to_percentile_on_fractional_and_extreme_values(spark, make):
    r = random.Random(5)
    rows = [(make(r), None if i % 7 == 0 else float(i % 3)) for i in range(1501)]
    df = spark.createDataFrame(rows, "a double, b double").repartition(5)
    got = Q.quantiles(df, [("a", s) for s in SHARES] + [("b", s) for s in SHARES])
    assert got == plain(df, "a") + plain(df, "b")


def test_missing_values_and_empty_tables(spark):
    df = spark.createDataFrame([(float("nan"), 1), (None, 2), (float("inf"), None), (2.5, 4)], "a double, b long")
    assert Q.quantiles(df, [("a", 0.5), ("b", 0.5), ("b", 0.9)]) == [2.5, 2.0, plain(df, "b")[4]]
    assert Q.quantiles(df.limit(0), [("a", 0.5), ("b", 0.9)]) == [None, None]


def test_counters_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(Q, "RANGES", 16)
    df = spark.range(20000).select((F.col("id") * 0.37).alias("a"))
    assert Q.quantiles(df, [("a", 0.5)]) == [df.agg(F.percentile("a", F.lit(0.5))).first()[0]]
