from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("key", T.StringType()), T.StructField("row", T.IntegerType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table with two extra columns whose names the operators use themselves."""
    from aerokpi.llm.common import ship_package

    ship_package(spark)

    def make(rows, parts=3):
        return spark.createDataFrame([(i, t, "k", 1) for i, t in rows], DOCS).repartition(parts)

    return make


@pytest.fixture(scope="session")
def awkward():
    """Nulls, empty and white-space texts, ties, repeated rows, a very long text, odd characters."""
    rng = random.Random(3)
    prose = [" ".join(rng.choice(["alpha", "beta", "gamma", "Delta", "é", "naïve", "日本", "x<|endoftext|>y", "it's"]) for _ in range(40)) for _ in range(6)]
    long = " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit"]) + str(rng.randrange(1000)) for _ in range(30000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, prose[0]), (5, prose[0]), (5, prose[0]), (6, prose[0] + " "), (7, prose[1] + "\n" + prose[2]),
            (None, prose[1]), (8, long), (9, long + " tail"), (10, "a"), (11, "a"), (12, "short one"), (13, "   x"),
            (14, prose[3] + "\n\n" + prose[3]), (15, prose[4] + " " + prose[5])]
    return rows
