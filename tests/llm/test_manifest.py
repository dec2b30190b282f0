"""The Merkle manifest against a plain tree."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from aerokpi.llm.merkle import folded, leaf_digest, manifest, siblings
from tests.llm import brute

FIELDS = ("doc_id", "lang", "n", "text")
SCHEMA = "doc_id long, lang string, n long, text string, pos string, grp int, node int, path int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA).repartition(3)


def both(spark, rows, fanout=2, levels=None):
    got = manifest(table(spark, rows), "doc_id", "lang", FIELDS, fanout=fanout).select("doc_id", "lang", "leaf", "subroot", "root", "path").collect()
    got = [(*r[:5], [tuple(s) for s in r.path]) for r in got]
    want = brute.manifest([(i, g, brute.leaf(i, g, n, t)) for i, g, n, t in rows], fanout)
    key = lambda r: (brute.order(r[0]), str(r[1:]))
    assert sorted(got, key=key) == sorted(want, key=key)
    return got


def awkward_rows():
    rng = random.Random(5)
    rows = [(i, rng.choice(["en", "en", "en", "de", "Ü", ""]), rng.choice([None, i]), rng.choice([None, "", "a b", "ü" * 9])) for i in range(700)]
    rows += [(None, "en", 1, "no id"), (None, "en", 1, "no id"), (5, None, None, None), (6, None, 1, "x"), (7, "lone", 1, "long " * 30000)]
    return rows + [(8, "same", 1, "t")] * 5 + [(8, "same", 1, "u")]


@pytest.mark.parametrize("fanout", [2, 3])
def test_equals_a_plain_tree(spark, fanout):
    both(spark, awkward_rows(), fanout)


@pytest.mark.parametrize("n", [1, 2, 3, 255, 256, 257, 513])
def test_sizes_around_a_block(spark, n):
    both(spark, [(i, "g", i, "t") for i in range(n)])


def test_empty(spark):
    assert both(spark, []) == []


def test_tampering_shows_and_proofs_fold(spark):
    rows = awkward_rows()
    changed = F.when(F.col("doc_id") % 5 == 0, leaf_digest(F.col("doc_id"), F.col("lang"), F.col("n") + 1, F.col("text")))
    out = manifest(table(spark, rows), "doc_id", "lang", FIELDS, {"changed": changed}).select(
        "*", folded(F.col("path"), F.col("leaf")).alias("good"), folded(F.col("path"), F.coalesce("changed", "leaf")).alias("seen"), siblings(F.col("path")).alias("proof"))
    n_of = {(i, g): n for i, g, n, _ in rows}
    for r in out.collect():
        assert r.good == r.root and r.proof == "".join(a + b for a, b in r.path)
        touched = r.doc_id is not None and r.doc_id % 5 == 0 and n_of[r.doc_id, r.lang] is not None
        assert (r.seen != r.root) == touched
