"""The registered queries over the given tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from __spark_entry__ import oracle_sql, queries
from aerokpi.llm.queries import ORACLE, QUERIES
from tests.llm import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def plain(x):
    return None if pd.isna(x) else int(x) if isinstance(x, float) and x == int(x) else x



def test_all_are_registered():
    names = [n for n in queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(n.split("_")[0] for n in names) == sorted([f"op{i}" for i in range(1, 14)] + ["pipeline"])
    assert set(ORACLE) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLE[name]).df()
    key = lambda rows: sorted(rows, key=lambda r: tuple(str(x) for x in r))
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    as_rows = lambda f: key([tuple(map(plain, r)) for r in f[columns].astype(object).itertuples(index=False)])
    assert as_rows(got) == as_rows(want)


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_jaccard_query(spark):
    got = sorted(tuple(r) for r in QUERIES["op5_jaccard_join"](spark, SF).collect())
    assert got == sorted(brute.near(documents(spark)))


def test_fingerprint_query(spark):
    import hashlib

    rows = documents(spark)
    edited, near = brute.edited(rows), {i: c for i, _, c in brute.near(rows)}
    got = QUERIES["op13_fingerprints"](spark, SF).collect()
    assert {(r.doc_id, r.n_chars, r.edited_sha256, r.near_id) for r in got} == {
        (i, len(t), hashlib.sha256(edited[i].encode()).hexdigest(), near[i]) for i, t in rows}
    assert len({r.fingerprint for r in got}) == len({brute.shingles(t) for _, t in rows})


def test_suffix_query(spark):
    import hashlib

    got = sorted(tuple(r) for r in QUERIES["op10_suffix_dedup"](spark, SF).collect())
    assert got == sorted((i, n, g, s, hashlib.sha256(k).hexdigest()) for i, n, g, s, k in brute.repeats(documents(spark)))


def test_pipeline_against_brute_force(spark):
    """Stage by stage: what each stage gives, from what the stage before it gave."""
    import corpus_pipeline
    from aerokpi.llm.common import written
    from aerokpi.llm.resampling import resample

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns = docs.columns
    state = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, SF), "test-stage")
        assert out.columns == columns
        rows = list(state.items())
        if name == "quality classifier":
            kept = {r.doc_id for r in resample(docs, labels).where("kept").collect()}
            state = {i: t for i, t in rows if i in kept}
            assert 0 < len(state) < len(rows)
        elif name == "exact dedup":
            kept = {r[0] for r in brute.exact(rows) if r[3]}
            state = {i: t for i, t in rows if i in kept}
        elif name == "n-gram Jaccard join":
            kept = {i for i, _, c in brute.near(rows) if i == c}
            state = {i: t for i, t in rows if i in kept}
        else:
            state = {i: k.decode("utf-8", "ignore") for i, _, _, _, k in brute.repeats(rows)}
        got = {r.doc_id: r for r in out.collect()}
        assert {i: r.text for i, r in got.items()} == state
        docs = out
    assert all(r.n_chars == len(state[i]) for i, r in got.items())

    import numpy as np
    import zlib
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(corpus_pipeline.tokenizer_file("word_bpe_49k.json"))
    want = {i: np.array(tokenizer.encode(t, add_special_tokens=False).ids + [1], "<u4") for i, t in state.items()}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in pieces} == set(want)
    assert all(r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes()) for r in pieces)
    assert sum(r.length for r in pieces) == sum(map(len, want.values()))


def test_run_gives_the_last_stage(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0
