"""Bit-sliced importance resampling against plain sums."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from aerokpi.llm.target_sampling import crc32_of, drawn_rows, planes_of, resample_to_target, weights_of
from tests.llm import brute


def targets(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


@pytest.mark.parametrize("width,buckets,percent,min_words", [(1, 10000, 10, 20), (3, 97, 50, 1), (1, 64, 100, 0)])
def test_equals_plain_sums(spark, docs_of, awkward, width, buckets, percent, min_words):
    wanted = ["alpha beta gamma", None, "", "naïve 日本 short one 12", "Lorem1 IPSUM2"]
    got = resample_to_target(docs_of(awkward), targets(spark, wanted), width=width, buckets=buckets, percent=percent, min_words=min_words).collect()
    want = brute.resampled(awkward, wanted, width, buckets, percent, min_words)
    assert sorted((tuple(r) for r in got), key=lambda x: (brute.order(x[0]), x[1:4], x[4] or 0)) == want


def test_ties_go_to_the_smaller_id_and_rows_follow(spark, docs_of):
    rows = [(i, "one two three four five") for i in range(40)] + [(3, "one two three four five")]
    docs, wanted = docs_of(rows), targets(spark, ["one two"])
    assert sorted((tuple(r) for r in resample_to_target(docs, wanted, min_words=5).collect()), key=lambda x: (x[0], x[4] or 0)) == sorted(
        brute.resampled(rows, ["one two"], min_words=5), key=lambda x: (x[0], x[4] or 0))
    drawn = drawn_rows(docs, wanted, min_words=5)
    assert drawn.columns == docs.columns
    ids = {i for i, *_, rank in brute.resampled(rows, ["one two"], min_words=5) if rank}
    assert sorted(r.doc_id for r in drawn.collect()) == sorted(i for i, _ in rows if i in ids)


def test_empty_tables(spark, docs_of):
    assert resample_to_target(docs_of([]), targets(spark, ["a b"])).collect() == []
    rows = [(1, "a b c"), (2, None)]
    assert sorted(map(tuple, resample_to_target(docs_of(rows), targets(spark, [])).collect())) == brute.resampled(rows, [])


def test_checksums_and_planes():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    starts = rng.integers(0, 4000, 300)
    ends = starts + rng.integers(0, 130, 300)
    assert crc32_of(data, starts, ends).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends)]
    gain = rng.integers(-20000, 20000, 1000)
    bucket, row = rng.integers(0, 1000, 20000) ** 2 // 1000, np.sort(rng.integers(0, 7, 20000))
    want = np.bincount(row, gain[bucket], 9).astype(np.int64)
    assert weights_of(bucket, row, 9, planes_of(gain), 1000).tolist() == want.tolist()
    assert planes_of(np.zeros(3, dtype=np.int64)).shape == (1, 1)
