from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import types as T

from aerokpi.llm import warc
from aerokpi.llm.common import new_path, ship_package

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
                      T.StructField("digest", T.StringType())])


def pages():
    rng = random.Random(4)
    bits = ["\r\n", "\r\n\r\n", "\r", "\n", "a", "é", "日本", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc", " "]
    odd = ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(60)]
    rows = [(i, f"http://x/{i}?é\r\n", t, "d") for i, t in enumerate(odd)]
    rows += [(100, None, None, "d"), (101, "", "", "d"), (102, "u", "x" * 99, "d"), (103, "u", "x" * 99, "d"), (105, "u", "x" * 100, "d"),
             (104, "u", "x" * 100, "d"), (106, "u", "x" * 100, "d"), (None, "u", "x" * 100, "d"), (107, "u", "é" * 5000, "d"), (108, "u", "é" * 5000, "d"),
             (109, "u", "y" * 2048, "d"), (110, "u", "y" * 150, "d"), (110, "u", "y" * 150, "d"), (None, "u", "own", "d"), (111, "u", "\r\n\r\n" * 700, "d")]
    return rows


@pytest.mark.parametrize("capacity", [1, 1024])
def test_round_trip(spark, capacity):
    ship_package(spark)
    rows = pages()
    path = new_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(3), path, segment=1000, capacity=capacity)
    out = warc.archived(spark, path, "page_id", "bigint")
    first = {}
    for i, _, t, _ in rows:
        b = (t or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(first.get(b, i), i)
    want = []
    for i, _, t, _ in rows:
        b = (t or "").encode()
        revisit = len(b) >= 100 and first.get(b, i) != i
        want.append((i if i is not None else -1, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", first[b] if revisit else None))
    assert sorted(((r.page_id if r.page_id is not None else -1, *tuple(r)[1:]) for r in out.collect()), key=str) == sorted(want, key=str)

    chunks: dict = {}
    for r in warc.read_archives(spark, path).collect():
        chunks.setdefault((r.record_key, r.record_id, r.record_type), []).append(r)
    assert all(len(r.chunk) <= 1000 for rs in chunks.values() for r in rs)
    for (key, _, kind), rs in chunks.items():
        if kind == "response" and key in ("107", "111", "109"):
            rs.sort(key=lambda r: r.chunk_no)
            body, so_far = next((t or "").encode() for i, _, t, _ in rows if str(i) == key), hashlib.sha256()
            assert b"".join(r.chunk for r in rs) == body and [r.is_last for r in rs].count(True) == 1 and rs[-1].is_last
            for n, r in enumerate(rs, 1):
                so_far.update(r.chunk)
                assert r.chunk_no == n and r.sha256_so_far == so_far.hexdigest()


def test_empty_table(spark):
    ship_package(spark)
    path = new_path(spark, "warc-empty")
    warc.write_archives(spark.createDataFrame([], PAGES), path)
    assert warc.archived(spark, path, "page_id", "bigint").count() == 0


def test_segments_end_between_characters():
    body = "aé日😀" * 50
    parts = [bytes(p) for p in warc.segments(body.encode(), 7)]
    assert b"".join(parts) == body.encode() and all(len(p) <= 7 and p.decode() for p in parts)
    assert [bytes(p) for p in warc.segments(b"", 7)] == [b""]
