from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from aerokpi.llm import exact_dedup, line_dedup
from aerokpi.llm.heavy import frequent_keys, misra_gries
from tests.llm import brute


def key(r):
    return (brute.order(r[0]), r[4])


@pytest.mark.parametrize("capacity", [1, 2, 1024])
def test_exact_copies(docs_of, awkward, capacity):
    rows = awkward + [(100 + i, "hot  text") for i in range(60)] + [(99, "hot text")] + [(200 + i, f"own {i}") for i in range(20)]
    got = sorted((tuple(r) for r in exact_dedup.exact_copies(docs_of(rows), capacity=capacity).collect()), key=key)
    assert got == brute.exact(rows)


def test_drop_exact_copies_keeps_columns_and_one_of_each(docs_of):
    kept = exact_dedup.drop_exact_copies(docs_of([(1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, "")]))
    assert kept.columns == ["doc_id", "text", "key", "row"]
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4]


def test_empty_tables(docs_of):
    empty = docs_of([])
    assert exact_dedup.exact_copies(empty).count() == 0
    assert exact_dedup.drop_exact_copies(empty).count() == 0
    assert line_dedup.line_decisions(empty).count() == 0
    assert line_dedup.drop_repeated_lines(empty).count() == 0


def test_frequent_keys_are_a_bounded_superset(spark, docs_of):
    rng = random.Random(1)
    values = [1] * 400 + [2] * 200 + [rng.randrange(3, 10**6) for _ in range(400)]
    rng.shuffle(values)
    table = spark.createDataFrame([(v,) for v in values], "v long").repartition(5)
    found = {r.v: r.at_least for r in frequent_keys(table, "v", 1000, 9).collect()}
    assert {1, 2} <= set(found) and len(found) <= 10
    assert all(n <= values.count(v) for v, n in found.items())


def test_misra_gries_merge_keeps_the_capacity():
    import pandas as pd

    out = misra_gries(pd.Series({"a": 5, "b": 3}), pd.Series({"c": 4, "a": 1, "d": 1}), 2)
    assert len(out) <= 2 and out["a"] == 6 - 3


def near_lines():
    rng = random.Random(5)
    base = ["".join(rng.choice("abcd éß") for _ in range(rng.randrange(20, 34))) for _ in range(12)]
    out = []
    for line in base * 3:
        p, kind = rng.randrange(len(line)), rng.randrange(4)
        out.append([line, line[:p] + line[p + 1 :], line[:p] + "z" + line[p:], line[:p] + "y" + line[p + 1 :]][kind])
    out += ["aaaaaaaaaaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaaaaaaaaaa", "ab" * 12, "ba" * 12, "short", "x" * 3000, "x" * 2999 + "y"]
    rng.shuffle(out)
    return out


def test_lines_against_brute_force(docs_of, awkward):
    flat = near_lines()
    rows = awkward + [(1000 - i, "\n".join(flat[i * 4 : i * 4 + 4])) for i in range(len(flat) // 4)] + [(None, flat[0])]
    got = {(r.doc_id, r.line_no): (r.keep_id, r.keep_line) for r in line_dedup.line_decisions(docs_of(rows)).collect()}
    assert got == brute.lines(rows, line_dedup.MIN_CHARS)


def test_drop_repeated_lines(docs_of):
    a, b = "the first line is long enough", "the other line is long enough"
    out = line_dedup.drop_repeated_lines(docs_of([(1, f"{a}\nshort\n{b}"), (2, f"short\n{a}!\n{b}\nnew"), (3, None)]))
    assert out.columns == ["doc_id", "text", "key", "row"]
    assert {r.doc_id: r.text for r in out.collect()} == {1: f"{a}\nshort\n{b}", 2: "short\nnew", 3: None}


def test_short_lines_are_matched_when_equal(docs_of, awkward):
    flat = near_lines() + ["short", "shorx", "x", "nineteen characters", "nineteen characterss"]
    rows = awkward + [(1000 - i, "\n".join(flat[i * 3 : i * 3 + 3] + ["short", ""])) for i in range(len(flat) // 3)]
    taken = sorted(((brute.order(i), n), i, line) for i, text in rows for n, line in enumerate((text or "").split("\n")) if line)
    earliest = {}
    for at, i, line in taken:
        earliest.setdefault(line, (i, at[1]))
    want = {(i, at[1]): earliest[line] for at, i, line in taken} | brute.lines(rows, line_dedup.MIN_CHARS)
    got = {(r.doc_id, r.line_no): (r.keep_id, r.keep_line) for r in line_dedup.line_decisions(docs_of(rows), equal_from=1).collect()}
    assert got == want
    out = line_dedup.drop_repeated_lines(docs_of([(1, "a\nshort\n\n"), (2, "short\nshorx\n\na")]), equal_from=1)
    assert {r.doc_id: r.text for r in out.collect()} == {1: "a\nshort\n\n", 2: "shorx\n"}


def test_one_edit_between_long_lines(spark):
    rng = random.Random(3)
    base = "".join(rng.choice("abé") for _ in range(1500))
    others = [base, base[1:], base[:-1], base + "z", "z" + base, base[:700] + base[701:], base[:700] + "z" + base[701:], base[:700] + "zz" + base[702:],
              base[:700] + base[702:], base[:9] + "z" + base[10:700] + base[701:], base[::-1], "a" * 1500, ""]
    rows = spark.createDataFrame([(i, base, o) for i, o in enumerate(others)], "i int, a string, b string")
    got = {r.i: (r.x, r.y) for r in rows.select("i", line_dedup.within_one_edit(F.col("a"), F.col("b")).alias("x"), line_dedup.within_one_edit(F.col("b"), F.col("a")).alias("y")).collect()}
    assert got == {i: (brute.levenshtein_within_one(base, o),) * 2 for i, o in enumerate(others)}


def test_very_long_lines_within_one_edit(docs_of):
    import time

    line = "".join(random.Random(9).choice("abcdefgh ") for _ in range(64_000))
    rows = [(1, line), (2, line[:40_000] + "#" + line[40_001:]), (3, line[:-1]), (4, line[:100] + "##" + line[102:])]
    start = time.monotonic()
    got = {r.doc_id: r.keep_id for r in line_dedup.line_decisions(docs_of(rows)).collect()}
    print("seconds", time.monotonic() - start)
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_shared_keys_are_counted_before_the_shuffle(spark):
    keyed = spark.createDataFrame([(k, i) for i, k in enumerate([7] * 50 + [1, 2, 3, 3, -4])], "key long, h long").repartition(5)
    shared = line_dedup.shared_keys(keyed)
    plan = shared._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "Window" not in plan
    assert sorted(r.key for r in shared.collect()) == [3, 7]


def test_only_keys_and_variants_that_may_join_are_emitted(docs_of, monkeypatch):
    tables = {}

    def kept(df, name):
        tables[name] = df.localCheckpoint()
        return tables[name]

    monkeypatch.setattr(line_dedup, "written", kept)
    monkeypatch.setattr(line_dedup, "discard", lambda *_: None)
    line = "a line of forty characters for this testa"
    got = {r.doc_id: r.keep_id for r in line_dedup.line_decisions(docs_of([(1, line), (2, line[:-2] + "zz"), (3, "own " + line[::-1])])).collect()}
    assert got == {1: 1, 2: 2, 3: 3}
    # two equally long lines agree before their last half: no variants as the shorter line, none that meet a shorter line
    assert {(r.alike, r.longer) for r in tables["shared-keys"].collect()} == {(True, False)}
    assert {r.role for r in tables["variants"].select("role").distinct().collect()} == {"same"}


def test_variants_of_runs_are_emitted_once(spark):
    able = spark.createDataFrame([(1, 2, 0, 7, True, True, True, 0, 40, "a" * 20 + "b" * 20), (3, 4, 1, 7, True, True, False, 0, 39, "a" * 19 + "b" * 20)],
                                 "h long, h2 long, first int, key long, alike boolean, longer boolean, is_long boolean, part int, n int, line string")
    rows = line_dedup.variants(able).collect()
    assert sorted(r.role for r in rows) == ["long"] + ["same"] * 20 + ["short"]
    assert len({r.variant for r in rows if r.role != "same"}) == 1


def test_lines_where_the_number_of_parts_changes(docs_of):
    rng = random.Random(4)
    rows = []
    for i, n in enumerate([20, 21, 1022, 1023, 1024, 1025, 1536, 1537]):
        base = "".join(rng.choice("abcdé ") for _ in range(n))
        at = rng.randrange(n)
        rows += [(10 * i, base), (10 * i + 1, base[:at] + base[at + 1 :]), (10 * i + 2, base[:at] + "#" + base[at:]), (10 * i + 3, base[:at] + "##" + base[at + 2 :])]
    got = {(r.doc_id, r.line_no): (r.keep_id, r.keep_line) for r in line_dedup.line_decisions(docs_of(rows)).collect()}
    assert got == brute.lines(rows, line_dedup.MIN_CHARS)
