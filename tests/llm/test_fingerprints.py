"""Fingerprints, edited texts and near copies by bands."""

from __future__ import annotations

import hashlib
import random
import time

import numpy as np
from pyspark.sql import functions as F

from aerokpi.llm import common
from aerokpi.llm import fingerprints as module
from aerokpi.llm.fingerprints import BANDS, DIGITS, ROWS, fingerprints, near_copies_by_bands
from tests.llm import brute

WORDS = [f"w{i}" for i in range(400)]


def places(print_):
    return [print_[i : i + DIGITS] for i in range(0, len(print_), DIGITS)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_edited_texts_and_likeness(spark, docs_of, awkward):
    rows = [(i, t) for k, (i, t) in enumerate(awkward) if i not in {j for j, _ in awkward[:k]}]
    want = brute.edited(rows)
    out = {r.doc_id: r for r in fingerprints(docs_of(rows, 5)).collect()}
    assert set(out) == set(want)
    ordered = sorted(want, key=brute.order)
    for k, i in enumerate(ordered):
        r, text = out[i], dict(rows)[i] or ""
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(want[i].encode()).hexdigest())
        following = out[ordered[(k + 1) % len(ordered)]]
        for other, near in ((r.edited_fingerprint, r.near_edited), (following.fingerprint, r.near_next)):
            same = np.mean([a == b for a, b in zip(places(r.fingerprint), places(other))])
            empty = {x == "f" * len(x) for x in (r.fingerprint, other)}
            assert near == (same if len(empty) == 1 else 0.0)
    assert all(len(places(r.fingerprint)) == BANDS * ROWS for r in out.values())


def test_equal_texts_have_equal_fingerprints_and_likeness_estimates_similarity(spark, docs_of):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        text = prose(rng, 300).split()
        rows += [(4 * i, " ".join(text)), (4 * i + 1, " ".join(text)), (4 * i + 2, " ".join(text[:150] + [f"x{i}"] + text[150:])), (4 * i + 3, " ".join(text[: 20 + 4 * i]))]
    out = {r.doc_id: r for r in fingerprints(docs_of(rows)).collect()}
    errors = []
    for i, text in rows:
        if i % 4 == 0:
            assert out[i].fingerprint == out[i + 1].fingerprint and out[i].near_next == 1.0
        if i % 4 < 3:
            a, b = brute.shingles(text), brute.shingles(dict(rows)[i + 1])
            errors.append(abs(out[i].near_next - len(a & b) / len(a | b)))
    assert np.mean(errors) < 0.04 and max(errors) < 0.2


def test_near_copies_equal_brute_force(spark, docs_of, awkward):
    rng = random.Random(7)
    rows = list(awkward)
    for c in range(6):  # chains and clusters of variants, some of them linked through others only
        base = prose(rng, 120 + 40 * c).split()
        for k in range(12):
            words = list(base)
            for _ in range(k % 5):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            rows.append((100 + 20 * c + k, " ".join(words)))
    docs = docs_of(rows)
    got = near_copies_by_bands(docs, fingerprints(docs)).select("doc_id", "n_shingles", "near_id").collect()
    want = [(i, n, i if c is None else c) for i, n, c in brute.near(rows)]
    key = lambda r: (brute.order(r[0]), r[1], brute.order(r[2]))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_one_document_and_none(spark, docs_of):
    one = docs_of([(1, "abcdef")])
    r = near_copies_by_bands(one, fingerprints(one)).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and r.near_next == 1.0 and r.near_id == 1
    none = docs_of([])
    assert near_copies_by_bands(none, fingerprints(none)).collect() == []
    same = docs_of([(None, "a b c d e f")] * 3 + [(2, None)])
    assert sorted(str(r.near_id) for r in near_copies_by_bands(same, fingerprints(same)).collect()) == ["2", "None", "None", "None"]


def test_prints_are_written_once_and_as_bytes(spark, docs_of, monkeypatch):
    tables = []

    def recorded(df, name):
        out = common.written(df, name)
        tables.append((out.count(), {f.name: f.dataType.simpleString() for f in out.schema.fields}))
        return out

    monkeypatch.setattr(module, "written", recorded)
    rng = random.Random(11)
    out = fingerprints(docs_of([(i, prose(rng, 30)) for i in range(200)], 4))
    prints = [(n, kinds) for n, kinds in tables if "edited_fingerprint" in kinds]
    assert out.count() == 200 and sum(n for n, _ in prints) < 300  # all rows, and the last of each range again
    assert {kinds[c] for _, kinds in prints for c in ("fingerprint", "edited_fingerprint")} == {"binary"}
    assert all(len(r.fingerprint) == len(r.edited_fingerprint) == BANDS * ROWS * DIGITS and r.fingerprint == r.fingerprint.lower() for r in out.collect())


def test_tidy_tables_leave_no_shuffle_files(spark, docs_of):
    docs_of([])  # ships the package
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    setting = spark.conf.get(common._FILE_CLEANUP)
    before = files()
    out = common.written(spark.range(20000).groupBy(F.xxhash64("id").alias("h")).count(), "tidy", tidy=True)
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and out.count() == 20000 and spark.conf.get(common._FILE_CLEANUP) == setting


def test_sketches_bound_what_sets_share(spark):
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**63, k, dtype=np.uint64)) for k in (1, 40, 300, 300, 5000)]
    sets += [np.unique(np.concatenate((sets[2][:k], sets[3][k:]))) for k in (0, 60, 150, 290, 300)]
    h, r = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    columns = [c.to_pylist() for c in module.sketches(h, r, len(sets))]
    rows = [(i, *[c[i] for c in columns]) for i in range(len(sets))]
    left, right = (spark.createDataFrame([tuple(x) for x in rows], ", ".join(f"{p}_{c} long" for c in ["id", *module._SKETCH])) for p in "ab")
    bounds = {(x.a_id, x.b_id): x.most for x in left.crossJoin(right).select("a_id", "b_id", module.most_shared("a_", "b_").alias("most")).collect()}
    for (i, j), most in bounds.items():
        assert len(np.intersect1d(sets[i], sets[j])) <= most <= min(len(sets[i]), len(sets[j]))
    assert bounds[2, 3] < 150  # 300 shingles each, none in common: no pair of similarity 0.8
