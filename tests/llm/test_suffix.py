from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from aerokpi.llm import suffix_dedup as sd
from tests.llm import brute


def check(docs_of, rows, parts=3):
    got = sorted((tuple(r) for r in sd.cut_repeats(docs_of(rows, parts)).collect()), key=lambda r: (brute.order(r[0]), r[1:]))
    want = sorted(((i, n, g, s, hashlib.sha256(k).hexdigest()) for i, n, g, s, k in brute.repeats(rows)), key=lambda r: (brute.order(r[0]), r[1:]))
    assert got == want


def test_awkward_rows(docs_of, awkward):
    check(docs_of, awkward)


def test_passages_in_different_contexts(docs_of):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(rng.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rng.randrange(14, 90)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [text(rng.randrange(1, 30))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            cut = rng.randrange(len(p) // 2)
            parts += [p[cut : cut + rng.randrange(60, len(p) + 60)], text(rng.randrange(1, 20))]
        rows.append((rng.randrange(10**6), rng.choice([" ", ""]).join(parts)))
    check(docs_of, rows)
    check(docs_of, rows, parts=20)


def test_rows_without_ids_and_repeated_ids(docs_of):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passages = [text(150) for _ in range(5)]
    rows = [(rng.choice([None, None, None, 7, 9, i]), text(rng.randrange(60)) + rng.choice(passages) + text(rng.randrange(60))) for i in range(60)]
    rows += [(7, "x" + passages[0] + "y" + passages[0]), (None, passages[1] * 2)]
    check(docs_of, rows)


def test_hot_anchors_only_split_the_work(docs_of, monkeypatch):
    monkeypatch.setattr(sd, "SAMPLE", 1)
    monkeypatch.setattr(sd, "HOT_LEAST", 3)
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    common = text(260)
    rows = [(i, text(rng.randrange(150)) + common[rng.randrange(90) : 170 + rng.randrange(90)] + text(rng.randrange(150))) for i in range(50)]
    plain = docs_of(rows).selectExpr("doc_id as doc", "text")
    assert len(sd.hot_anchors(plain, 100)) > 0
    check(docs_of, rows)


@pytest.mark.parametrize("period", [1, 2, 7, 33, 64, 90])
def test_periodic_texts(docs_of, period):
    rng = random.Random(period)
    unit = "".join(rng.choice("ab") for _ in range(period))
    rows = [(1, unit * (400 // period)), (2, "x" + unit * (300 // period) + "y"), (3, unit[1:] + unit * (220 // period)), (4, unit * (99 // period))]
    check(docs_of, rows)


def test_two_letters(docs_of):
    rng = random.Random(8)
    base = "".join(rng.choice("ab") for _ in range(700))
    rows = [(i, base[rng.randrange(400) :][: rng.randrange(90, 420)]) for i in range(25)]
    check(docs_of, rows)


def test_text_form_and_empty_table(docs_of):
    p = "é" * 60
    out = {r.doc_id: r.text for r in sd.without_repeats(docs_of([(1, p + "a"), (2, "b" + p + "c"), (3, None)])).collect()}
    assert out[1] == brute.repeats([(1, p + "a")])[0][4].decode("utf-8", "ignore") and out[3] is None
    assert sd.without_repeats(docs_of([])).count() == 0 and sd.cut_repeats(docs_of([])).count() == 0
    assert sd.without_repeats(docs_of([(1, "a")])).columns == ["doc_id", "text", "key", "row"]


def test_a_copy_is_one_range_however_many_pieces_it_has(docs_of):
    rng = random.Random(5)
    copy = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    rows = [(i, copy) for i in range(30)]
    check(docs_of, rows, parts=2)
    ranges = sd.repeated_ranges(docs_of(rows, 2).selectExpr("doc_id as doc", "xxhash64(text) as mark", "text"), 100)
    # the first copy of the second task is compared with the first task's by bucket, piece by piece
    assert ranges.where("start = 0 and stop = 3000").count() == 28 and ranges.count() < 28 + 3000


def test_merged_ranges_cover_the_same_bytes():
    rng = random.Random(2)
    found = np.zeros(200, dtype=sd.PIECE)
    for name, top in (("doc", 3), ("row", 2), ("start", 4000), ("count", 60)):
        found[name] = [rng.randrange(1, top + 1) for _ in found]
    covered = lambda columns: {(d, r, b) for d, r, s, e in zip(*(c.tolist() for c in columns)) for b in range(s, e)}
    merged = sd.merged_ranges(found, 100)
    assert covered(merged) == covered(sd.ranges(found, 100)) and len(merged[0]) < 200
    assert len(sd.merged_ranges(found[:0], 100)[0]) == 0


def test_merge_gives_sorted_suffixes_and_common_prefixes():
    rng = random.Random(1)
    blocks = ["".join(rng.choice("xy") for _ in range(25)) for _ in range(3)]
    texts = ["".join(rng.choice(blocks) for _ in range(6)).encode() for _ in range(8)]
    shards = []
    for part in (texts[:3], texts[3:4], texts[4:]):
        records = np.zeros(len(part), dtype=sd.PIECE)
        records["count"] = 51
        shards.append(sd.Shard(records, b"".join(part), 100))
    source, position, prefix = sd.merge(shards, 4)
    seen = []
    for s, p in zip(source, position):
        shard = shards[s]
        text = ([texts[:3], texts[3:4], texts[4:]][s])[shard.piece[p]]
        w = shard.within[p]
        seen.append(tuple(text[i : i + 25] for i in range(w, len(text) - 24, 25))[:4])
    for a, b, n in zip(seen, seen[1:], prefix[1:]):
        common = next((j for j in range(4) if j >= len(a) or j >= len(b) or a[j] != b[j]), 4)
        if not (len(a) < 4 and a == b):  # equal ends fall apart or stand together without meaning
            assert n == common
