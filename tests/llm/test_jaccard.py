from __future__ import annotations

import random

import pytest

from aerokpi.llm import jaccard
from aerokpi.llm.components import components
from tests.llm import brute


def mutated(seed, groups, copies, words, rate):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(words)]
        for _ in range(copies):
            rows.append(" ".join(f"m{rng.randrange(10**6)}" if rng.random() < rate else w for w in base))
    rng.shuffle(rows)
    return [(3 * i + 1, t) for i, t in enumerate(rows)]


def check(docs_of, rows, **options):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_copies(docs_of(rows), **options).collect()), key=lambda r: (brute.order(r[0]), r[1]))
    assert got == sorted(brute.near(rows, **options), key=lambda r: (brute.order(r[0]), r[1]))


def test_awkward_rows(docs_of, awkward):
    check(docs_of, awkward)


@pytest.mark.parametrize("seed, groups, copies, words, rate", [(1, 6, 9, 120, 0.012), (2, 2, 40, 90, 0.025)])
def test_mutated_copies(docs_of, seed, groups, copies, words, rate):
    check(docs_of, mutated(seed, groups, copies, words, rate))


def test_single_word_shingles_with_common_words(docs_of):
    rng = random.Random(9)  # sets that overlap everywhere, at all similarities
    rows = [(i, " ".join({f"c{rng.randrange(14)}" for _ in range(rng.randrange(1, 16))})) for i in range(120)]
    check(docs_of, rows, width=1)


def test_a_chain_of_links_is_one_component(docs_of):
    words = [f"w{i}" for i in range(160)]
    rows = [(50 - i, " ".join(words[3 * i : 3 * i + 40])) for i in range(12)]
    check(docs_of, rows)


def test_sizes_around_the_first_filter(docs_of):
    rng = random.Random(4)
    rows = []
    for n in (1, 2, 4, 5, 6, 60, 64, 66, 72, 80, 84, 100):
        base = [f"w{rng.randrange(10**6)}" for _ in range(n + 4)]
        rows += [" ".join(base), " ".join(base + [f"x{n}"] * (n // 6)), " ".join(base[: n + 4 - n // 7])]
    check(docs_of, list(enumerate(rows)))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_task_ranks_a_whole_region(spark, tmp_path):
    rng = random.Random(8)
    rows = [(int(i % 9 == 0), i, rng.randrange(3), rng.randrange(40) / 8) for i in range(6000)]
    path = str(tmp_path / "members")
    spark.createDataFrame(rows, "region long, x long, size int, centre double").write.parquet(path)
    members = spark.read.parquet(path)
    for pivots in (1, 256, 1024):
        out = jaccard.first_of_regions(members, pivots)
        want = set()
        for region in (0, 1):
            best = sorted((size, -centre, x) for r, x, size, centre in rows if r == region)[:pivots]
            want |= {(region, x, i + 1) for i, (_, _, x) in enumerate(best)}
        assert {(r.region, r.x, r["rank"]) for r in out.collect()} == want
        below = plan_of(out).split("hashpartitioning(region", 1)[1]  # what is cut before regions are gathered
        assert f"{pivots}, Partial" in below if pivots <= jaccard.WINDOW_LIMIT else f"<= {pivots}" in below


def test_empty_table_and_columns(docs_of):
    assert jaccard.near_copies(docs_of([])).count() == 0
    kept = jaccard.drop_near_copies(docs_of([(2, "a b c d e f g"), (1, "A b c  d e f g"), (3, "z")]))
    assert kept.columns == ["doc_id", "text", "key", "row"]
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_components_of_a_long_path(spark):
    n = 70
    ids = list(range(n))
    random.Random(2).shuffle(ids)
    links = spark.createDataFrame([(ids[i], ids[i + 1]) for i in range(n - 1)] + [(900, 901)], "a long, b long")
    labels = {r.node: r.label for r in components(links).collect()}
    assert {labels[i] for i in range(n)} == {0} and labels[901] == 900
