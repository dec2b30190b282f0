from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerokpi.llm import ann, language_id, resampling
from aerokpi.llm.units import chunks

SF = "/root/testdata/sf0.01"


def brute_weights(rows, good, buckets):
    """{id: mean log ratio at the reference length}, document by document."""
    def features(text):
        return [f for _, _, d, o in chunks(pa.array([text or ""])) for f in resampling.features(d, o, buckets)[0].tolist()]

    raw, target = [0] * buckets, [0] * buckets
    for i, text in rows:
        for f in features(text):
            raw[f] += 1
            target[f] += i in good
    ratio = [0.0] * buckets
    for lo, hi in ((0, buckets // 2), (buckets // 2, buckets)):
        r, t = sum(raw[lo:hi]), sum(target[lo:hi])
        if t:
            half = hi - lo
            for b in range(lo, hi):
                p = (raw[b] + resampling.SMOOTHING * r / half) / (r + resampling.SMOOTHING * r)
                q = (target[b] + resampling.SMOOTHING * t / half) / (t + resampling.SMOOTHING * t)
                ratio[b] = math.log(q / p)
    return {i: resampling.REFERENCE_LENGTH * sum(ratio[f] for f in features(t)) / max(1, len(features(t))) for i, t in rows}


def test_weights_and_top_k_against_brute_force(spark, docs_of):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("the of and to in on by for".split()) + rng.choice(["", "", "***"][: 3 if i % 4 == 0 else 2]) for _ in range(rng.randrange(5, 60)))) for i in range(120)]
    rows += [(200, None), (201, "")]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(0, 80)], "doc_id long, quality int, toxic int")
    good = {i for i in range(80) if i % 4}
    out = {r.doc_id: r for r in resampling.resample(docs_of(rows), labels, buckets=1 << 10).collect()}
    want = brute_weights(rows, good, 1 << 10)
    assert all(out[i].log_weight == pytest.approx(want[i], abs=1e-9) for i in want)
    k = round(len(rows) * 0.75)
    best = sorted(out, key=lambda i: -out[i].key)[:k]
    assert {i for i in out if out[i].kept} == set(best)
    noise = [r.key - r.log_weight for r in out.values()]
    assert 0.2 < np.mean(noise) < 1.0  # a standard Gumbel's mean is 0.577


def test_resampling_rejects_junk_and_keeps_clean(spark):
    from aerokpi.llm.common import ship_package

    ship_package(spark)
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    train = labels.where("crc32(cast(doc_id as string)) % 2 = 0")
    rest = labels.where("crc32(cast(doc_id as string)) % 2 = 1")
    out = resampling.resample(docs, train).join(rest, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in out}
    assert kept[1] > 0.9 and kept[0] < 0.15  # the share kept is estimated from 200 labels


def test_resampling_edge_cases(spark, docs_of, awkward):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.kept and r.log_weight == 0 for r in resampling.resample(docs_of(awkward), none).collect())
    some = spark.createDataFrame([(4, 1), (4, 0), (5, None), (None, 1), (10, 0)], "doc_id long, quality int")
    assert resampling.resample(docs_of(awkward), some).count() == len(awkward)
    assert resampling.resample(docs_of([]), some).count() == 0
    assert resampling.keep_resampled(docs_of(awkward), none).columns == ["doc_id", "text", "key", "row"]
    assert sorted(map(str, resampling.keep_resampled(docs_of(awkward), none).collect())) == sorted(map(str, docs_of(awkward).collect()))


def test_kth_largest(spark):
    rng = random.Random(3)
    values = [rng.randrange(-(2**62), 2**62) for _ in range(200)] + [5, 5, 5, -1, 0]
    table = spark.createDataFrame([(v,) for v in values], "v long")
    ordered = sorted(values, reverse=True)
    for k in (1, 2, 57, 100, len(values)):
        assert resampling.kth_largest(table, "v", k) == ordered[k - 1]
    assert resampling.kth_largest(table, "v", 0) is None


def test_language_held_out_accuracy(spark):
    from aerokpi.llm.common import ship_package

    ship_package(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out.held_out]
    assert len(held) > 200 and (held.lang == held.lang_pred).mean() > 0.98
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) == h for i, h in zip(out.doc_id, out.held_out))
    assert out.score.between(0, 1).all()


def test_language_backs_off_to_shorter_grams():
    rows = [(0, "the", "en", 9), (0, "der", "de", 9), (4, " the", "en", 5), (3, "sch", "de", 5), (1, "é", "fr", 5), (0, "une", "fr", 3)]
    model = language_id.WordFirstModel.from_counts(rows)
    best = lambda w: model.languages[int(np.argmax(model.word_scores(w)))]
    assert (best("the"), best("thex"), best("mischa"), best("é")) == ("en", "en", "de", "fr")
    assert model.word_scores("日本") is None


def test_language_model_knows_every_word_of_every_language(docs_of):
    rows = [(i, f"common word{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(300)] + [(1000, "seldom nur einmal")]
    docs = docs_of(rows).withColumn("lang", F.when(F.col("doc_id") == 1000, "rare").otherwise("big"))
    whole = language_id.fit(docs, "lang", "text", F.col("doc_id"))
    assert set(whole.tables[0][0]) == {w for _, t in rows for w in t.split()}
    assert "inma" in whole.tables[4][0] and len(whole.tables[0][0]) == len(whole.tables[0][1])
    for key in range(4):
        part = language_id.fit(docs, "lang", "text", F.col("doc_id") + key, max_docs=20)
        assert part.languages == ["big", "rare"] and 3 < len(part.tables[0][0]) < 60


def test_language_sample_beside_clashing_columns(docs_of):
    docs = docs_of([(i, f"wort{i % 7} und satz") for i in range(60)]).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "de").otherwise("en"))
    for name in ("learned_lang", "last_place", "place", "n", "kind", "item"):
        docs = docs.withColumn(name, F.lit(1))
    assert language_id.identify(docs, max_docs=20).count() == 60


def test_language_quotas():
    assert language_id.quotas({"a": 1000, "b": 3, "c": 500}, 203) == {"a": 100, "b": 3, "c": 100}
    assert language_id.quotas({"a": 9, "b": 2}, 6) == {"a": 4, "b": 2}


def test_language_edge_cases(spark, docs_of, awkward):
    docs = docs_of(awkward).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "xx").when(F.col("doc_id") % 3 == 0, "yy"))
    out = {(r.doc_id, r.lang_pred) for r in language_id.identify(docs).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= out
    no_language = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(no_language) == len(awkward) and {r.lang_pred for r in no_language} == {"und"}
    assert language_id.identify(docs.limit(0)).count() == 0


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("rank", T.IntegerType())])


def test_ann_recall_and_exact_scores(spark):
    from aerokpi.llm.common import ship_package

    ship_package(spark)
    rng = np.random.default_rng(1)
    data = rng.standard_normal((3000, 32)).astype(np.float32)
    data[100:160] = data[100]  # ties
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(data)], VECTORS).repartition(4)
    got = ann.search(table, table.where("vec_id % 20 = 0"), 20, chunk_bytes=700 * 32 * 8, block_bytes=64 * 32 * 8).toPandas()
    exact = data.astype(np.float64)
    hits = 0
    for q, rows in got.groupby("query_id"):
        rows = rows.sort_values("rank")
        score = exact @ exact[q]
        score[q] = -np.inf
        best = np.lexsort((np.arange(len(data)), -score))[:20]
        hits += len(set(best) & set(rows.vec_id))
        assert list(rows["rank"]) == list(range(1, 21))
        assert np.allclose(rows.score, score[rows.vec_id], rtol=0, atol=1e-12)
        assert list(rows.vec_id) == [i for _, i in sorted(zip(-rows.score, rows.vec_id))]
    assert got.query_id.nunique() == 150 and hits / (150 * 20) > 0.99


def test_ann_edge_cases(spark):
    from aerokpi.llm.common import ship_package

    ship_package(spark)
    nan = float("nan")
    rows = [(0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [None, 1.0], 1), (None, [1.0, 1.0], 1),
            (6, [1.0, 0.0], 1), (6, [1.0, 0.0], 1), (7, [1.0], 1), (20, [2.0, 0.0], 1), (40, [0.0, 0.0], 1), (8, [float("inf"), 0.0], 1)]
    table = spark.createDataFrame(rows, VECTORS)
    got = [tuple(r) for r in ann.search(table, table.where("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20, 2.0), (0, 2, 6, 1.0), (0, 3, 6, 1.0), (0, 4, 1, 0.5), (20, 1, 0, 2.0), (20, 2, 6, 2.0), (20, 3, 6, 2.0), (20, 4, 1, 1.0)]
    assert ann.search(table.limit(0), table, 20).count() == 0
    assert ann.search(table, table.limit(0), 20).count() == 0


def test_ann_searches_each_length_among_its_own(spark):
    from aerokpi.llm.common import ship_package

    ship_package(spark)
    rng = np.random.default_rng(3)
    sizes = [2, 3, 70, 130]
    rows = [(i, rng.standard_normal(sizes[i % 4]).astype(np.float32).tolist(), 0) for i in range(400)]
    fields = T.StructType([*VECTORS.fields[:2], *[T.StructField(c, T.IntegerType()) for c in ("id", "v", "dim", "chunk", "code", "score")]])
    table = spark.createDataFrame([(*r[:2], 0, 0, 0, 0, 0, 0) for r in rows], fields)
    got = ann.search(table, table.where("vec_id % 5 = 0"), 5, chunk_bytes=20_000, block_bytes=9_000).toPandas()
    assert sorted(got.query_id.unique()) == list(range(0, 400, 5))
    hits = 0
    for q, found in got.groupby("query_id"):
        exact = sorted((-float(np.dot(np.float64(v), np.float64(rows[q][1]))), i) for i, v, _ in rows if i % 4 == q % 4 and i != q)
        assert all(i % 4 == q % 4 for i in found.vec_id) and len(found) == 5
        hits += len({i for _, i in exact[:5]} & set(found.vec_id))
    assert hits >= 0.99 * 400
    as_doubles = table.withColumn("embedding", table["embedding"].cast("array<double>")).withColumn("vec_id", table["vec_id"].cast("string"))
    again = ann.search(as_doubles, as_doubles.where("vec_id = '10'"), 5).toPandas()
    assert set(again.vec_id) == {str(i) for i in got[got.query_id == 10].vec_id}


def test_one_bit_bounds_hold():
    rng = np.random.default_rng(5)
    data, queries = rng.standard_normal((500, 48)), rng.standard_normal((20, 48))
    codes, norms, agree = ann.one_bit_codes(data)
    assert codes.shape == (500, 1) and codes.dtype == np.uint64
    guess, bound = ann.estimates(codes, norms, agree, queries)
    assert (np.abs(guess - queries @ data.T) > bound).mean() < 0.01


@pytest.mark.parametrize("dim", [1, 7, 64, 65, 200])
def test_products_from_packed_bits_equal_those_of_signs(dim):
    rng = np.random.default_rng(dim)
    data, queries = rng.standard_normal((50, dim)), rng.standard_normal((9, dim))
    codes, norms, agree = ann.one_bit_codes(data)
    guess, bound = ann.estimates(codes, norms, agree, queries)
    signs = np.where(data @ ann.rotation(dim) > 0, 1.0, -1.0)
    planes, low, step, lost = ann.rounded_queries(queries)
    plain = (queries @ ann.rotation(dim)) @ signs.T * (norms / agree / np.sqrt(dim))
    assert planes.shape == (ann.QUERY_BITS, 9, -(-dim // 64)) and (lost <= dim * step / 2 + 1e-9).all()
    assert (np.abs(guess - plain) <= lost[:, None] * (norms / agree / np.sqrt(dim)) + 1e-9).all()
