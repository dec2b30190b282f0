"""The registered queries of this subpackage: op<N>_<name>(spark, sf_dir) with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerokpi.llm.common import new_path, read_table, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return run


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@register
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    from aerokpi.llm.packing import pack_documents

    return pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


@register
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision on every document: which equal text stays."""
    from aerokpi.llm.exact_dedup import exact_copies

    return exact_copies(read_table(spark, sf_dir, "documents"))


ORACLE["op3_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256,
         length(coalesce(text, '')) AS points
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id IS NOT DISTINCT FROM
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST) AS kept,
       text_sha256
FROM d
"""


@register
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digests of every document's BPE ids, and of what they decode to."""
    from aerokpi.llm.bpe import encoded

    return encoded(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


@register
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    from aerokpi.llm.language_id import identify

    return identify(read_table(spark, sf_dir, "documents"))


@register
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all pages, written to WARC archives and read back."""
    from aerokpi.llm.warc import archived, write_archives

    pages = read_table(spark, sf_dir, "pages")
    path = new_path(spark, "warc")
    write_archives(pages, path)
    return archived(spark, path, "page_id", pages.schema["page_id"].dataType.simpleString())


ORACLE["op6_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""


@register
def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all embeddings for every twentieth."""
    from aerokpi.llm.ann import search

    rows = read_table(spark, sf_dir, "embeddings")
    return search(rows, rows.where(F.col("vec_id") % 20 == 0), 20)


@register
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weight of every document and whether resampling keeps it."""
    from aerokpi.llm.resampling import resample

    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@register
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under word-shingle Jaccard links."""
    from aerokpi.llm.jaccard import near_copies

    return near_copies(read_table(spark, sf_dir, "documents"))


@register
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated strings of 100 bytes."""
    from aerokpi.llm.suffix_dedup import cut_repeats

    return cut_repeats(read_table(spark, sf_dir, "documents"))


@register
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision on every line that isn't empty: the earliest equal line or, from 20 characters on, within one edit."""
    from aerokpi.llm.line_dedup import line_decisions

    return line_decisions(read_table(spark, sf_dir, "documents"), equal_from=1)


# all deletions of all lines, without the operator's parts
ORACLE["op4_line_dedup"] = """
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(range(len(parts))) AS line_no, unnest(parts) AS line FROM s),
m AS (SELECT doc_id, line_no, line, {'d': doc_id, 'l': line_no} AS place FROM l WHERE length(line) >= 1),
c AS (SELECT line, length(line) AS n, min(place) AS first FROM m GROUP BY line),
p AS (SELECT line, n, first, unnest(range(1, n + 1)) AS i FROM c WHERE n >= 20),
v AS (SELECT line, n, first, i, hash(left(line, i - 1) || substr(line, i + 1)) AS h FROM p),
g AS (SELECT n, i, h, min(first) AS near FROM v GROUP BY n, i, h HAVING count(*) > 1),
x AS (
  SELECT v.line, g.near FROM v JOIN g ON v.n = g.n AND v.i = g.i AND v.h = g.h
  UNION ALL SELECT v.line, c.first FROM v JOIN c ON c.n >= 20 AND c.n = v.n - 1 AND hash(c.line) = v.h
  UNION ALL SELECT c.line, v.first FROM v JOIN c ON c.n >= 20 AND c.n = v.n - 1 AND hash(c.line) = v.h
  UNION ALL SELECT line, first FROM c),
k AS (SELECT line, min(near) AS keep FROM x GROUP BY line)
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, keep.d AS keep_id, CAST(keep.l AS BIGINT) AS keep_line, place = keep AS kept
FROM m JOIN k USING (line)
"""


@register
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, checked again after tampering."""
    from aerokpi.llm.merkle import folded, leaf_digest, manifest, siblings

    fields = ("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0,
                      leaf_digest(*[F.col(c) + 1 if c == "n_chars" else F.col(c) for c in fields]))
    found = manifest(read_table(spark, sf_dir, "documents"), "doc_id", "lang", fields, {"tampered": tampered})
    return found.withColumn("folded_root", folded(F.col("path"), F.coalesce("tampered", "leaf"))).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")).cast("binary"), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: CRC-32 of a list of byte values, bit by bit.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes}), lambda c, b: list_reduce(
    list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda d, z: xor(d >> 1, 3988292384 * (d & 1)))), 4294967295)"""


def _field(name: str) -> str:
    return f"coalesce(strlen(CAST({name} AS VARCHAR)) || ':' || CAST({name} AS VARCHAR), '-')"


_LEAF = "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang")) + " || {n_chars} || " + _field("text") + ")"

ORACLE["op11_merkle"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {_LEAF.format(n_chars=_field("n_chars"))} AS leaf, {_LEAF.format(n_chars=_field("(n_chars + 1)"))} AS changed,
         [CAST(ascii(c) AS BIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')] AS digits
  FROM documents),
l AS (
  SELECT doc_id, lang, leaf, CASE WHEN {_CRC32.format(bytes="digits")} % 7 = 0 THEN changed ELSE leaf END AS shown,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS LAST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
  FROM d),
tree AS (
  SELECT lang, 0 AS level, pos, leaf AS h, n FROM l
  UNION ALL
  SELECT lang, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM tree WHERE n > 1 GROUP BY lang, level, pos // 2),
subroots AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
forest AS (
  SELECT 0 AS level, pos, h, n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM forest WHERE n > 1 GROUP BY level, pos // 2),
path AS (
  SELECT doc_id, lang, leaf, pos AS start, 0 AS level, pos, n, '' AS proof, shown AS f FROM l
  UNION ALL
  SELECT p.doc_id, p.lang, p.leaf, p.start, p.level + 1, p.pos // 2, (p.n + 1) // 2, p.proof || coalesce(t.h, ''),
         sha256(CASE WHEN p.pos % 2 = 1 THEN t.h ELSE '' END || p.f || CASE WHEN p.pos % 2 = 0 THEN coalesce(t.h, '') ELSE '' END)
  FROM path p LEFT JOIN tree t ON t.lang IS NOT DISTINCT FROM p.lang AND t.level = p.level AND t.pos = xor(p.pos, 1)
  WHERE p.n > 1),
upper AS (
  SELECT p.doc_id, p.leaf, p.start, p.lang, s.h AS subroot, 0 AS level, s.pos, s.n, p.proof, p.f
  FROM path p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang WHERE p.n = 1
  UNION ALL
  SELECT p.doc_id, p.leaf, p.start, p.lang, p.subroot, p.level + 1, p.pos // 2, (p.n + 1) // 2, p.proof || coalesce(t.h, ''),
         sha256(CASE WHEN p.pos % 2 = 1 THEN t.h ELSE '' END || p.f || CASE WHEN p.pos % 2 = 0 THEN coalesce(t.h, '') ELSE '' END)
  FROM upper p LEFT JOIN forest t ON t.level = p.level AND t.pos = xor(p.pos, 1)
  WHERE p.n > 1)
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = h AS verified
FROM upper JOIN (SELECT h FROM forest WHERE n = 1) AS r ON upper.n = 1
"""


@register
def op12_target_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document, drawn towards the benchmark texts."""
    from aerokpi.llm.target_sampling import resample_to_target

    return resample_to_target(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_WORDS = r"""SELECT {key}, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM {table}"""

# gains are summed feature by feature, without bit planes
ORACLE["op12_target_sampling"] = f"""
WITH w AS ({_WORDS.format(key="doc_id", table="documents")}),
b AS ({_WORDS.format(key="item_id", table="benchmark")}),
x AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM w UNION SELECT word FROM b)),
k AS (SELECT word, {_CRC32.format(bytes="[CAST('0x' || substr(h, 2 * i - 1, 2) AS BIGINT) FOR i IN range(1, len(h) // 2 + 1)]")} % 10000 AS bucket FROM x),
s AS (SELECT bucket, count(*) AS s FROM w JOIN k USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN k USING (word) GROUP BY bucket),
n AS (SELECT (SELECT count(*) FROM w)::DOUBLE AS big_s, (SELECT count(*) FROM b)::DOUBLE AS big_t),
g AS (
  SELECT s.bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (big_s + 10000) / ((s + 1)::DOUBLE * (big_t + 10000)))) AS gain
  FROM s LEFT JOIN t USING (bucket) CROSS JOIN n),
d AS (
  SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight
  FROM w JOIN k USING (word) JOIN g USING (bucket) GROUP BY doc_id),
e AS (
  SELECT o.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || o.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents AS o LEFT JOIN d ON o.doc_id = d.doc_id),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM e WHERE n_features >= 20)
SELECT e.doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN place <= n * 10 // 100 THEN place END AS rank
FROM e LEFT JOIN r ON e.doc_id = r.doc_id
"""


@register
def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MinHash fingerprints of all documents and their edited texts, and the near copies found by their bands."""
    from aerokpi.llm.fingerprints import fingerprints, near_copies_by_bands

    docs = read_table(spark, sf_dir, "documents")
    return near_copies_by_bands(docs, fingerprints(docs)).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "near_id")
