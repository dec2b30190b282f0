"""Line deduplication by a deletion-neighbourhood join (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerokpi.llm.common import discard, written

#: Shorter lines take no part in one-edit matching, and in none unless `equal_from` admits them.
MIN_CHARS = 20
#: Parts of a line, or as many as make parts of up to PART_CHARS characters. One edit lies in
#: one part, so near lines agree in all the others; only that part is varied.
PARTS = 2
PART_CHARS = 512


def lines_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc, line_no from 0, line) of the lines that take part."""
    return docs.select("doc", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "line")) \
        .where(F.length("line") >= min_chars)


def parts_of(full: Column) -> Column:
    """Parts of a line of `full` characters."""
    return F.greatest(F.lit(PARTS), F.ceil(full / PART_CHARS).cast("int"))


def edge_of(full: Column, j: Column) -> Column:
    """Where part j of a line of `full` characters begins."""
    return F.floor(full * j.cast("long") / parts_of(full)).cast("int")


def part_keys(line: Column, n: Column) -> Column:
    """For each part, the hash of everything around it: first of a line as the longer (or
    equally long) one of a pair, then as the one that is a character shorter. The parts are
    those of the longer line, so both lines of a near pair have a key in common.

    Lambda functions are interpreted for every row, so lines with PARTS parts go without."""
    def around(full: Column) -> Callable[[Column], Column]:
        return lambda j: F.xxhash64(full, j, F.left(line, edge_of(full, j)), F.right(line, full - edge_of(full, j + 1)))

    few = F.array(*[around(full)(F.lit(j)) for full in (n, n + 1) for j in range(PARTS)])
    many = F.concat(*[F.transform(F.sequence(F.lit(0), parts_of(full) - 1), around(full)) for full in (n, n + 1)])
    return F.when(n < PARTS * PART_CHARS, few).otherwise(many)


def keyed_parts(classes: DataFrame) -> DataFrame:
    """`classes` (with `n` and `keys` of `part_keys`) by key: key, part and is_long instead of `keys`."""
    longer = parts_of(F.col("n"))
    return classes.select("*", F.posexplode("keys").alias("place", "key")).withColumn("is_long", F.col("place") < longer) \
        .withColumn("part", F.col("place") - F.when(F.col("is_long"), 0).otherwise(longer)).drop("keys", "place")


def variants(able: DataFrame) -> DataFrame:
    """(h, h2, first, variant, role): hashed keys of the variants of `line` within one edit of
    its `part`, for the longer line of a pair each deletion: with its place where `alike` (a
    substitution joins two equal deletions at the same place) and without where `longer` (an
    insertion joins a deletion to the shorter line); for the shorter line, the line itself.
    Deletions from a run of one character are equal, so the last of the run stands for it."""
    full = F.when(F.col("is_long"), F.col("n")).otherwise(F.col("n") + 1)
    start, end = edge_of(full, F.col("part")), edge_of(full, F.col("part") + 1)
    rows = able.select("h", "h2", "first", "key", "alike", "longer", "is_long",
                       F.substring("line", start + 1, F.when(F.col("is_long"), end - start).otherwise(end - start - 1)).alias("inner"))
    i, inner = F.col("i"), F.col("inner")
    without = F.concat(F.left(inner, i - 1), F.substring(inner, i + 1, F.length(inner)))
    deleted = rows.where("is_long").withColumn("i", F.explode(F.sequence(F.lit(1), F.length("inner"))))
    same = deleted.where("alike").select("h", "h2", "first", F.xxhash64("key", i, without).alias("variant"), F.lit("same").alias("role"))
    ends_run = (i == F.length(inner)) | (F.substring(inner, i, F.lit(1)) != F.substring(inner, i + 1, F.lit(1)))
    long = deleted.where(F.col("longer") & ends_run).select("h", "h2", "first", F.xxhash64("key", F.lit(0), without).alias("variant"), F.lit("long").alias("role"))
    short = rows.where("NOT is_long").select("h", "h2", "first", F.xxhash64("key", F.lit(0), inner).alias("variant"), F.lit("short").alias("role"))
    return same.unionByName(long).unionByName(short)


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether two lines are equal or one edit apart. `levenshtein` takes time in the square of
    the length even when bounded; of long lines the common prefix is found by bisection, and
    what follows the first difference is compared."""
    n, m = F.length(a), F.length(b)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(30))])
    prefix = F.aggregate(steps, F.lit(0), lambda p, s: F.when((p + s <= F.least(n, m)) & (F.left(a, p + s) == F.left(b, p + s)), p + s).otherwise(p))

    def tails_agree(p: Column) -> Column:
        return F.right(a, n - p - F.when(n >= m, 1).otherwise(0)) == F.right(b, m - p - F.when(m >= n, 1).otherwise(0))

    apart = F.transform(F.array(prefix), tails_agree)[0] & (F.abs(n - m) <= 1)
    return F.when(F.greatest(n, m) <= PARTS * PART_CHARS, F.levenshtein(a, b, 1) >= 0).otherwise(apart)


def shared_keys(keyed: DataFrame, *more: Column) -> DataFrame:
    """The keys of several rows with their number `n` and other aggregates, counted where the
    rows lie before they are shuffled."""
    return keyed.groupBy("key").agg(F.count("*").alias("n"), *more).where("n > 1")


def line_decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                   equal_from: int | None = None) -> DataFrame:
    """One row per line of at least `equal_from` characters (default `min_chars`): id, line_no
    (from 0), keep_id and keep_line (the earliest line that is equal or within one edit,
    maybe itself), kept. Lines under `min_chars` are matched with equal lines only;
    `equal_from` 1 takes every line that isn't empty.

    Lines lie between line feeds; earlier means a smaller id, then a smaller number. A line
    is kept unless an earlier line of the input is equal to it or one insertion, deletion or
    substitution of a character away. Equal lines are one class, so copies are never
    paired; classes are compared by their earliest line. Only classes that agree with
    another outside one part emit variants; equal variants name the earliest partner, and
    the edit distance of every such pair is verified on the lines.

    A null text has no line. A null id comes after all others. Rows that repeat an id and
    text have the same decisions and don't drop each other. An empty table gives an empty
    result; other columns are ignored.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).alias("id"), F.struct(F.col(id_col).isNull().alias("no"), F.col(id_col).alias("id")).alias("doc"), F.col(text_col).alias("text"))
    n = F.col("n")
    lines = lines_of(plain, min_chars if equal_from is None else min(equal_from, min_chars)).withColumn("n", F.length("line")).select(
        F.struct("doc", "line_no").alias("at"), F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2"), "n",
        F.when(n >= min_chars, part_keys(F.col("line"), n)).alias("keys"))
    instances = written(lines.select("at", "h", "h2"), "lines")
    classes = written(lines.groupBy("h", "h2").agg(F.min("at").alias("first"), F.first("n").alias("n"), F.first("keys").alias("keys")), "classes")

    # only what finds the lines again is shuffled by key and to the documents
    keyed = keyed_parts(classes.select("h", F.col("first.doc.no").alias("no"), F.col("first.doc.id").alias("id"), F.col("first.line_no").alias("line_no"), "n", "keys")).drop("n")
    longs = shared_keys(keyed, F.count_if("is_long").alias("longs")).where("longs > 0")  # shorter lines alone have no partner under the key
    shared = written(longs.select("key", (F.col("longs") > 1).alias("alike"), (F.col("n") > F.col("longs")).alias("longer")), "shared-keys")
    able = keyed.join(shared, "key")
    asked = able.groupBy("no", "id").agg(F.collect_list(F.struct("h", "line_no", "key", "part", "is_long", "alike", "longer")).alias("asked"))
    fetched = plain.select("doc", "text").join(asked, F.col("doc").eqNullSafe(F.struct("no", "id"))) \
        .withColumn("lines", F.split("text", "\n", -1)).select("doc", "lines", F.explode("asked").alias("a")) \
        .select(F.struct("doc", F.col("a.line_no").alias("line_no")).alias("first"), "a.h", "a.key", "a.part", "a.is_long", "a.alike", "a.longer",
                F.get("lines", F.col("a.line_no")).alias("line")) \
        .where(F.xxhash64("line") == F.col("h")).withColumn("h2", F.xxhash64(F.lit(1), "line")).withColumn("n", F.length("line"))
    able_lines = written(fetched, "able")
    variants_ = written(variants(able_lines), "variants")
    earliest = written(variants_.groupBy("variant").agg(
        *[F.min(F.when(F.col("role") == r, F.struct("first", "h", "h2"))).alias(r) for r in ("same", "long", "short")], F.count("*").alias("n"))
        .where("n > 1").drop("n"), "earliest")
    partner = F.when(F.col("role") == "same", F.col("same")).when(F.col("role") == "long", F.col("short")).otherwise(F.col("long"))
    pairs = variants_.join(earliest, "variant").withColumn("partner", partner).where(F.col("partner.first") < F.col("first")) \
        .select("h", "h2", F.col("partner.first").alias("p_first"), F.col("partner.h").alias("p_h"), F.col("partner.h2").alias("p_h2")).distinct()
    text = able_lines.select("h", "h2", "line").dropDuplicates(["h", "h2"])
    near = pairs.join(text, ["h", "h2"]).join(
        text.select(F.col("h").alias("p_h"), F.col("h2").alias("p_h2"), F.col("line").alias("p_line")), ["p_h", "p_h2"]) \
        .where(within_one_edit(F.col("line"), F.col("p_line"))).groupBy("h", "h2").agg(F.min("p_first").alias("near"))
    kept = written(classes.select("h", "h2", "first").join(near, ["h", "h2"], "left").select(
        F.col("h").alias("c_h"), F.col("h2").alias("c_h2"), F.coalesce(F.least("near", "first"), "first").alias("keep")), "kept")
    discard(spark, classes, shared, able_lines, variants_, earliest)
    return instances.join(kept, (F.col("h") == F.col("c_h")) & (F.col("h2") == F.col("c_h2"))).select(
        F.col("at.doc.id").alias(id_col), F.col("at.line_no").cast("long").alias("line_no"), F.col("keep.doc.id").alias("keep_id"),
        F.col("keep.line_no").cast("long").alias("keep_line"), (F.col("at") == F.col("keep")).alias("kept"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                        equal_from: int | None = None) -> DataFrame:
    """`docs` whose texts lack the lines that `line_decisions` does not keep; all columns stay."""
    gone = line_decisions(docs, id_col, text_col, min_chars, equal_from).where(~F.col("kept")).groupBy(F.col(id_col).alias("gone_id")) \
        .agg(F.collect_set("line_no").alias("gone"))
    left = F.array_join(F.filter(F.split(f"row.{text_col}", "\n", -1), lambda _, i: ~F.array_contains(F.col("gone"), i.cast("long"))), "\n")
    text = F.when(F.col("gone").isNull(), F.col(f"row.{text_col}")).otherwise(left)
    return docs.select(F.struct(*docs.columns).alias("row")).join(gone, F.col(f"row.{id_col}").eqNullSafe(F.col("gone_id")), "left").select(
        *[text.alias(c) if c == text_col else F.col(f"row.{c}") for c in docs.columns])
