"""A Merkle manifest of a dataset: leaves, subroots by group, one root, and proofs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerokpi.llm.common import discard, written
from aerokpi.llm.ranks import positions

#: Hexadecimal digits of a node.
WIDTH = 64
#: Levels of the tree that one block holds: fanout ** BLOCK_LEVELS nodes of a level lie in one
#: string, 16 KB of them at a fanout of 2.
BLOCK_LEVELS = 8


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the concatenated parts."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def encoded(value: Column) -> Column:
    """`-` for null, else the length in UTF-8 bytes, `:` and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return digest(*[encoded(v) for v in values])


def parents(level: Column, fanout: int) -> Column:
    """The next level's string: one digest of every `fanout` consecutive nodes, the last of fewer."""
    run = WIDTH * fanout
    runs = F.sequence(F.lit(0), F.ceil(F.length(level) / run).cast("int") - 1)
    return F.array_join(F.transform(runs, lambda i: F.sha2(F.substr(level, i * run + 1, F.lit(run)).cast("binary"), 256)), "")


def levels(leaves: Column, depth: Column, fanout: int) -> Column:
    """The strings of levels 0 to `depth` above a block's leaves."""
    steps = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array(leaves), lambda done, _: F.concat(done, F.array(parents(F.element_at(done, -1), fanout))))


def segments(strings: Column, place: Column, fanout: int) -> Column:
    """What flanks the path of the node at `place` of a block: (left, right) by level."""

    def flanks(level: Column, height: Column) -> Column:
        at = F.floor(place / F.pow(F.lit(float(fanout)), height)).cast("int")
        run = F.floor(at / fanout).cast("int") * fanout
        return F.struct(F.substr(level, run * WIDTH + 1, (at - run) * WIDTH).alias("left"),
                        F.substr(level, (at + 1) * WIDTH + 1, (run + fanout - 1 - at) * WIDTH).alias("right"))

    return F.transform(F.slice(strings, 1, F.size(strings) - 1), flanks)


def folded(path: Column, node: Column) -> Column:
    """The root that follows from a node and its path."""
    return F.aggregate(path, node, lambda h, s: digest(s["left"], h, s["right"]))


def siblings(path: Column) -> Column:
    """All siblings of a path, level by level and left to right, as one string."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def grown(nodes: DataFrame, fanout: int, name: str) -> list[DataFrame]:
    """Block tables from the nodes (grp, pos, n, node, rest) upwards: (grp, block, items,
    strings). The nodes of a block, at most fanout ** BLOCK_LEVELS of them, are gathered and
    hashed up; the blocks' roots are the next table's nodes, until every group has one."""
    size = fanout**BLOCK_LEVELS
    depth = sum((F.when(F.col("n") > fanout**k, 1).otherwise(0) for k in range(BLOCK_LEVELS)), F.lit(0))
    tables: list[DataFrame] = []
    while True:
        found = nodes.groupBy("grp", F.floor(F.col("pos") / size).alias("block"), "n").agg(
            F.sort_array(F.collect_list(F.struct("pos", "node", "rest"))).alias("items"))
        joined = F.array_join(F.transform("items", lambda x: x["node"]), "")
        tables.append(written(found.select("grp", "block", "n", "items", levels(joined, depth, fanout).alias("strings")), f"{name}{len(tables)}"))
        top = tables[-1]
        if top.where(F.col("n") > size).isEmpty():
            return tables
        nodes = top.select("grp", F.col("block").alias("pos"), F.ceil(F.col("n") / size).alias("n"),
                           F.element_at("strings", -1).alias("node"), F.lit(None).cast("string").alias("rest"))


def descended(tables: list[DataFrame], above: DataFrame, known: list[str], fanout: int) -> DataFrame:
    """(grp, pos, node, rest, path, known) of the lowest table's nodes, from `above` (grp,
    path, known), the paths of the groups' roots."""
    size = fanout**BLOCK_LEVELS
    above = above.withColumn("at", F.lit(0).cast("long"))
    for table in reversed(tables):
        over = above.select(F.col("grp").alias("over"), "at", F.col("path").alias("upper"), *known)
        rows = table.join(over, F.col("grp").eqNullSafe(F.col("over")) & (F.col("block") == F.col("at")))
        made = F.transform("items", lambda x, i: F.struct(
            x["pos"].alias("pos"), x["node"].alias("node"), x["rest"].alias("rest"),
            F.concat(segments(F.col("strings"), i, fanout), F.col("upper")).alias("path")))
        above = rows.select("grp", F.explode(made).alias("x"), *known).select("grp", F.col("x.pos").alias("at"), "x.node", "x.rest", "x.path", *known)
    return above


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
             carry: Mapping[str, Column] | None = None, fanout: int = 2) -> DataFrame:
    """One row per document: id, group, leaf, subroot, root, path, and the `carry` columns
    (strings computed from the documents' columns).

    A leaf is the SHA-256 of the fields in a form that tells them apart. The leaves of a
    group, by id, become a tree: every `fanout` consecutive nodes (the last run fewer, even
    one) become the SHA-256 of their concatenated hexadecimal digits until one is left, the
    subroot. The subroots by group (null first) become a tree in the same way. `path` holds
    the (left, right) siblings from the leaf to the root, as `siblings` and `folded` take it.

    A level of an aligned block of fanout ** BLOCK_LEVELS leaves is one string of hexadecimal
    digits; parents are hashes of its substrings, siblings are the substrings beside a node,
    and the blocks' roots go through the same again. So no task holds more than a block,
    however large a group is. Places come from ranges of ids (`positions`).

    Nulls are fields like others; a null id comes after all ids of its group, a null group is
    the first. Ids that repeat are ordered by leaf; rows repeated whole are leaves of their
    own. An empty table gives an empty result. Other columns are ignored."""
    spark = docs.sparkSession
    extra = dict(carry or {})
    rest = F.struct(F.col(id_col).alias("id"), *[c.cast("string").alias(f"c{i}") for i, c in enumerate(extra.values())])
    leaves = written(docs.select(F.col(group_col).alias("grp"), leaf_digest(*[F.col(c) for c in fields]).alias("node"), rest.alias("rest")), "leaves")
    placed = positions(leaves, "grp", [F.col("rest.id").asc_nulls_last(), F.col("node").asc()], "placed")
    trees = grown(placed, fanout, "blocks")
    subroots = written(trees[-1].select("grp", F.element_at("strings", -1).alias("node")), "subroots")
    forest = subroots.select(F.lit(0).alias("grp"), "node", F.col("grp").alias("rest"))
    forest = grown(positions(written(forest, "forest"), "grp", [F.col("rest").asc_nulls_first()], "forest_placed"), fanout, "top")
    no_path = F.array().cast("array<struct<left:string,right:string>>")
    root = forest[-1].select("grp", no_path.alias("path"), F.element_at("strings", -1).alias("root"))
    groups = descended(forest, root, ["root"], fanout).select(
        F.col("rest").alias("grp"), F.col("node").alias("subroot"), "root", "path")
    found = descended(trees, groups, ["subroot", "root"], fanout)
    discard(spark, leaves, subroots)
    return found.select(F.col("rest.id").alias(id_col), F.col("grp").alias(group_col), F.col("node").alias("leaf"), "subroot", "root", "path",
                        *[F.col(f"rest.c{i}").alias(c) for i, c in enumerate(extra)])
