"""A Merkle manifest of a table: a leaf for each row, a tree for each group of rows, and a tree over the groups' roots.

Trees are made by SQL functions over aligned blocks of BLOCK nodes. A block keeps each of its levels as one string of
hex digests; parents are hashes of its substrings of two digests, siblings the substrings beside a node. The roots of the
blocks are the nodes of the next round, until each tree has one, and blocks of any group are spread over all tasks.

Every two consecutive nodes become the hash of their digests, joined as hex text; a last one alone becomes its own hash.
A tree of one node has that node as its root. A null group is a group of its own and comes first, null order keys come
first, rows of equal keys stand in the order of their leaves, and equal rows are equal leaves. An empty table has no rows
in its manifest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import storage

BLOCK_LEVELS = 9
BLOCK = 1 << BLOCK_LEVELS  # nodes of a block: 32 KB of digests
HEX = 64  # characters of a digest
ROWS_PER_TASK = 200_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """`-` for null, else the value's bytes in UTF-8, `:` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


def depth(size: Column) -> Column:
    """Levels above the leaves of a tree: the binary logarithm, rounded up."""
    return F.when(size > 1, F.length(F.bin(size - 1))).otherwise(0)


def _halved(size: Column, times: int) -> Column:
    return F.ceil(size / F.lit(1 << times)).cast("bigint")


def _levels(level: Column, times: Column) -> Column:
    """The level and those above it, each one binary value of hex digests, so that a substring is a slice."""

    def above(levels: Column, _: Column) -> Column:
        last = F.element_at(levels, -1)
        pairs = F.sequence(F.lit(0), F.floor((F.octet_length(last) - 1) / (2 * HEX)).cast("int"))
        parents = F.transform(pairs, lambda i: F.sha2(F.substring(last, i * (2 * HEX) + 1, F.lit(2 * HEX)), 256))
        return F.concat(levels, F.array(F.array_join(parents, "").cast("binary")))

    steps = F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array(level.cast("binary")), above)


def _siblings(levels: Column, at: Column) -> Column:
    """The digest beside the node and beside each node over it, within the block; an empty text where there is none."""

    def beside(level: Column, height: Column) -> Column:
        place = F.call_function("shiftright", at, height).bitwiseXOR(F.lit(1))
        return F.substring(level, place * HEX + 1, F.lit(HEX)).cast("string")

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), beside)


def climb(nodes: DataFrame, largest: int) -> DataFrame:
    """nodes (tree, size, at, digest, and rest, a struct of anything) with root and siblings, from the lowest level to the highest.

    tree numbers or names the trees, size counts a tree's nodes, at places a node, from 0; largest bounds the sizes."""
    grouped = nodes.groupBy("tree", "size", F.floor(F.col("at") / BLOCK).cast("bigint").alias("block")).agg(
        F.array_sort(F.collect_list(F.struct((F.col("at") % BLOCK).cast("int").alias("at"), "digest", "rest"))).alias("nodes"))
    level = F.array_join(F.col("nodes.digest"), "")
    blocks = grouped.withColumn("levels", _levels(level, F.least(F.lit(BLOCK_LEVELS), depth(F.col("size"))).cast("int")))
    top = F.element_at("levels", -1).cast("string")
    if largest <= BLOCK:
        done = blocks.withColumns({"root": top, "above": F.array().cast("array<string>")})
    else:
        blocks = storage.materialize(blocks, "merkle-blocks")
        upper = blocks.select("tree", _halved(F.col("size"), BLOCK_LEVELS).alias("size"), F.col("block").alias("at"), top.alias("digest"), F.struct("block").alias("rest"))
        over = climb(upper, -(-largest // BLOCK)).select("tree", "rest.block", "root", F.col("siblings").alias("above"))
        done = blocks.join(over, ["tree", "block"])
    each = done.select("tree", "size", "block", "levels", "root", "above", F.explode("nodes").alias("node"))
    return each.select(
        "tree", "size", (F.col("block") * BLOCK + F.col("node.at")).alias("at"), F.col("node.digest").alias("digest"), F.col("node.rest").alias("rest"), "root",
        F.concat(_siblings(F.col("levels"), F.col("node.at")), "above").alias("siblings"))


def folded(digest: Column, at: Column, siblings: Column) -> Column:
    """The root that a digest at a place gives with its siblings."""

    def step(state: Column, beside: Column) -> Column:
        left = state["at"] % 2 == 1
        pair = F.when(left, F.concat(beside, state["digest"])).otherwise(F.concat(state["digest"], beside))
        return F.struct(F.sha2(pair, 256).alias("digest"), F.floor(state["at"] / 2).cast("bigint").alias("at"))

    return F.aggregate(siblings, F.struct(digest.alias("digest"), at.cast("bigint").alias("at")), step, lambda s: s["digest"])


def placed(df: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """df with each row's place `at` in its tree, from 0, and the tree's size.

    Rows are sorted over all tasks by ranges, so a large tree is in many files; a file's row numbers and the counts of
    the files before it give the places."""
    spark = df.sparkSession
    files = storage.tasks(spark, df.count(), ROWS_PER_TASK)
    ordered = storage.materialize(df.repartitionByRange(files, tree, *order).sortWithinPartitions(tree, *order), "merkle-order")
    rows = ordered.select("*", F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("int").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    counts = rows.groupBy(tree, "_file").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before, whole = Window.partitionBy(tree).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(tree)
    counts = counts.select(tree, "_file", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("size"))
    return rows.join(counts, [tree, "_file"]).withColumn("at", F.col("_row") + F.col("_shift")).drop("_file", "_row", "_shift")


def manifest(documents: DataFrame, changed: Column | None = None, fields: tuple[str, ...] = FIELDS, group: str = "lang", order: str = "doc_id") -> DataFrame:
    """A row for each row of documents: `order`, leaf, other_leaf, at, subroot, root and siblings, subtree and all.

    changed: the leaf of a row as it is found later, null where it is the same; other_leaf holds it or else the leaf."""
    own = leaf([F.col(c) for c in fields])
    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))  # null first, then by bytes
    leaves = storage.materialize(documents.select(F.col(order).alias("key"), name.alias("tree"), own.alias("digest"), (own if changed is None else F.coalesce(changed, own)).alias("other")), "merkle-leaves")
    nodes = placed(leaves, "tree", ["key", "digest"]).select("tree", "size", "at", "digest", F.struct("key", "other").alias("rest"))
    nodes = storage.materialize(nodes, "merkle-nodes")
    groups = storage.materialize(climb(nodes, _largest(nodes)), "merkle-groups")
    roots = groups.where("at = 0").select(F.lit(0).alias("one"), F.col("tree").alias("group"), F.col("root").alias("subroot"))
    tops = placed(roots, "one", ["group"]).select(F.col("one").alias("tree"), "size", "at", F.col("subroot").alias("digest"), F.struct("group").alias("rest"))
    tops = storage.materialize(tops, "merkle-tops")
    over = climb(tops, _largest(tops)).select(F.col("rest.group").alias("tree"), F.col("at").alias("group_at"), "root", F.col("siblings").alias("group_siblings"))
    return groups.withColumnRenamed("root", "subroot").join(over, "tree").select(
        F.col("rest.key").alias(order), F.col("digest").alias("leaf"), F.col("rest.other").alias("other_leaf"), "at", "group_at", "subroot", "root", F.col("siblings").alias("group_path"), F.col("group_siblings").alias("root_path"))


def _largest(nodes: DataFrame) -> int:
    return nodes.agg(F.max("size")).first()[0] or 0


def with_proofs(rows: DataFrame) -> DataFrame:
    """manifest with proof_sha256, the root that other_leaf folds to with its siblings, and whether that is the root."""
    again = folded(folded(F.col("other_leaf"), F.col("at"), F.col("group_path")), F.col("group_at"), F.col("root_path"))
    proof = F.sha2(F.concat(F.array_join("group_path", ""), F.array_join("root_path", "")), 256)
    return rows.select("*", proof.alias("proof_sha256"), again.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
