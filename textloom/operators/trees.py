"""Trees as adjacency tables: id, parent_id (null for roots), pos, label, url."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..stored import written


def flatten(nodes: DataFrame) -> DataFrame:
    """Every node with its depth (roots: 1), path of labels, root and order (a list of positions that sorts in preorder).

    Each round doubles the known end of every path, so a tree of depth d takes log2(d) joins, each written. Nodes whose
    ancestors are not all there are left out; a cycle is an error.
    """
    own = nodes.select("id", "parent_id", "pos", "label", "url", F.array("label").alias("labels"), F.array(F.struct("pos", "id")).alias("order"), F.col("parent_id").alias("above"))
    now = written(own, "tree")
    whole, part = now.where("above is null"), now.where("above is not null")
    while not part.isEmpty():
        up = whole.unionByName(part).select(F.col("id").alias("above"), F.col("above").alias("next"), F.col("labels").alias("up_labels"), F.col("order").alias("up_order"))
        longer = part.join(up, "above").select("id", "parent_id", "pos", "label", "url", F.concat("up_labels", "labels").alias("labels"), F.concat("up_order", "order").alias("order"), F.col("next").alias("above"))
        now = written(longer, "tree")
        whole, part = whole.unionByName(now.where("above is null")), now.where("above is not null")
        if not part.where(F.exists("order", lambda x: x["id"] == F.col("above"))).isEmpty():
            raise ValueError("a node of the tree is among its own ancestors")
    return whole.select("id", "parent_id", "pos", "label", "url", F.size("labels").alias("depth"), "labels", F.col("order")[0]["id"].alias("root"), "order")


def breadcrumbs(flat: DataFrame) -> DataFrame:
    return flat.where(F.col("url").isNotNull()).select("url", F.array_join("labels", " > ").alias("path"))


def counts_by_root(flat: DataFrame, excluded: str = "glossary:") -> DataFrame:
    """Documents (nodes with a url of another kind) under each root."""
    return flat.groupBy("root").agg(F.count_if(F.col("url").isNotNull() & ~F.startswith("url", F.lit(excluded))).alias("documents"))


def neighbours(flat: DataFrame) -> DataFrame:
    """The documents (nodes with a url that isn't empty) before and after each in preorder, over the whole menu.

    Ranges of the order are numbered and written; what crosses their borders comes from one row of each range.
    """
    ranges = flat.where(F.col("url") != "").select("id", "url", "order").repartitionByRange("order")
    dealt = written(ranges.withColumn("part", F.spark_partition_id()), "preorder")
    ends = dealt.groupBy("part").agg(F.min_by("url", "order").alias("first"), F.max_by("url", "order").alias("last"))
    borders = ends.select("part", F.lag("last").over(Window.orderBy("part")).alias("_before"), F.lead("first").over(Window.orderBy("part")).alias("_after"))
    own = Window.partitionBy("part").orderBy("order")
    near = dealt.withColumn("before", F.lag("url").over(own)).withColumn("after", F.lead("url").over(own))
    return near.join(F.broadcast(borders), "part").select("id", "url", F.coalesce("before", "_before").alias("before"), F.coalesce("after", "_after").alias("after"))


def descendants(flat: DataFrame, node: int) -> DataFrame:
    """Documents under a node, in preorder."""
    return flat.where(F.exists("order", lambda x: x["id"] == node) & F.col("url").isNotNull()).orderBy("order").select("id", "url")


def filtered(nodes: DataFrame, flat: DataFrame, query: str) -> DataFrame:
    """Nodes whose label holds the query, their ancestors, and, below a match that has none under it, all descendants."""
    hit = F.contains(F.lower("label"), F.lit(query.strip().lower()))
    hits = flat.where(hit).select("id", "order")
    up = hits.select(F.explode("order").alias("x")).select("x.id").distinct()
    inner = hits.select("id", F.explode(F.slice("order", 1, F.size("order") - 1)).alias("x")).select(F.col("x.id").alias("id")).distinct()
    lowest = hits.select("id").join(inner, "id", "left_anti")
    down = flat.select("id", F.explode("order").alias("x")).select("id", F.col("x.id").alias("top")).join(lowest.select(F.col("id").alias("top")), "top", "left_semi").select("id")
    return nodes.join(up.union(down).distinct(), "id", "left_semi")


def sections_with_children(nodes: DataFrame) -> DataFrame:
    parents = nodes.select(F.col("parent_id").alias("id")).where("id is not null")
    return nodes.where(F.col("parent_id").isNull()).join(parents, "id", "left_semi")


def find_by_labels(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """path_id and the node (id, url) at the end of each path of labels (path_id, labels); paths that lead nowhere have no row.

    All paths go down together, a level at a time. Of siblings with one label the first counts, so each pair of parent
    and label is one edge, and paths with a common beginning share its steps: a step joins distinct (parent, label) pairs.
    What is reached so far is written after each level."""
    first = Window.partitionBy("parent_id", "label").orderBy("pos", "id")
    edges = nodes.select("id", "parent_id", "label", "url", F.row_number().over(first).alias("_n")).where("_n = 1")
    edges = written(edges.select(F.col("parent_id").alias("_from"), F.col("label").alias("_label"), "id", "url"), "edges")
    key = nodes.schema["id"].dataType
    at = paths.where(F.size("labels") > 0).select("path_id", "labels", F.lit(None).cast(key).alias("_at"))
    longest, done = paths.agg(F.max(F.size("labels"))).first()[0] or 0, None
    for level in range(longest):
        here = at.withColumn("_next", F.get("labels", F.lit(level)))
        wanted = here.select(F.col("_at").alias("_from_at"), F.col("_next").alias("_wanted")).distinct()
        step = wanted.join(edges, F.col("_from_at").eqNullSafe(F.col("_from")) & (F.col("_wanted") == F.col("_label")))
        moved = here.join(step, F.col("_at").eqNullSafe(F.col("_from_at")) & (F.col("_next") == F.col("_wanted")))
        moved = written(moved.select("path_id", "labels", F.col("id").alias("_at"), "url"), "paths")
        ended = moved.where(F.size("labels") == level + 1).select("path_id", F.col("_at").alias("id"), "url")
        done = ended if done is None else done.unionByName(ended)
        at = moved.where(F.size("labels") > level + 1).drop("url")
    return done if done is not None else paths.select("path_id", F.lit(None).cast(key).alias("id"), F.lit(None).cast("string").alias("url")).where("false")


def target_paths(flat: DataFrame) -> DataFrame:
    """id and the file path of each node: its ancestors' labels as folders, the last one again as the file."""
    from ..functions.text import path_segment

    return flat.select("id", F.concat(F.array_join(F.transform("labels", lambda x: path_segment(x)), "/"), F.lit("/"), path_segment(F.col("label")), F.lit(".html")).alias("path"))


def remove_folder(folders: DataFrame, documents: DataFrame, folder: int) -> tuple[DataFrame, DataFrame]:
    """Folders without one, and documents: what was in it moves to its parent."""
    parent = folders.where(F.col("id") == folder).select(F.col("parent_id").alias("_to"))
    moved = folders.where(F.col("id") != folder).join(parent, F.col("parent_id") == folder, "left")
    docs = documents.join(parent, F.col("folder") == folder, "left")
    return (
        moved.select("id", F.when(F.col("parent_id") == folder, F.col("_to")).otherwise(F.col("parent_id")).alias("parent_id"), *[c for c in folders.columns if c not in ("id", "parent_id")]),
        docs.withColumn("folder", F.when(F.col("folder") == folder, F.col("_to")).otherwise(F.col("folder"))).drop("_to"),
    )


def swapped(nodes: DataFrame, node: int, step: int) -> DataFrame:
    """The nodes with one moved up (-1) or down (1) among its siblings."""
    own = Window.partitionBy("parent_id").orderBy("pos", "id")
    near = (F.lead if step > 0 else F.lag)
    marked = nodes.withColumn("_next", near("id").over(own)).withColumn("_next_pos", near("pos").over(own))
    one = marked.where(F.col("id") == node).select(F.col("_next").alias("_other"), F.col("pos").alias("_pos"), F.col("_next_pos").alias("_other_pos"))
    joined = nodes.join(one, (F.col("id") == node) | (F.col("id") == F.col("_other")), "left")
    pos = F.when((F.col("id") == node) & F.col("_other").isNotNull(), F.col("_other_pos")).when(F.col("id") == F.col("_other"), F.col("_pos")).otherwise(F.col("pos"))
    return joined.withColumn("pos", pos).drop("_other", "_pos", "_other_pos")


def parents_by_level(rows: DataFrame) -> DataFrame:
    """The parent of each row of an outline (doc_id, pos, level): the last row before it of a lower level, null without one."""
    own = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return _by_level(rows, "parent", lambda n: F.last(F.when(F.col("level") < n, F.col("pos")), ignorenulls=True).over(own))


def until_next_heading(rows: DataFrame) -> DataFrame:
    """For each row of an outline the position where its part ends: the next row of its level or a lower one."""
    own = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    return _by_level(rows, "until", lambda n: F.first(F.when(F.col("level") <= n, F.col("pos")), ignorenulls=True).over(own))


def _by_level(rows: DataFrame, name: str, found: Callable[[int], Column]) -> DataFrame:
    """rows with what a window finds for their own level; a window for each level that the rows have."""
    levels = sorted(r[0] for r in rows.select("level").where("level is not null").distinct().collect())
    listed = rows.withColumn("_found", F.array(*[found(n) for n in levels]) if levels else F.array(F.lit(None).cast(rows.schema["pos"].dataType)))
    place = F.array_position(F.array(*[F.lit(n) for n in levels]) if levels else F.array(F.col("level")), F.col("level"))
    return listed.withColumn(name, F.get("_found", (place - 1).cast("int"))).drop("_found")


def split_fixed(nodes: DataFrame, urls: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes of a fixed list of urls, in its order, and the rest."""
    place = F.array_position(F.array(*[F.lit(u) for u in urls]), F.col("url"))
    return nodes.where(place > 0).orderBy(place), nodes.where(F.coalesce(place, F.lit(0)) == 0)


def next_order(folders: DataFrame) -> DataFrame:
    """One more than the largest order among siblings, 0 where there is none."""
    return folders.groupBy("parent_id").agg((F.coalesce(F.max("ord"), F.lit(-1)) + 1).alias("next"))


def active_headings(headings: DataFrame, places: DataFrame, threshold: float = 0.0) -> DataFrame:
    """The last heading (doc_id, id, offset) at or above each scroll position (doc_id, at); of equal offsets the larger id.

    An as-of join without pairs: both sides are sorted together by ranges over all tasks, each place takes the last heading
    before it in its range, or else the last one of the ranges before that the document has. So a long document is in
    several tasks. Places above all headings have no row, and equal places are one."""
    marks = headings.where(F.col("offset").isNotNull()).select("doc_id", F.col("offset").cast("double").alias("_at"), F.lit(0).alias("_kind"), "id", F.lit(None).cast(places.schema["at"].dataType).alias("at"))
    asked = places.where(F.col("at").isNotNull()).select("doc_id", "at").distinct().select("doc_id", (F.col("at") + threshold).cast("double").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(headings.schema["id"].dataType).alias("id"), "at")
    order = ["_at", "_kind", "id"]
    dealt = written(marks.unionByName(asked).repartitionByRange("doc_id", *order).withColumn("_part", F.spark_partition_id()), "places")
    mark = F.when(F.col("_kind") == 0, F.struct("_at", "id"))
    ends = dealt.groupBy("doc_id", "_part").agg(F.max(mark).alias("_last"))
    before = Window.partitionBy("doc_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("doc_id", "_part", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    own = Window.partitionBy("doc_id", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = dealt.withColumn("_own", F.last(mark, ignorenulls=True).over(own)).where("_kind = 1").join(carried, ["doc_id", "_part"])
    return found.select("doc_id", "at", F.coalesce("_own", "_carried")["id"].alias("id")).where("id is not null")
