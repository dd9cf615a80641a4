"""Page layout: regions with doc_id, page, x0, y0, x1, y1. What depends on an order runs page by page."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import column_of

IOU, DROP_SHARE, LEAST_HEIGHT = 0.3, 0.5, 5.0
_BOX = ["x0", "y0", "x1", "y1"]


def _areas(b: np.ndarray) -> np.ndarray:
    return np.maximum(0, b[:, 2] - b[:, 0]) * np.maximum(0, b[:, 3] - b[:, 1])


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, np.minimum(a[2], b[:, 2]) - np.maximum(a[0], b[:, 0])) * np.maximum(0, np.minimum(a[3], b[:, 3]) - np.maximum(a[1], b[:, 1]))


def non_maximum_suppression(regions: DataFrame, most: float = IOU, by: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """Of regions of a page that overlap by more than `most` (IoU) the most confident; ties to the lesser box, then to the
    lesser row by the other columns."""
    others = [c for c in regions.columns if c not in ("conf", *_BOX)]

    def keep(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(["conf", *_BOX, *others], ascending=[False] + [True] * (len(page.columns) - 1))
        boxes, kept = page[_BOX].to_numpy(float), []
        for i in range(len(boxes)):
            if kept:
                other = boxes[kept]
                shared = _shared(boxes[i], other)
                union = _areas(boxes[i : i + 1])[0] + _areas(other) - shared
                if (shared > most * np.maximum(union, 1e-12)).any():
                    continue
            kept.append(i)
        return page.iloc[kept]

    return regions.groupBy(*by).applyInPandas(keep, regions.schema)


def long_enough(regions: DataFrame, least: int) -> DataFrame:
    """Regions whose text has `least` characters or more; with 0 all, also those without a text."""
    return regions.where(F.length("text") >= least) if least > 0 else regions


def clip_by_captures(regions: DataFrame, captures: DataFrame, order: str = "nth", drop: float = DROP_SHARE, least: float = LEAST_HEIGHT) -> DataFrame:
    """Text regions without what captured ones (figures, tables) of their page cover, one after another by `order`.

    What is left of a region goes whole where a capture covers more than a share of the region's first area; a capture
    that covers it wider than high cuts it, from its top on if it begins lower than the region, else down to its bottom.
    Empty and low ones go in the end. Pages without captures stay as they are.
    """
    place = F.array_sort(F.collect_list(F.struct(F.col(order).alias("nth"), *[F.col(c).cast("double").alias(c) for c in _BOX])))
    taken = captures.groupBy(F.col("doc_id").alias("_doc"), F.col("page").alias("_page")).agg(place.alias("_taken"))
    joined = regions.join(taken, F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("page").eqNullSafe(F.col("_page")), "left")
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))

    def cut(left: Column, cap: Column) -> Column:
        wide = F.least(F.col("x1"), cap["x1"]) - F.greatest(F.col("x0"), cap["x0"])
        high = F.least(left["y1"], cap["y1"]) - F.greatest(left["y0"], cap["y0"])
        apart = left["gone"] | (wide <= 0) | (high <= 0)
        gone = left["gone"] | ~apart & (wide * high / area > drop)
        cuts, lower = ~apart & ~gone & (high < wide), cap["y0"] > left["y0"]
        return F.struct(
            F.when(cuts & ~lower, F.greatest(left["y0"], cap["y1"])).otherwise(left["y0"]).alias("y0"),
            F.when(cuts & lower, F.least(left["y1"], cap["y0"])).otherwise(left["y1"]).alias("y1"),
            gone.alias("gone"),
        )

    start = F.struct(F.col("y0").cast("double").alias("y0"), F.col("y1").cast("double").alias("y1"), F.lit(False).alias("gone"))
    folded = joined.where(F.col("_taken").isNull() | (area > 0)).withColumn("_left", F.when(F.col("_taken").isNull(), start).otherwise(F.aggregate("_taken", start, cut)))
    left = folded.where(F.col("_taken").isNull() | ~F.col("_left.gone") & (F.col("_left.y1") > F.col("_left.y0")) & (F.col("_left.y1") - F.col("_left.y0") >= least))
    return left.select(*[F.col(f"_left.{c}").alias(c) if c in ("y0", "y1") else c for c in regions.columns])


def outside_tables(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Blocks that meet no table of their page."""
    t = tables.select(F.col("doc_id").alias("t_doc"), F.col("page").alias("t_page"), *[F.col(c).alias(f"t_{c}") for c in _BOX])
    meets = (F.col("doc_id") == F.col("t_doc")) & (F.col("page") == F.col("t_page")) & (F.col("x0") < F.col("t_x1")) & (F.col("x1") > F.col("t_x0")) & (F.col("y0") < F.col("t_y1")) & (F.col("y1") > F.col("t_y0"))
    return blocks.join(t, meets, "left_anti")


def reading_order(regions: DataFrame, width: float) -> DataFrame:
    """Column of each region, and its place: full-width ones first, then columns, top to bottom."""
    named = regions.withColumn("column", column_of(F.struct(*_BOX), F.lit(width)))
    order = Window.partitionBy("doc_id", "page").orderBy(F.col("column") != "full", "column", "y0", "x0")
    return named.withColumn("place", F.row_number().over(order))


def dominant_size(spans: DataFrame, default: float = 10.0) -> DataFrame:
    """The font size of most characters of each page."""
    sums = spans.groupBy("doc_id", "page", "size").agg(F.sum(F.length("text")).alias("n"))
    return sums.groupBy("doc_id", "page").agg(F.coalesce(F.max_by("size", F.struct("n", -F.col("size"))), F.lit(default)).alias("size"))


def merge_lines(rects: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Rectangles of a highlight on one line as one: each is compared with the first of its line. rects: group, x, y, w, h."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for r in rows.sort_values(["y", "x"], kind="stable").itertuples():
            if out and abs(r.y - out[-1][5]) <= tolerance * out[-1][6]:
                line = out[-1]
                right, bottom = max(line[1] + line[3], r.x + r.w), max(line[2] + line[4], r.y + r.h)
                line[1], line[2] = min(line[1], r.x), min(line[2], r.y)
                line[3], line[4] = right - line[1], bottom - line[2]
            else:
                out.append([r.group, r.x, r.y, r.w, r.h, r.y, r.h])
        return pd.DataFrame([x[:5] for x in out], columns=["group", "x", "y", "w", "h"])

    return rects.groupBy("group").applyInPandas(merge, "group bigint, x double, y double, w double, h double")


def block_texts(spans: DataFrame) -> DataFrame:
    """Text of each block of a page from its spans in order, with whether any is bold (flag 16) or italic (flag 2)."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line", "span", "text"))), lambda s: s["text"])
    return spans.groupBy("doc_id", "page", "block").agg(F.array_join(ordered, " ").alias("text"), F.max(F.col("flags").bitwiseAND(16) != 0).alias("bold"), F.max(F.col("flags").bitwiseAND(2) != 0).alias("italic"), F.max("size").alias("size"))
