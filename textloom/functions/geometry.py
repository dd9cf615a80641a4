"""Column functions for rectangles x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(r: Column) -> Column:
    return F.greatest(F.lit(0.0), r["x1"] - r["x0"]) * F.greatest(F.lit(0.0), r["y1"] - r["y0"])


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 if both are empty."""
    shared = intersection(a, b)
    union = area(a) + area(b) - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


def column_of(r: Column, page_width: Column, full: float = 0.6) -> Column:
    """full for a rectangle wider than a share of the page, else left or right by its middle."""
    middle = (r["x0"] + r["x1"]) / 2
    return F.when(r["x1"] - r["x0"] > full * page_width, "full").when(middle < page_width / 2, "left").otherwise("right")


def percent_rect(r: Column, width: Column, height: Column) -> Column:
    return F.struct((r["x"] / width * 100).alias("x"), (r["y"] / height * 100).alias("y"), (r["w"] / width * 100).alias("w"), (r["h"] / height * 100).alias("h"))


def is_selection(r: Column) -> Column:
    """Of rectangles in percent: those that are neither slivers, nor taller than a line, nor off the page."""
    inside = (r["x"] >= -1) & (r["y"] >= -1) & (r["x"] + r["w"] <= 101) & (r["y"] + r["h"] <= 101)
    return (r["w"] >= 0.5) & (r["h"] >= 0.1) & (r["h"] <= 6) & inside
