"""Box geometry and banding as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def corners(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    """x1, y1, x2, y2 of a normalised centre box in columns {prefix}x, y, w, h."""
    x, y, w, h = (F.col(prefix + c) for c in "xywh")
    return x - w / 2, y - h / 2, x + w / 2, y + h / 2


def iou(a: str, b: str) -> Column:
    """Overlap over union; negative extents clip to 0, and a union of 0 gives 0."""
    ax1, ay1, ax2, ay2 = corners(a)
    bx1, by1, bx2, by2 = corners(b)
    zero = F.lit(0.0)
    both = F.greatest(zero, F.least(ax2, bx2) - F.greatest(ax1, bx1)) * F.greatest(zero, F.least(ay2, by2) - F.greatest(ay1, by1))
    area = lambda p: F.greatest(zero, F.col(p + "w")) * F.greatest(zero, F.col(p + "h"))
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def coverage(inner: str, outer: str) -> Column:
    """Share of the inner box that the outer one covers."""
    ax1, ay1, ax2, ay2 = corners(inner)
    bx1, by1, bx2, by2 = corners(outer)
    zero = F.lit(0.0)
    both = F.greatest(zero, F.least(ax2, bx2) - F.greatest(ax1, bx1)) * F.greatest(zero, F.least(ay2, by2) - F.greatest(ay1, by1))
    return F.coalesce(F.try_divide(both, F.col(inner + "w") * F.col(inner + "h")), zero)


def crosses_border(prefix: str = "", slack: float = 1e-5) -> Column:
    x1, y1, x2, y2 = corners(prefix)
    return (F.least(x1, y1) < -slack) | (F.greatest(x2, y2) > 1 + slack)


def letterbox_scale(size: float | Column, width: Column, height: Column) -> Column:
    """Scale that fits an image into a square of the given side."""
    return (F.lit(size) if isinstance(size, (int, float)) else size) / F.greatest(width, height)


def band(value: Column, edges: Sequence[float]) -> Column:
    """Index of the half-open band [edge_i, edge_i+1) that a value lies in, 0 below the first edge."""
    out = F.lit(0)
    for e in edges:
        out = out + F.when(value >= e, 1).otherwise(0)
    return out


def coco_area(width_px: Column, height_px: Column) -> Column:
    area = width_px * height_px
    return F.when(area < 32 * 32, "small").when(area < 96 * 96, "medium").otherwise("large")


def long_side_bucket(side: Column, tops: Sequence[int] = (480, 720, 1080, 1440, 1920)) -> Column:
    """The inclusive range of whole pixels that a side lies in, by the ranges' upper ends."""
    out = F.when(side <= tops[0], f"<={tops[0]}")
    for low, high in zip(tops, tops[1:], strict=False):
        out = out.when(side <= high, f"{low + 1}-{high}")
    return out.otherwise(f">{tops[-1]}")


#: Upper ends of the ranges of a census of inputs; fixed values.
CENSUS = (416, 640, 960, 1280, 1920)


def input_ratio(size: int, width: Column, height: Column) -> Column:
    """An aggregate: pixels of square inputs, sides rounded down, over native pixels."""
    side = F.greatest(width, height)
    return F.sum(F.pow(F.floor(side * (size / side)), F.lit(2))) / F.sum(width * height)


def resize_direction(scale: Column) -> Column:
    return F.when(scale > 1.02, "up").when(scale < 0.98, "down").otherwise("equal")


def display_size(width: Column, height: Column, orientation: Column) -> Column:
    """Width and height as shown: EXIF orientations 5 to 8 swap them."""
    swap = orientation.between(5, 8)
    return F.struct(F.when(swap, height).otherwise(width).alias("width"), F.when(swap, width).otherwise(height).alias("height"))


def scene_category(classes: Column) -> Column:
    """none, fire_only, smoke_only or both, from an array of classes (0 fire, 1 smoke)."""
    fire, smoke = F.array_contains(classes, 0), F.array_contains(classes, 1)
    return F.when(fire & smoke, "both").when(fire, "fire_only").when(smoke, "smoke_only").otherwise("none")
