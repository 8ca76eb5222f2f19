"""Detections against ground truth: overlap joins, matchings, reasons for misses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import iou


def overlaps(boxes: DataFrame, detections: DataFrame, same_class: bool = True) -> DataFrame:
    """Every pair of an image (and class): an equi-join with the overlap as a column, never across images."""
    g = boxes.select("image_id", "box_idx", *(F.col(c).alias("g_" + c) for c in ("cls", "x", "y", "w", "h")))
    d = detections.select(F.col("image_id").alias("d_image"), "det_idx", "conf", *(F.col(c).alias("d_" + c) for c in ("cls", "x", "y", "w", "h")))
    on = g["image_id"] == d["d_image"]
    if same_class:
        on &= g["g_cls"] == d["d_cls"]
    return g.join(d, on).withColumn("iou", iou("g_", "d_")).drop("d_image")


def two_pass_match(pairs: DataFrame, least: float | Column = 0.5) -> DataFrame:
    """Of pairs with iou >= least: each detection keeps its best box, then each box its first detection.

    The second pass goes by detection index and not by overlap, as the
    established evaluation does.
    """
    least = F.lit(least) if isinstance(least, float) else least
    best = Window.partitionBy("image_id", "det_idx").orderBy(F.desc("iou"), "box_idx")
    first = Window.partitionBy("image_id", "box_idx").orderBy("det_idx")
    one = pairs.filter(F.col("iou") >= least).withColumn("_r", F.row_number().over(best)).filter("_r = 1")
    return one.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")


def greedy_matches(boxes: DataFrame, detections: DataFrame, thresholds: list[float], strict: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """by, image_id, cls, det_idx, conf, sizes: greedy matching by confidence, for each image and class, at several thresholds in one pass.

    Each detection takes the unused box of greatest overlap (the first of
    ties) if that reaches the threshold; sizes has, for each threshold, the
    ``size`` of that box (0 where boxes have none), null without a match. With
    ``strict`` an overlap of 0 takes no box. Sequential within a group, and a
    group is one image's boxes, so it is a fold over arrays in the JVM.
    """
    keys = [*by, "image_id", "cls"]
    size = F.col("size").cast("double") if "size" in boxes.columns else F.lit(0.0)
    g = boxes.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("box_idx", "x", "y", "w", "h", size.alias("size")))).alias("gt"))
    d = detections.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct((-F.col("conf")).alias("order"), "det_idx", "conf", "x", "y", "w", "h"))).alias("det"))
    at = d.join(g, keys, "left").withColumn("gt", F.coalesce("gt", F.array().cast(g.schema["gt"].dataType)))

    def over(a: Column, b: Column) -> Column:
        side = lambda p, w: F.greatest(F.lit(0.0), F.least(a[p] + a[w] / 2, b[p] + b[w] / 2) - F.greatest(a[p] - a[w] / 2, b[p] - b[w] / 2))
        both = side("x", "w") * side("y", "h")
        union = a["w"] * a["h"] + b["w"] * b["h"] - both
        return F.when(union > 0, both / union).otherwise(0.0)

    # Overlaps once, then a fold for each threshold over the box that each detection takes, -1 for none.
    at = at.withColumn("m", F.transform("det", lambda x: F.transform("gt", lambda y: over(y, x))))

    def fold(t: float) -> Column:
        def step(s: Column, row: Column) -> Column:
            free = F.zip_with(row, s["taken"], lambda v, used: F.when(used, -1.0).otherwise(v))
            best = F.array_max(free)
            hit = (best >= t) & ((best > 0) if strict else (best >= 0))
            place = F.when(hit, F.array_position(free, best) - 1).otherwise(-1).cast("int")
            return F.struct(F.transform(s["taken"], lambda used, i: used | (i == place)).alias("taken"), F.concat(s["out"], F.array(place)).alias("out"))

        start = F.struct(F.transform("gt", lambda _: F.lit(False)).alias("taken"), F.array().cast("array<int>").alias("out"))
        return F.aggregate("m", start, step)["out"]

    taken = at.select(*keys, "det", "gt", *(fold(t).alias(f"t{k}") for k, t in enumerate(thresholds)))
    each = taken.select(*keys, "gt", F.posexplode("det").alias("k", "d"), *(f"t{k}" for k in range(len(thresholds))))
    sizes = F.array(*(F.get(F.col("gt.size"), F.get(f"t{k}", F.col("k"))) for k in range(len(thresholds))))
    return each.select(*keys, "d.det_idx", "d.conf", sizes.alias("sizes"))


def greedy_flags(boxes: DataFrame, detections: DataFrame, thresholds: list[float], edges: tuple[float, float] | None = None, strict: bool = False) -> DataFrame:
    """image_id, cls, threshold, det_idx, conf, flag of greedy_matches: 1 for a match, -1 (ignored) for one whose ``size`` lies outside ``edges`` (half open), else 0."""
    low, high = edges or (float("-inf"), float("inf"))
    each = F.explode(F.arrays_zip(F.array(*(F.lit(float(t)) for t in thresholds)).alias("threshold"), F.col("sizes").alias("size"))).alias("s")
    at = greedy_matches(boxes, detections, thresholds, strict).select("image_id", "cls", "det_idx", "conf", each)
    size = F.col("s.size")
    flag = F.when(size.isNull(), 0).when((size >= low) & (size < high), 1).otherwise(-1)
    return at.select("image_id", "cls", F.col("s.threshold").alias("threshold"), "det_idx", "conf", flag.alias("flag"))


def miss_reasons(boxes: DataFrame, detections: DataFrame, least_conf: float = 0.25) -> DataFrame:
    """Boxes that the two-pass match at 0.5 leaves out, with the reason: the first that applies of a competing detection of the class, an overlap in the other class, a weakly placed one, none close."""
    pairs = overlaps(boxes, detections.filter(F.col("conf") >= least_conf), same_class=False)
    same = F.col("g_cls") == F.col("d_cls")
    hit = two_pass_match(pairs.filter(same), 0.5).select("image_id", "box_idx")
    most = pairs.groupBy("image_id", "box_idx").agg(F.max(F.when(same, F.col("iou"))).alias("same"), F.max(F.when(~same, F.col("iou"))).alias("other"))
    missed = boxes.select("image_id", "box_idx", "cls").join(hit, ["image_id", "box_idx"], "left_anti").join(most, ["image_id", "box_idx"], "left")
    reason = F.when(F.col("same") >= 0.5, "competing_sameclass_candidate").when(F.col("other") >= 0.5, "wrongclass_overlap").when(F.col("same") >= 0.1, "weak_localization_candidate").otherwise("no_close_sameclass_candidate")
    return missed.select("image_id", "box_idx", "cls", reason.alias("reason"))


def best_overlaps(boxes: DataFrame, detections: DataFrame) -> DataFrame:
    """Each box with its best overlap in its own class, 0 without any."""
    best = overlaps(boxes, detections).groupBy("image_id", "box_idx").agg(F.max("iou").alias("best"))
    return boxes.join(best, ["image_id", "box_idx"], "left").withColumn("best", F.coalesce("best", F.lit(0.0)))
