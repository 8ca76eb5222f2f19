"""Average precision from flagged detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.ranges import running_sums, sums_in_ranges
from ..functions.rankings import envelope_sums
from .matching import greedy_matches


ORDER = ["image_id", "det_idx"]


def _envelope_sums(run: DataFrame, by: list[str], of: list[str]) -> DataFrame:
    """by and a sum for each column of precisions ``of``: over rows (_range, conf, image_id, det_idx) that have it, of the largest from there on, by ranges of the descending ranking."""
    top = run.groupBy(*by, "_range").agg(*(F.max(p).alias(f"_t{p}") for p in of))
    after = Window.partitionBy(*by).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    later = top.select(*by, "_range", *(F.max(f"_t{p}").over(after).alias(f"_l{p}") for p in of))
    # From the end on: a frame that ends at the current row is one running maximum, one that starts there is not.
    end = Window.partitionBy(*by, "_range").orderBy("conf", F.desc("image_id"), F.desc("det_idx")).rowsBetween(Window.unboundedPreceding, 0)
    env = run.join(later, [*by, "_range"]).select(*by, *(F.when(F.col(p).isNotNull(), F.greatest(F.max(p).over(end), f"_l{p}")).alias(p) for p in of))
    return env.groupBy(*by).agg(*(F.sum(p).alias(p) for p in of))


def average_precision(flags: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """by, n_gt, ap: all-point interpolation over detections (conf, image_id, det_idx, flag).

    Recall rises at true positives only, by 1 / n_gt, and the envelope there is
    the largest precision from there on: so ap is the sum of that over true
    positives, divided by n_gt. Ignored detections (flag -1) leave the ranking.
    Null without ground truth, 0 without detections. Equal scores rank by image
    and detection.
    """
    rows = flags.filter("flag >= 0").select(*by, "conf", *ORDER, "flag")
    run = running_sums(rows, by, "conf", ORDER, {"hits": F.col("flag"), "seen": F.lit(1)})
    got = _envelope_sums(run.filter("flag = 1").withColumn("precision", F.col("hits") / F.col("seen")), by, ["precision"])
    ap = F.when(F.col("n_gt") > 0, F.coalesce(F.try_divide("precision", "n_gt"), F.lit(0.0)))
    return totals.join(got, by, "left").select(*by, "n_gt", ap.alias("ap"))


def average_precision_at(detections: DataFrame, totals: DataFrame, by: list[str], thresholds: list[float]) -> DataFrame:
    """by, t, n_gt, ap of average_precision at several overlaps, of detections (conf, image_id, det_idx, iou; null without a match): a detection is true from its overlap down, so one ranking serves all and thresholds are columns."""
    hit = {f"_{k}": F.coalesce(F.col("iou") >= t, F.lit(False)) for k, t in enumerate(thresholds)}
    run = running_sums(detections.select(*by, "conf", *ORDER, "iou"), by, "conf", ORDER, {"seen": F.lit(1)} | {f"hits{k}": c.cast("int") for k, c in hit.items()})
    any_ = run.filter(F.col("iou") >= min(thresholds))
    got = _envelope_sums(any_.select(*by, "_range", "conf", *ORDER, *(F.when(c, F.col(f"hits{k}") / F.col("seen")).alias(k) for k, c in hit.items())), by, list(hit))
    each = F.explode(F.array(*(F.struct(F.lit(float(t)).alias("t"), F.col(k).alias("s")) for t, k in zip(thresholds, hit, strict=True)))).alias("e")
    ap = F.when(F.col("n_gt") > 0, F.coalesce(F.try_divide("e.s", "n_gt"), F.lit(0.0)))
    return totals.join(got, by, "left").select(*by, "n_gt", each).select(*by, "e.t", "n_gt", ap.alias("ap"))


def average_precision_by(rows: DataFrame, totals: DataFrame, by: list[str], scores: list[str]) -> DataFrame:
    """by, variant, n_gt, ap of average_precision under several scores of the same detections, which are columns of rankings.envelope_sums: weights count what is ranked, probes are the true positives. ``by`` names a few groups, those of totals (by, n_gt)."""
    named = cut(totals.select(*by, "n_gt").repartition(1).withColumn("g", F.monotonically_increasing_id().cast("int")))
    got = envelope_sums(rows.join(F.broadcast(named.drop("n_gt")), by), scores)
    each = F.posexplode(F.array(*map(F.lit, scores))).alias("ranking", "variant")
    ap = F.when(F.col("n_gt") > 0, F.coalesce(F.try_divide("s", "n_gt"), F.lit(0.0)))
    return named.select("*", each).join(got, ["g", "ranking"], "left").select(*by, "variant", "n_gt", ap.alias("ap"))


def stratified_ap(boxes: DataFrame, detections: DataFrame, bands: dict[str, tuple[float, float]], thresholds: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """by, band, cls, n_gt, ap50, ap75, ap (mean over thresholds). ``boxes`` has a column size; a band is half open.

    Ground truth outside the band is there to be matched but ignored;
    detections without a match count as false in every band. Matching does not
    depend on the band, so it is done once. All detections are ranked once too:
    what a band and a threshold still have to count are their matched ones,
    true or ignored. These stay in the ranges of that ranking, a row a threshold,
    and bands are columns: a band ignores those matched ones that it does not hit.
    """
    keys = [*by, "cls"]
    match = cut(greedy_matches(boxes, detections, thresholds, by=by))
    ranked = running_sums(match, keys, "conf", ORDER, {"rank": F.lit(1)})
    each = F.explode(F.arrays_zip(F.array(*(F.lit(float(t)) for t in thresholds)).alias("threshold"), F.col("sizes").alias("size"))).alias("m")
    groups = [*keys, "threshold"]
    rows = ranked.select(*keys, "conf", *ORDER, "rank", "_range", each).filter("m.size is not null").select(*keys, "m.threshold", "m.size", "conf", *ORDER, "rank", "_range")
    inside = {f"_{k}": (F.col("size") >= float(low)) & (F.col("size") < float(high)) for k, (low, high) in enumerate(bands.values())}
    run = sums_in_ranges(cut(rows), groups, "conf", ORDER, {"matched": F.lit(1)} | {f"hits{k}": c.cast("int") for k, c in inside.items()})
    precision = {k: F.when(c, F.col(f"hits{k}") / (F.col("rank") - F.col("matched") + F.col(f"hits{k}"))) for k, c in inside.items()}
    sums = _envelope_sums(run.select(*groups, "_range", "conf", *ORDER, *(c.alias(k) for k, c in precision.items())), groups, list(inside))
    band = F.explode(F.array(*(F.struct(F.lit(b).alias("band"), F.lit(float(low)).alias("low"), F.lit(float(high)).alias("high")) for b, (low, high) in bands.items()))).alias("b")
    n_gt = boxes.select(*keys, "size", band).groupBy(*keys, "b.band").agg(F.count_if((F.col("size") >= F.col("b.low")) & (F.col("size") < F.col("b.high"))).alias("n_gt"))
    long = sums.select(*groups, F.explode(F.array(*(F.struct(F.lit(b).alias("band"), F.col(k).alias("s")) for b, k in zip(bands, inside, strict=True)))).alias("e")).select(*groups, "e.band", "e.s")
    every = n_gt.select("*", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("threshold")).join(long, [*groups, "band"], "left")
    ap = every.withColumn("ap", F.when(F.col("n_gt") > 0, F.coalesce(F.try_divide("s", "n_gt"), F.lit(0.0))))
    at = lambda t: F.max(F.when(F.round("threshold", 2) == t, F.col("ap")))
    return ap.groupBy(*by, "band", "cls", "n_gt").agg(at(0.5).alias("ap50"), at(0.75).alias("ap75"), F.avg("ap").alias("ap")).select(*by, "band", "cls", "n_gt", "ap50", "ap75", "ap")
