"""Whole reports: the integrity of a dataset's splits, the curves of many runs, runs against their cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.stats import linear_quantiles
from . import curves as C
from . import dedup
from .reports import verdict


def _rows(df: DataFrame, section: str, key: Column | str, value: Column, level: Column | None = None) -> DataFrame:
    name = F.lit(key) if isinstance(key, str) else key.cast("string")
    return df.select(F.lit(section).alias("section"), name.alias("key"), value.cast("double").alias("value"), (F.lit(None).cast("string") if level is None else level).alias("level"))


def _if_any(n: Column) -> Column:
    return F.when(n > 0, "warn").otherwise("info")


def pair_count(rows: DataFrame, links: DataFrame, hash_: str = "hash") -> DataFrame:
    """One row, n: the pairs of rows within a radius, from links between classes (p, q) of equal hashes and the classes' sizes."""
    held = cut(rows.filter(F.col(hash_).isNotNull()).groupBy(F.col(hash_).alias("h")).agg(F.count("*").alias("n")))
    end = lambda h, n: held.select(F.col("h").alias(h), F.col("n").alias(n))
    between = links.select("p", "q").join(end("p", "x"), "p").join(end("q", "y"), "q").select((F.col("x") * F.col("y")).alias("n"))
    within = held.select((F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("n"))
    return between.unionByName(within).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def split_report(images: DataFrame, sized: DataFrame, marks: DataFrame, frames: DataFrame, radius: int, inputs: tuple[int, ...], min_cells: float = 2.0) -> DataFrame:
    """section, key, value, level: what can be wrong with a dataset's splits, in one table; level (info, warn, error) where a rule judges the value.

    ``images`` (id, split, width, height), ``sized`` boxes (split, input, cls,
    px: the long side after resizing), ``marks`` (id, split, hash, sha), ``frames``
    (id, split, prefix, number). Near duplicates are counted on classes of equal
    hashes, neighbouring frames by place. A split's rate of images with a near duplicate in another one is an
    error from 0.10 and a warning from 0.03 on; copies within train, neighbouring
    frames in two splits, input sizes of more than 1.5 times the commonest image
    and fewer than 0.15 of val's boxes below ``min_cells`` cells of stride 8 are warnings.
    """
    marks = cut(marks.select("id", "split", "hash", "sha"))
    sizes = cut(images.groupBy("width", "height").agg(F.count("*").alias("n")))
    long = F.greatest("width", "height")
    top = F.max(F.struct("n", (-F.col("width")).alias("w"), (-F.col("height")).alias("h"))).alias("top")
    whole = sizes.agg(F.count("*").alias("distinct"), F.sum("n").alias("images"), F.max(long).alias("longest"), top)
    whole = cut(whole.withColumn("share", F.col("top.n") / F.col("images")).withColumn("side", F.greatest(-F.col("top.w"), -F.col("top.h"))))
    out = [_rows(whole, "resolution", k, F.col(k)) for k in ("distinct", "images", "longest", "share")]
    out.append(_rows(linear_quantiles(images.withColumn("_one", F.lit(1)).withColumn("side", long.cast("double")), ["_one"], "side", {"m": 0.5}), "resolution", "median_side", F.col("m")))
    scale = whole.select("side", F.explode(F.array(*map(F.lit, inputs))).alias("input")).withColumn("x", F.col("input") / F.col("side"))
    out.append(_rows(scale, "upsampling", F.col("input"), F.col("x"), F.when(F.col("x") > 1.5, "warn").when(F.col("x") > 1.02, "info")))
    exact = cut(dedup.exact_groups(marks, "sha").agg(F.count("*").alias("groups"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("within_train"), F.lit(0)).alias("within_train")))
    out += [_rows(exact, "exact", "groups", F.col("groups")), _rows(exact, "exact", "pairs", F.col("pairs")), _rows(exact, "exact", "within_train", F.col("within_train"), _if_any(F.col("within_train")))]
    links = cut(dedup.near_classes(marks, radius))
    out.append(_rows(pair_count(marks, links), "near", "pairs", F.col("n")))
    leak = cut(dedup.leakage_matrix(marks, radius, links=links))
    out.append(_rows(leak.filter("split_a != split_b"), "leak", F.concat("split_a", F.lit("->"), "split_b"), F.col("rate"), verdict(F.col("rate"))))
    out.append(_rows(leak.filter("split_a = split_b"), "within", F.col("split_a"), F.col("rate")))
    subset = dedup.clean_and_duplicate(marks, radius, links=links).groupBy("split").agg(F.count_if(F.col("subset") == "dup").alias("n"))
    out.append(_rows(subset, "duplicate_in_train", F.col("split"), F.col("n")))
    pairs = dedup.adjacent_frame_count(frames)
    out.append(_rows(pairs, "frames", "pairs", F.col("n"), _if_any(F.col("n"))))
    below = lambda stride: F.avg((F.col("px") < stride * min_cells).cast("double"))
    at = cut(sized.groupBy("split", "input", "cls").agg(F.count("*").alias("n"), below(8).alias("below_8"), below(4).alias("below_4")))
    key = lambda k: F.concat_ws(" ", "split", F.col("input").cast("string"), F.col("cls").cast("string"), F.lit(k))
    room = F.when(F.col("split") == "val", F.when(F.col("below_8") >= 0.15, "info").otherwise("warn"))
    out += [_rows(at, "size", key("n"), F.col("n")), _rows(at, "size", key("below_8"), F.col("below_8"), room), _rows(at, "size", key("below_4"), F.col("below_4"))]
    got = out[0]
    for part in out[1:]:
        got = got.unionByName(part)
    return got


def curve_report(curves: DataFrame, windows: list[tuple[str, int, int]], complete: int = 100, by: str = "run") -> DataFrame:
    """by, best_epoch, best, last_epoch, last, n, slope, a mean for each window, missing (epochs without a row up to the last), complete (rows enough)."""
    base = C.best_and_last(curves, by)
    mean = C.window_means(curves, windows, by).groupBy(by).agg(*(F.max(F.when(F.col("window") == w, F.col("mean"))).alias(w) for w, _, _ in windows))
    gaps = C.epoch_gaps(curves, by).groupBy(by).agg(F.sum(F.col("last") - F.col("first") + 1).cast("long").alias("missing"))
    at = base.join(C.tail_slope(curves, by=by), by, "left").join(mean, by, "left").join(gaps, by, "left")
    return at.withColumn("missing", F.coalesce("missing", F.lit(0).cast("long"))).withColumn("complete", F.col("n") >= complete)


def run_report(runs: DataFrame, cost: str, value: str, family: list[str], run: str = "run") -> DataFrame:
    """runs with frontier: whether a run of its family beats every cheaper one. Runs without a cost are on no frontier."""
    known = runs.filter(F.col(cost).isNotNull())
    front = C.pareto(known, cost, value, family, run).select(run, F.lit(True).alias("frontier"))
    return runs.join(front, run, "left").withColumn("frontier", F.coalesce("frontier", F.lit(False)))


def ladder_report(curves: DataFrame, base: int, epochs: list[int], on: list[str]) -> DataFrame:
    """on, rung, kind, epoch, step, base, other, delta of curves (on, rung, epoch, step, metric): every other rung against the base rung at some of its epochs.

    kind ``epoch`` takes the rung's row of the same epoch, ``step`` its row of
    the closest cumulative step (the earliest epoch of ties); other and delta,
    in hundredths, are null where there is no such row.
    """
    at = cut(curves.select(*on, "rung", "epoch", "step", "metric"))
    own = at.filter((F.col("rung") == base) & F.col("epoch").isin(epochs)).select(*on, "epoch", "step", F.col("metric").alias("base"))
    rungs = at.filter(F.col("rung") != base).select(*on, "rung").distinct()
    left = cut(own.join(rungs, on))
    same = left.join(at.select(*on, "rung", "epoch", F.col("metric").alias("other")), [*on, "rung", "epoch"], "left").withColumn("kind", F.lit("epoch"))
    near = C.nearest_step(left, at.filter(F.col("rung") != base), [*on, "rung"]).withColumn("other", F.col("near_metric")).withColumn("kind", F.lit("step"))
    names = [*on, "rung", "kind", "epoch", "step", "base", "other"]
    return same.select(*names).unionByName(near.select(*names)).withColumn("delta", 100 * (F.col("other") - F.col("base")))


def version_counts(rows: DataFrame) -> DataFrame:
    """split, images, background, first_only, second_only, both, first_boxes, second_boxes of manifest rows (split, boxes)."""
    n = lambda c: F.size(F.filter("boxes", lambda b: b["cls"] == c))
    at = rows.select("split", n(0).alias("a"), n(1).alias("b"))
    a, b = F.col("a") > 0, F.col("b") > 0
    return at.groupBy("split").agg(
        F.count("*").alias("images"), F.count_if(~a & ~b).alias("background"), F.count_if(a & ~b).alias("first_only"), F.count_if(~a & b).alias("second_only"), F.count_if(a & b).alias("both"),
        F.sum("a").alias("first_boxes"), F.sum("b").alias("second_boxes"),
    )
