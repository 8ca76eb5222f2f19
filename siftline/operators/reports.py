"""Reports over matched boxes, scores and runs: recall by category, score variants, premiums, verdicts, alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import coverage
from ..functions.lineage import cut, written
from ..functions.ranges import running_sums
from ..functions.stats import linear_quantiles, mdd, quantiles
from .matching import overlaps


def recall_by(boxes: DataFrame, hits: DataFrame, by: list[str], least: int = 1) -> DataFrame:
    """by, n, found, recall of boxes; recall null under ``least`` boxes."""
    at = boxes.join(hits.select("image_id", "box_idx", F.lit(1).alias("_h")), ["image_id", "box_idx"], "left")
    got = at.groupBy(*by).agg(F.count("*").alias("n"), F.count("_h").alias("found"))
    return got.withColumn("recall", F.when(F.col("n") >= least, F.col("found") / F.col("n")))


def category_gap(recall: DataFrame, on: list[str], category: str, a: str, b: str, least: int = 5) -> DataFrame:
    """on, gap: recall of category a less that of b where both have enough boxes, else null."""
    pick = lambda c, col: F.max(F.when(F.col(category) == c, F.col(col)))
    got = recall.groupBy(*on).agg(pick(a, "n").alias("na"), pick(b, "n").alias("nb"), pick(a, "recall").alias("ra"), pick(b, "recall").alias("rb"))
    return got.select(*on, "na", "nb", F.when((F.col("na") >= least) & (F.col("nb") >= least), F.col("ra") - F.col("rb")).alias("gap"))


VARIANTS = ["p", "pq", "pq_gamma", "q", "oracle"]


def score_variants(found: DataFrame, hits: DataFrame, gamma: float = 0.5, digits: int = 9) -> DataFrame:
    """Detections (cls, image_id, det_idx, conf, quality) and those of them that hit, for ap.average_precision_by: a column for each way to rank them, rounded to whole units of the last of ``digits``: p, p q, p q^gamma, q, and an oracle that ranks true positives by quality within the places they hold.

    Both are read several times, so they are to be written tables. A detection
    counts where it stands, and those that hit are probes there. The oracle
    takes these away and puts them where they move to, so no detection is
    looked up among all others; where they move is written once, for the rows
    are counted, sampled and packed.
    """
    ranked = lambda by: running_sums(hits, ["cls"], by, ["image_id", "det_idx"], {"_k": F.lit(1)})
    # The k-th true positive by confidence gives its place to the k-th by quality.
    places = ranked("conf").select("cls", "_k", F.col("conf").alias("_place"))
    moved = written(ranked("quality").join(places, ["cls", "_k"]).select("cls", "image_id", "det_idx", "_place"))
    p, q = F.col("conf"), F.col("quality")
    own = dict(zip(VARIANTS, (p, p * q, p * F.pow(q, F.lit(gamma)), q), strict=False))

    def stand(rows: DataFrame, weight: int, probe: bool, **scores: Column) -> DataFrame:
        return rows.select("cls", "image_id", "det_idx", F.lit(weight).alias("weight"), F.lit(probe).alias("probe"), *(F.floor(scores[v] * 10.0**digits + 0.5).cast("double").alias(v) if v in scores else F.lit(None).cast("double").alias(v) for v in VARIANTS))

    return stand(found, 1, False, **own, oracle=p).unionByName(stand(hits, 0, True, **own)).unionByName(stand(hits, -1, False, oracle=p)).unionByName(stand(moved, 1, True, oracle=F.col("_place")))


def clean_dup_premium(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """by, full, clean, dup and the differences to clean, from rows with a column subset."""
    mean = lambda s: F.avg(F.when(F.col("subset") == s, F.col(value)))
    got = rows.groupBy(*by).agg(F.avg(value).alias("full"), mean("clean").alias("clean"), mean("dup").alias("dup"))
    return got.withColumn("full_premium", F.col("full") - F.col("clean")).withColumn("dup_premium", F.col("dup") - F.col("clean"))


def missed_geometry(missed: DataFrame, detections: DataFrame) -> DataFrame:
    """Each missed box with its closest detection of the class: overlap, ratios of width and height, centre error in widths, coverage."""
    d = overlaps(missed, detections)
    error = F.sqrt(F.pow(F.col("g_x") - F.col("d_x"), 2) + F.pow(F.col("g_y") - F.col("d_y"), 2))
    each = d.select("image_id", "box_idx", F.struct("iou", (-F.col("det_idx")).alias("o"), (F.col("d_w") / F.col("g_w")).alias("wr"), (F.col("d_h") / F.col("g_h")).alias("hr"), F.try_divide(error, F.col("g_w")).alias("ce"), coverage("g_", "d_").alias("cov")).alias("s"))
    return each.groupBy("image_id", "box_idx").agg(F.max("s").alias("s")).select("image_id", "box_idx", "s.iou", F.col("s.wr").alias("width_ratio"), F.col("s.hr").alias("height_ratio"), F.col("s.ce").alias("centre_error"), F.col("s.cov").alias("covered"))


def layer_budget(layers: DataFrame, by: list[str]) -> DataFrame:
    """by, parameters, macs of convolutions (cin, cout, kernel, side, groups, bias, copies): weights, biases among the parameters, a multiplication of every weight at every place of a square output."""
    weights = F.floor(F.col("cin") * F.col("cout") * F.col("kernel") * F.col("kernel") / F.col("groups")).cast("long")
    bias = F.when(F.col("bias"), F.col("cout")).otherwise(0)
    each = layers.select(*by, (F.col("copies") * (weights + bias)).alias("p"), (F.col("copies") * weights * F.col("side") * F.col("side")).alias("m"))
    return each.groupBy(*by).agg(F.sum("p").cast("long").alias("parameters"), F.sum("m").cast("long").alias("macs"))


def verdict(rate: Column, warn: float = 0.03, error: float = 0.10) -> Column:
    return F.when(rate >= error, "error").when(rate >= warn, "warn").otherwise("info")


def longest_match(names: DataFrame, table: DataFrame, name: str = "name", match: str = "match") -> DataFrame:
    """Each name with the longest ``match`` that it contains; null without one. The table is the smaller side: a few patterns."""
    w = Window.partitionBy(name).orderBy(F.desc(F.length(match)), match)
    got = names.select(name).distinct().join(table, F.col(name).contains(F.col(match)), "left")
    return got.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def scaled_cost(gflops: Column, size: Column, base: int = 640) -> Column:
    """Work at another input size: by area."""
    return gflops * F.pow(size / base, F.lit(2))


def epoch_deltas(curves: DataFrame, pairs: list[tuple[int, int]], by: str = "run") -> DataFrame:
    """by, and a column d_a_b for each pair: metric at b less that at a."""
    at = lambda e: F.max(F.when(F.col("epoch") == e, F.col("metric")))
    return curves.groupBy(by).agg(*((at(b) - at(a)).alias(f"d_{a}_{b}") for a, b in pairs))


def aligned(curves: DataFrame, epochs: list[int], by: list[str], digits: int = 8) -> DataFrame:
    """by, epoch, same: whether all runs of a group agree in the metric at an epoch."""
    return curves.filter(F.col("epoch").isin(epochs)).groupBy(*by, "epoch").agg((F.countDistinct(F.round("metric", digits)) <= 1).alias("same"))


def resume_faults(runs: DataFrame) -> DataFrame:
    """Runs whose checkpoint epoch + 1, last curve epoch and pause epoch don't agree, or are missing."""
    ok = (F.col("checkpoint_epoch") + 1 == F.col("last_epoch")) & (F.col("last_epoch") == F.col("pause_epoch"))
    return runs.filter(~F.coalesce(ok, F.lit(False)))


def merge_sources(base: DataFrame, negatives: DataFrame, repeats: int, stem: str = "stem") -> DataFrame:
    """base with each negative ``repeats`` times under names fsneg_<stem>_r<k>; fails if a name is taken."""
    more = negatives.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).withColumn(stem, F.concat(F.lit("fsneg_"), F.col(stem), F.lit("_r"), F.col("_k"))).drop("_k")
    both = base.unionByName(more, allowMissingColumns=True)
    n = F.count("*").over(Window.partitionBy(stem))
    return both.withColumn(stem, F.when(n > 1, F.raise_error(F.concat(F.lit("name taken: "), F.col(stem)))).otherwise(F.col(stem)))


def best_per_metric(rows: DataFrame, metric: str = "metric") -> DataFrame:
    """The configuration of each metric with the most seeds, then the smallest detectable effect."""
    w = Window.partitionBy(metric).orderBy(F.desc("n"), "mdd", "config")
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def name_category(name: Column) -> Column:
    """Letters before the first underscore of a path's last part, else (other)."""
    return F.coalesce(F.nullif(F.regexp_extract(F.regexp_extract(name, r"([^/]*)$", 1), r"^([A-Za-z]+)_", 1), F.lit("")), F.lit("(other)"))


def stem_parts(stem: Column) -> Column:
    """letters and number of a stem: all its letters, and all its digits as one number, -1 without any."""
    digits = F.regexp_replace(stem, "[^0-9]", "")
    return F.struct(F.regexp_replace(stem, r"[^\p{L}]", "").alias("letters"), F.when(digits == "", F.lit("-1")).otherwise(digits).cast("decimal(38,0)").alias("number"))


def alarm_by(images: DataFrame, by: list[str]) -> DataFrame:
    """by, n, alarms, rate of images (image_id, any, alarm) without a class."""
    got = images.filter("any = 0").groupBy(*by).agg(F.count("*").alias("n"), F.sum("alarm").alias("alarms"))
    return got.withColumn("rate", F.col("alarms") / F.col("n"))


def gap_change(curves: DataFrame, rows: int = 10, least: int = 12, by: str = "run") -> DataFrame:
    """by, first_epoch, first, last_epoch, last, change of a column gap over its last rows that have one; runs of fewer than ``least`` are left out."""
    w = Window.partitionBy(by)
    at = curves.filter("gap is not null").withColumn("_r", F.row_number().over(w.orderBy(F.desc("epoch")))).withColumn("_n", F.count("*").over(w))
    tail = at.filter((F.col("_n") >= least) & (F.col("_r") <= rows))
    got = tail.groupBy(by).agg(F.min(F.struct("epoch", "gap")).alias("a"), F.max(F.struct("epoch", "gap")).alias("z"))
    return got.select(by, F.col("a.epoch").alias("first_epoch"), F.col("a.gap").alias("first"), F.col("z.epoch").alias("last_epoch"), F.col("z.gap").alias("last"), (F.col("z.gap") - F.col("a.gap")).alias("change"))


def resume_deltas(curves: DataFrame, base: DataFrame, resumed: DataFrame, on: list[str], by: str = "run", before: int = 10) -> DataFrame:
    """by and what a resumption (by, resumed_at) did to a run against its base (on, epoch, metric), in hundredths: mean, least and largest difference over the epochs before, the last of them, and the lowest metric from the resumption on (first of ties) with its epoch and difference."""
    other = base.select(*on, "epoch", F.col("metric").alias("_base"))
    at = curves.join(resumed, by).join(other, [*on, "epoch"], "left").withColumn("_d", 100 * (F.col("metric") - F.col("_base")))
    early = (F.col("epoch") < F.col("resumed_at")) & (F.col("epoch") >= F.col("resumed_at") - before)
    d = F.when(early, F.col("_d"))
    low = F.min(F.when(F.col("epoch") >= F.col("resumed_at"), F.struct("metric", "epoch", "_d"))).alias("low")
    got = at.groupBy(by, "resumed_at").agg(F.avg(d).alias("mean_before"), F.min(d).alias("least_before"), F.max(d).alias("most_before"), F.max(F.when(F.col("epoch") == F.col("resumed_at") - 1, F.col("_d"))).alias("last_before"), low)
    return got.select(by, "mean_before", "least_before", "most_before", "last_before", F.col("low.epoch").alias("lowest_epoch"), F.col("low.metric").alias("lowest"), F.col("low._d").alias("lowest_delta"))


def edge_errors(pairs: DataFrame) -> DataFrame:
    """g_cls, n, iou and the medians of the four absolute edge errors, left, top, right, bottom, in widths and heights of the box."""
    edge = lambda axis, side, sign: F.abs((F.col(f"d_{axis}") + sign * F.col(f"d_{side}") / 2 - F.col(f"g_{axis}") - sign * F.col(f"g_{side}") / 2) / F.col(f"g_{side}"))
    kinds = {"iou": F.col("iou"), "left": edge("x", "w", -1), "top": edge("y", "h", -1), "right": edge("x", "w", 1), "bottom": edge("y", "h", 1)}
    pairs = cut(pairs.select("g_cls", *(c.alias(k) for k, c in kinds.items())))  # the matching is done once
    long = pairs.unpivot(["g_cls"], list(kinds), "kind", "value")
    middle = linear_quantiles(long, ["g_cls", "kind"], "value", {"median": 0.5})
    wide = middle.groupBy("g_cls").agg(*(F.max(F.when(F.col("kind") == k, F.col("median"))).alias(k) for k in kinds))
    return pairs.groupBy("g_cls").agg(F.count("*").alias("n")).join(wide, "g_cls").select("g_cls", "n", *kinds)


def latency_summary(samples: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n, mean, sd, median, p95 (the sample at int(0.95 (n - 1)) in order), per_second of times in milliseconds."""
    q = quantiles(samples, by, value, 0.95).select(*by, F.col("floor_n1").alias("p95"))
    middle = quantiles(samples, by, value, 0.5).select(*by, F.col("linear").alias("median"))
    got = samples.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return got.join(middle, by).join(q, by).select(*by, "n", "mean", "sd", "median", "p95", F.try_divide(F.lit(1000.0), "mean").alias("per_second"))


def seed_statistics(values: DataFrame, seeds: int) -> DataFrame:
    """metric, mean, sd, mdd of rows (seed, metric, value): metrics that every seed has and that say something.

    Bin numbers, counts and metrics without variance between seeds are no
    measurements and are left out.
    """
    known = values.filter("value is not null").groupBy("seed", "metric").agg(F.avg("value").alias("value"))
    got = known.groupBy("metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")).filter(F.col("n") == seeds)
    dull = F.col("metric").contains(".bins") | F.col("metric").endswith("_count")
    return got.filter(~dull & (F.col("sd") > 0)).select("metric", "mean", "sd", mdd(F.col("sd"), F.col("n")).alias("mdd"))


def ranking_conflicts(boxes: DataFrame, detections: DataFrame, least: float = 0.1, good: float = 0.75) -> DataFrame:
    """cls, n_gt, with_good, conflicts, multi: boxes that a detection of their class overlaps well, those where the most confident overlapping one does not, and detections that cover 80 % of two or more boxes of their class."""
    pairs = overlaps(boxes, detections)
    top = F.max(F.when(F.col("iou") >= least, F.struct("conf", (-F.col("det_idx")).alias("o"), "iou")))
    each = pairs.groupBy("image_id", "box_idx", F.col("g_cls").alias("cls")).agg(F.max("iou").alias("best"), top["iou"].alias("first"))
    box = each.groupBy("cls").agg(F.count_if(F.col("best") >= good).alias("with_good"), F.count_if((F.col("best") >= good) & (F.col("first") < good)).alias("conflicts"))
    held = pairs.groupBy("image_id", "det_idx", F.col("d_cls").alias("cls")).agg(F.count_if(coverage("g_", "d_") >= 0.8).alias("k")).groupBy("cls").agg(F.count_if(F.col("k") >= 2).alias("multi"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return boxes.groupBy("cls").agg(F.count("*").alias("n_gt")).join(box, "cls", "left").join(held, "cls", "left").select("cls", "n_gt", zero("with_good"), zero("conflicts"), zero("multi"))


def first_existing(ids: DataFrame, candidates: list[Column], listing: DataFrame, id_: str = "id") -> DataFrame:
    """id, path: the first of an id's candidate paths that the listing (path) has, null if it has none."""
    each = ids.select(id_, F.posexplode(F.array(*candidates)).alias("k", "path"))
    there = each.join(listing.select("path").distinct(), "path")
    best = there.groupBy(id_).agg(F.min(F.struct("k", "path")).alias("b")).select(id_, F.col("b.path").alias("path"))
    return ids.select(id_).join(best, id_, "left")


def information_tag(ratio: Column) -> Column:
    """What an input size does to native pixels: loses some, is close to them, or only interpolates."""
    return F.when(ratio < 0.9, "loses").when(ratio <= 1.3, "native").otherwise("interpolates")
