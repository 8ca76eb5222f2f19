"""Image-level alarms: scores, thresholds under a false-alarm budget, calibration, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.ranges import numbered, running_sums
from ..functions.stats import mdd

#: The double after 1: no probability reaches it.
NEVER = 1.0000000000000002


def image_scores(images: DataFrame, boxes: DataFrame, detections: DataFrame) -> DataFrame:
    """Two rows for each image: its largest confidence in the class (0 without detections) and whether the class is there."""
    both = images.select("image_id", "split", "scene", F.explode(F.array(F.lit(0), F.lit(1))).alias("cls"))
    top = detections.groupBy("image_id", "cls").agg(F.max("conf").alias("score"))
    there = boxes.select("image_id", "cls").distinct().withColumn("label", F.lit(1))
    return both.join(top, ["image_id", "cls"], "left").join(there, ["image_id", "cls"], "left").select("image_id", "split", "scene", "cls", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("label", F.lit(0)).alias("label"))


def threshold_under_budget(scores: DataFrame, max_fpr: float, by: tuple[str, ...] = ("cls",), one_label: bool = False) -> DataFrame:
    """by, threshold, recall, fpr: the highest recall with fpr <= max_fpr, then the lowest fpr, then the highest threshold.

    Thresholds stand at distinct scores only, so rows are summed by score
    before the running sum. Where nothing fits the budget the threshold is
    NEVER, with recall and fpr 0. Groups without both labels are left out, or
    with ``one_label`` have NEVER too.
    """
    ties = scores.groupBy(*by, "score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    totals = scores.groupBy(*by).agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg")).filter("pos > 0 and neg > 0")
    run = running_sums(ties, list(by), "score", [], {"tp": F.col("p"), "fp": F.col("n")})
    at = run.join(totals, list(by))
    each = at.select(*by, F.col("score").alias("threshold"), (F.col("tp") / F.col("pos")).alias("recall"), (F.col("fp") / F.col("neg")).alias("fpr"))
    never = (scores if one_label else totals).select(*by).distinct().select(*by, F.lit(NEVER).alias("threshold"), F.lit(0.0).alias("recall"), F.lit(0.0).alias("fpr"))
    best = F.max(F.when(F.col("fpr") <= max_fpr, F.struct("recall", (-F.col("fpr")).alias("minus"), "threshold"))).alias("b")
    return each.unionByName(never).groupBy(*by).agg(best).select(*by, "b.threshold", "b.recall", (-F.col("b.minus")).alias("fpr"))


def alarm_metrics(scores: DataFrame, thresholds: DataFrame, by: tuple[str, ...] = ("cls",)) -> DataFrame:
    """Recall and false-alarm rate at given thresholds; null where there is nothing to divide by. Thresholds are a few rows and are joined by key."""
    hit = (F.col("score") >= F.col("threshold")).cast("double")
    at = scores.join(thresholds.select(*by, "threshold"), list(by))
    return at.groupBy(*by).agg(F.avg(F.when(F.col("label") == 1, hit)).alias("recall"), F.avg(F.when(F.col("label") == 0, hit)).alias("fpr"), F.count("*").alias("n"))


def background_alarms(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Share of images without any class on which any class alarms; one row."""
    at = scores.join(thresholds.select("cls", "threshold"), "cls")
    image = at.groupBy("image_id").agg(F.max("label").alias("any"), F.max((F.col("score") >= F.col("threshold")).cast("int")).alias("alarm"))
    return image.filter("any = 0").agg(F.count("*").alias("n_background"), F.avg(F.col("alarm").cast("double")).alias("alarm_fraction"))


def scaled(p: Column, temperature: Column | float) -> Column:
    """Temperature scaling of a probability, its logit kept to [1e-6, 1 - 1e-6] and the scaled one to +-60."""
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    z = (F.ln(q) - F.log1p(-q)) / temperature
    return 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), z))))


def nll(p: Column, label: Column) -> Column:
    q = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), p))
    return -F.when(label == 1, F.ln(q)).otherwise(F.ln(1 - q))


def ece_brier(scores: DataFrame, bins: int = 15, by: tuple[str, ...] = ("cls",)) -> DataFrame:
    """Expected calibration error over equal bins of the score, and Brier score."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1))
    each = scores.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("p"), F.avg("label").alias("y"), F.sum(F.pow(F.col("score") - F.col("label"), 2)).alias("sq"))
    return each.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"), (F.sum("sq") / F.sum("n")).alias("brier"), F.sum("n").alias("n"))


def temperature_grid(spark: SparkSession, n: int = 401) -> DataFrame:
    """n temperatures, evenly spaced in logarithm from 0.1 to 10."""
    return spark.range(n).select(F.col("id").cast("int").alias("k"), F.pow(F.lit(10.0), F.lit(-1.0) + 2 * F.col("id") / (n - 1)).alias("temperature"))


def fit_temperature(scores: DataFrame, n: int = 401, by: tuple[str, ...] = ("cls",)) -> DataFrame:
    """by, k, temperature, nll: the grid's first minimum of the mean negative log-likelihood.

    Every row makes a sum for each temperature; the grid is a constant array,
    so rows are folded where they are and n rows per group leave each task.
    """
    grid = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct(k.alias("k"), F.pow(F.lit(10.0), F.lit(-1.0) + 2 * k / (n - 1)).alias("temperature")))
    # Equal (score, label) rows count once, with a weight.
    few = scores.groupBy(*by, "score", "label").agg(F.count("*").alias("w"))
    each = few.select(*by, "score", "label", "w", F.explode(grid).alias("g"))
    mean = each.groupBy(*by, "g").agg((F.sum(nll(scaled(F.col("score"), F.col("g.temperature")), F.col("label")) * F.col("w")) / F.sum("w")).alias("nll"))
    best = mean.groupBy(*by).agg(F.min(F.struct(F.round("nll", 12).alias("nll"), F.col("g.k").alias("k"), F.col("g.temperature").alias("temperature"))).alias("b"))
    return best.select(*by, "b.k", "b.temperature", "b.nll")


def calibrate(scores: DataFrame, max_fpr: float) -> DataFrame:
    """cls, temperature, threshold: temperature first, then the threshold on scaled scores."""
    t = fit_temperature(scores).select("cls", "temperature")
    new = scores.join(t, "cls").withColumn("score", scaled(F.col("score"), F.col("temperature")))
    return t.join(threshold_under_budget(new, max_fpr), "cls")


def operating_sweep(scores: DataFrame, thresholds: DataFrame, factors: list[float]) -> DataFrame:
    """factor, cls, recall, fpr with every threshold multiplied by each factor."""
    many = thresholds.select("cls", F.explode(F.array(*map(F.lit, factors))).alias("factor"), "threshold").withColumn("threshold", F.col("threshold") * F.col("factor"))
    hit = (F.col("score") >= F.col("threshold")).cast("double")
    return scores.join(many, "cls").groupBy("factor", "cls").agg(F.avg(F.when(F.col("label") == 1, hit)).alias("recall"), F.avg(F.when(F.col("label") == 0, hit)).alias("fpr"))


def matched_point(sweep: DataFrame, target: float, by: tuple[str, ...] = ("cls",)) -> DataFrame:
    """The factor whose false-alarm rate is closest to the target, the smallest of ties."""
    best = F.min(F.struct(F.round(F.abs(F.col("fpr") - target), 9).alias("gap"), "factor", "recall", "fpr")).alias("b")
    return sweep.groupBy(*by).agg(best).select(*by, "b.factor", "b.recall", "b.fpr")


def background_sweep(scores: DataFrame, thresholds: DataFrame, factors: list[float]) -> DataFrame:
    """factor, recall_0, recall_1, recall_any, alarm with the thresholds of classes 0 and 1 multiplied by each factor in turn.

    alarm: share of images without any class on which any class alarms;
    recall_any: share of images with a class where one that is there is found.
    Null where there is nothing to divide by. How many of the ascending factors
    a score reaches says all about it, so images are counted by that number and
    only a few rows for each factor are left to be summed.
    """
    grid = sorted(factors)
    reached = F.size(F.filter(F.array(*map(F.lit, grid)), lambda f: F.col("score") >= F.col("threshold") * f))
    at = scores.join(F.broadcast(thresholds.select("cls", "threshold")), "cls").withColumn("g", reached)
    there = F.col("label") == 1
    of = lambda c: F.max(F.when(there & (F.col("cls") == c), F.col("g")))
    image = at.groupBy("image_id").agg(of(0).alias("recall_0"), of(1).alias("recall_1"), F.max(F.when(there, F.col("g"))).alias("recall_any"), F.when(F.max("label") == 0, F.max("g")).alias("alarm"))
    kinds = ("recall_0", "recall_1", "recall_any", "alarm")
    few = image.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("g")) for k in kinds))).alias("x")).select("x.*").filter("g is not null").groupBy("kind", "g").agg(F.count("*").alias("n"))
    every = scores.sparkSession.createDataFrame(list(enumerate(grid, 1)), "place int, factor double")
    rate = lambda k: (F.sum(F.when((F.col("kind") == k) & (F.col("g") >= F.col("place")), F.col("n")).otherwise(0)) / F.nullif(F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)), F.lit(0))).alias(k)
    return every.join(few, F.lit(True), "left").groupBy("factor").agg(*map(rate, kinds))


def background_matched(sweep: DataFrame, targets: list[float]) -> DataFrame:
    """target and the row of a background sweep whose alarm is closest to it, the smallest factor of ties."""
    row = F.struct(*sweep.columns)
    each = sweep.select(F.explode(F.array(*map(F.lit, targets))).alias("target"), row.alias("row"))
    best = F.min(F.struct(F.abs(F.col("row.alarm") - F.col("target")).alias("gap"), F.col("row.factor").alias("factor"), "row")).alias("b")
    return each.groupBy("target").agg(best).select("target", "b.row.*")


def draw(replicate: Column, number: Column, n: Column, seed: int) -> Column:
    """A unit in [0, n) for a draw of a replicate, by hash: any engine with MD5 makes the same."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), replicate, number)), 1, 12), 16, 10).cast("long") % n


def bootstrap(scores: DataFrame, thresholds: DataFrame, replicates: int, seed: int = 0) -> DataFrame:
    """cls, n_replicates, low, high: percentile interval of recall by class, as bootstrap_report has it."""
    return bootstrap_report(scores, thresholds, replicates, seed, background=False).select("cls", "n_replicates", "low", "high")


def bootstrap_report(scores: DataFrame, thresholds: DataFrame, replicates: int = 1000, seed: int = 0, background: bool = True) -> DataFrame:
    """metric, cls, n_replicates, low, high: percentile intervals of recall by class and of background_alarm_fraction (cls null), drawing scenes with replacement.

    Where all scenes are null, images are drawn; where some are, the query
    fails. One draw serves all metrics. Units are summed first, so a replicate
    draws rows of sums. Replicates with nothing to divide by are left out, by
    metric. Without ``background`` there is recall only, of the same draws. Units
    are numbered by ranges of their order.
    """
    hit = (F.col("score") >= F.col("threshold")).cast("long")
    at = scores.join(thresholds.select("cls", "threshold"), "cls").withColumn("hit", hit)
    known = at.agg(F.count("scene").alias("known"), F.count("*").alias("rows"))
    mixed = (F.col("known") > 0) & (F.col("known") < F.col("rows"))
    at = at.join(F.broadcast(known), F.when(mixed, F.raise_error(F.lit("some scenes are null: give all or none")).cast("boolean")).otherwise(True))
    # A unit is (scene, null) or (null, image).
    at = at.withColumn("image", F.when(F.col("known") == 0, F.col("image_id")))
    recall = at.select("scene", "image", F.lit("recall").alias("metric"), "cls", F.col("label").cast("long").alias("of"), (F.col("hit") * F.col("label")).alias("is"))
    images = at.groupBy("scene", "image", "image_id").agg(F.max("label").alias("any"), F.max("hit").alias("alarm"))
    alarm = images.select("scene", "image", F.lit("background_alarm_fraction").alias("metric"), F.lit(None).cast("int").alias("cls"), (1 - F.col("any")).cast("long").alias("of"), ((1 - F.col("any")) * F.col("alarm")).alias("is"))
    sums = (recall.unionByName(alarm) if background else recall).groupBy("scene", "image", "metric", "cls").agg(F.sum("of").alias("of"), F.sum("is").alias("is"))
    sums = sums.groupBy("scene", "image").agg(F.collect_list(F.struct("metric", "cls", "of", "is")).alias("sums"))
    unit, n = numbered(sums, "scene", "image")
    draws = unit.select("number", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    draws = draws.select("replicate", draw(F.col("replicate"), F.col("number"), F.lit(n), seed).alias("unit"))
    few = draws.groupBy("replicate", "unit").agg(F.count("*").alias("times"))
    drawn = few.join(unit.select(F.col("number").alias("unit"), "sums"), "unit").select("replicate", "times", F.explode("sums").alias("s")).select("replicate", "times", "s.*")
    each = drawn.groupBy("metric", "cls", "replicate").agg(F.sum(F.col("times") * F.col("is")).alias("is"), F.sum(F.col("times") * F.col("of")).alias("of")).filter("of > 0").withColumn("value", F.col("is") / F.col("of"))
    return each.groupBy("metric", "cls").agg(F.count("*").alias("n_replicates"), F.percentile("value", F.lit(0.025)).alias("low"), F.percentile("value", F.lit(0.975)).alias("high"))


def calibration_report(fit_on: DataFrame, scores: DataFrame, max_fpr: float) -> DataFrame:
    """cls, temperature, threshold from ``fit_on``, and of ``scores`` ece and brier before and after scaling, recall and fpr at the threshold."""
    c = cut(calibrate(fit_on, max_fpr))
    new = scores.join(c.select("cls", "temperature"), "cls").withColumn("score", scaled(F.col("score"), F.col("temperature")))
    named = lambda df, when: df.select("cls", F.col("ece").alias(f"ece_{when}"), F.col("brier").alias(f"brier_{when}"))
    out = c.select("cls", "temperature", "threshold").join(named(ece_brier(scores), "before"), "cls").join(named(ece_brier(new), "after"), "cls")
    return out.join(alarm_metrics(new, c).drop("n"), "cls")


def background_boxes(images: DataFrame, boxes: DataFrame, detections: DataFrame, thresholds: DataFrame) -> DataFrame:
    """n_background, false_boxes, per_image: detections at or over their class's threshold on images without any box; per_image null without such images."""
    none = images.join(boxes.select("image_id").distinct(), "image_id", "left_anti").select("image_id")
    over = detections.join(thresholds.select("cls", "threshold"), "cls").filter("conf >= threshold").groupBy("image_id").agg(F.count("*").alias("k"))
    got = none.join(over, "image_id", "left").agg(F.count("*").alias("n_background"), F.coalesce(F.sum("k"), F.lit(0)).alias("false_boxes"))
    return got.withColumn("per_image", F.try_divide("false_boxes", "n_background"))


def background_penalty(images: DataFrame, boxes: DataFrame, detections: DataFrame, k: int) -> DataFrame:
    """cls, n, penalty: on images without any box, the mean softplus of each image's k highest logits of a class, fewer where it has fewer; ties by detection."""
    none = images.select("image_id").join(boxes.select("image_id").distinct(), "image_id", "left_anti")
    own = Window.partitionBy("image_id", "cls").orderBy(F.desc("conf"), "det_idx")
    top = detections.join(none, "image_id").withColumn("_k", F.row_number().over(own)).filter(F.col("_k") <= k)
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("conf")))
    return top.groupBy("cls").agg(F.count("*").alias("n"), F.avg(-F.log1p(-p)).alias("penalty"))  # softplus of the logit of p


def endpoints(scores: DataFrame, thresholds: DataFrame, by: list[str]) -> DataFrame:
    """by, endpoint, value: recall and fpr of each class, background alarm, ece and brier of each class; absent where there is nothing to divide by."""
    at = cut(scores.join(thresholds.select("cls", "threshold"), "cls").withColumn("hit", (F.col("score") >= F.col("threshold")).cast("double")))
    rate = lambda label: F.avg(F.when(F.col("label") == label, F.col("hit")))
    kinds = ("recall", "fpr")
    each = at.groupBy(*by, "cls").agg(rate(1).alias("recall"), rate(0).alias("fpr")).unpivot([*by, "cls"], list(kinds), "kind", "value")
    other = ece_brier(at, by=(*by, "cls")).unpivot([*by, "cls"], ["ece", "brier"], "kind", "value")
    named = each.unionByName(other).select(*by, F.concat("kind", F.lit("_"), "cls").alias("endpoint"), "value")
    image = at.groupBy(*by, "image_id").agg(F.max("label").alias("any"), F.max("hit").alias("alarm")).filter("any = 0")
    alarm = image.groupBy(*by).agg(F.avg("alarm").alias("value")).select(*by, F.lit("background_alarm").alias("endpoint"), "value")
    return named.unionByName(alarm).filter("value is not null")


def effects_by_endpoint(values: DataFrame, parents: DataFrame) -> DataFrame:
    """config, parent, endpoint, n, effect, sd, mdd of rows (config, seed, endpoint, value) against a parent (config, parent), paired by seed; sd and mdd null with one pair, mdd null where nothing varies."""
    base = values.select(F.col("config").alias("parent"), "seed", "endpoint", F.col("value").alias("base"))
    d = values.join(parents, "config").join(base, ["parent", "seed", "endpoint"]).withColumn("d", F.col("value") - F.col("base"))
    got = d.groupBy("config", "parent", "endpoint").agg(F.count("*").alias("n"), F.avg("d").alias("effect"), F.stddev_samp("d").alias("sd"))
    return got.withColumn("mdd", F.when((F.col("n") > 1) & (F.col("sd") > 0), mdd(F.col("sd"), F.col("n"))))


def transfer(source: DataFrame, target: DataFrame, thresholds: DataFrame) -> DataFrame:
    """cls, and recall and fpr of source and target at the same thresholds, which the target has no part in."""
    named = lambda df, name: alarm_metrics(df, thresholds).select("cls", F.col("recall").alias(f"{name}_recall"), F.col("fpr").alias(f"{name}_fpr"))
    return named(source, "source").join(named(target, "target"), "cls", "full_outer")
