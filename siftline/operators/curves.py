"""Learning curves (run, epoch, metric): best and last epochs, plateaus, alignment, frontiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranges import ranged


def best_and_last(curves: DataFrame, by: str = "run") -> DataFrame:
    """by, best_epoch, best, last_epoch, last, n; the first of equal bests."""
    w = Window.partitionBy(by)
    at = curves.withColumn("_b", F.row_number().over(w.orderBy(F.desc("metric"), "epoch"))).withColumn("_l", F.row_number().over(w.orderBy(F.desc("epoch"))))
    pick = lambda mark, col: F.max(F.when(F.col(mark) == 1, F.col(col)))
    return at.groupBy(by).agg(pick("_b", "epoch").alias("best_epoch"), pick("_b", "metric").alias("best"), pick("_l", "epoch").alias("last_epoch"), pick("_l", "metric").alias("last"), F.count("*").alias("n"))


def plateau(curves: DataFrame, fraction: float = 0.2, by: str = "run") -> DataFrame:
    """The last max(3, round(n fraction)) rows, halves to even: k, mean, sd, slope, drift (last - first), gap (best - mean)."""
    w = Window.partitionBy(by)
    at = curves.select(by, "epoch", "metric", F.row_number().over(w.orderBy(F.desc("epoch"))).alias("r"), F.count("*").over(w).alias("n"), F.max("metric").over(w).alias("top"))
    k = F.greatest(F.lit(3), F.bround(F.col("n") * fraction).cast("int"))
    tail = at.withColumn("k", k).filter("r <= k")
    first, last = F.max(F.when(F.col("r") == F.least("k", "n"), F.col("metric"))), F.max(F.when(F.col("r") == 1, F.col("metric")))
    return tail.groupBy(by, "k").agg(F.avg("metric").alias("mean"), F.stddev_samp("metric").alias("sd"), F.regr_slope("metric", "epoch").alias("slope"), (last - first).alias("drift"), (F.max("top") - F.avg("metric")).alias("gap"))


def tail_slope(curves: DataFrame, rows: int = 10, by: str = "run") -> DataFrame:
    """by, slope over the last rows with a metric; null with fewer than three."""
    w = Window.partitionBy(by).orderBy(F.desc("epoch"))
    tail = curves.filter("metric is not null").withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= rows)
    return tail.groupBy(by).agg(F.when(F.count("*") >= 3, F.regr_slope("metric", "epoch")).alias("slope"))


def window_means(curves: DataFrame, windows: list[tuple[str, int, int]], by: str = "run") -> DataFrame:
    """by, window, mean, n over epochs low to high, both included."""
    spans = F.filter(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(a).alias("low"), F.lit(z).alias("high")) for n, a, z in windows)), lambda s: (F.col("epoch") >= s["low"]) & (F.col("epoch") <= s["high"]))
    return curves.select(by, "metric", F.explode(spans).alias("s")).groupBy(by, F.col("s.name").alias("window")).agg(F.avg("metric").alias("mean"), F.count("*").alias("n"))


def missing_epochs(curves: DataFrame, by: str = "run") -> DataFrame:
    """Epochs from 1 to a run's last that have no row."""
    return epoch_gaps(curves, by).select(by, F.explode(F.sequence("first", "last")).alias("epoch"))


def epoch_gaps(curves: DataFrame, by: str = "run") -> DataFrame:
    """by, first, last of each stretch of epochs from 1 on that has no row: one row however long, as after an epoch number gone wrong."""
    before = F.coalesce(F.lag("epoch").over(Window.partitionBy(by).orderBy("epoch")), F.lit(0))
    at = curves.filter("epoch >= 1").select(by, "epoch").distinct().withColumn("first", (before + 1).cast(curves.schema["epoch"].dataType))
    return at.filter("epoch > first").select(by, "first", (F.col("epoch") - 1).cast(curves.schema["epoch"].dataType).alias("last"))


def same_epoch(curves: DataFrame, a: str, b: str, on: list[str], by: str = "seed") -> DataFrame:
    """Two kinds of runs side by side by epoch, null where one has no row."""
    x = curves.filter(F.col(by) == a).select(*on, "epoch", F.col("metric").alias("a"))
    return x.join(curves.filter(F.col(by) == b).select(*on, "epoch", F.col("metric").alias("b")), [*on, "epoch"], "full_outer")


def nearest_step(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Each left row (on, step) with the right row (on, step, epoch, metric) of the closest step; the earliest epoch of ties.

    Both sides stand in one order of key and step, cut into ranges. In a range
    a running value holds the right row last met, from either end; what a range
    has none of comes from a table of the ranges' first and last right rows. So
    a key with any number of steps is many tasks, and a row looks at two others.
    Left rows whose key the right side lacks are left out, null keys too.
    """
    known = " and ".join(f"`{c}` is not null" for c in ["step", *on])
    one = right.filter(known).groupBy(*on, "step").agg(F.min(F.struct("epoch", "metric")).alias("_r"))
    row, none = F.struct(*left.columns), lambda c, kind: F.lit(None).cast(kind).alias(c)
    kind_l, kind_r = left.select(row.alias("x")).schema["x"].dataType, one.schema["_r"].dataType
    both = left.filter(known).select(*on, "step", row.alias("_l"), none("_r", kind_r)).unionByName(one.select(*on, "step", none("_l", kind_l), "_r"))
    at = ranged(both.withColumn("_s", F.monotonically_increasing_id()), *on, "step", "_s")
    met = F.when(F.col("_r").isNotNull(), F.struct("step", F.col("_r.epoch").alias("epoch"), F.col("_r.metric").alias("metric")))
    at = at.withColumn("_m", met)
    within, order = Window.partitionBy(*on, "_range"), [F.col("step"), F.col("_s")]
    so_far = lambda *o: within.orderBy(*o).rowsBetween(Window.unboundedPreceding, 0)
    at = at.withColumns({"_before": F.last("_m", True).over(so_far(*order)), "_after": F.last("_m", True).over(so_far(*(c.desc() for c in order)))})
    ends = at.filter("_m is not null").groupBy(*on, "_range").agg(F.max("_m").alias("_high"), F.min("_m").alias("_low"))
    cells = at.select(*on, "_range").distinct().join(ends, [*on, "_range"], "left")
    other = lambda o: Window.partitionBy(*on).orderBy(o).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*on, "_range", F.last("_high", True).over(other(F.asc("_range"))).alias("_lower"), F.last("_low", True).over(other(F.desc("_range"))).alias("_upper"))
    near = at.filter("_l is not null").join(cells, [*on, "_range"])
    gap = lambda c: F.when(c.isNotNull(), F.struct(F.abs(c["step"] - F.col("step")).alias("gap"), c["epoch"].alias("epoch"), c["step"].alias("step"), c["metric"].alias("metric")))
    best = F.least(gap(F.coalesce("_before", "_lower")), gap(F.coalesce("_after", "_upper")))
    got = near.select("_l", best.alias("_b")).filter("_b is not null")
    return got.select("_l.*", F.col("_b.epoch").alias("near_epoch"), F.col("_b.step").alias("near_step"), F.col("_b.metric").alias("near_metric"), F.col("_b.gap").alias("gap"))


def pareto(rows: DataFrame, cost: str, value: str, by: list[str], tie: str) -> DataFrame:
    """Rows in order of cost that beat every cheaper one; the first always. ``by`` may be empty for a few rows only."""
    w = Window.partitionBy(*by).orderBy(cost, F.desc(value), tie)
    before = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_b", before).filter(F.col("_b").isNull() | (F.col(value) > F.col("_b"))).drop("_b")


def running_best(curves: DataFrame, by: str = "run") -> DataFrame:
    """Rows that are strictly lower than all before: when a held-out loss improves."""
    w = Window.partitionBy(by).orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    return curves.withColumn("_m", F.min("metric").over(w)).filter(F.col("_m").isNull() | (F.col("metric") < F.col("_m"))).drop("_m")
