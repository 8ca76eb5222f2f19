"""Variance between seeds, minimum detectable effects, effects against a reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import mdd, t_critical


def variance_decomposition(runs: DataFrame, by: str = "config") -> DataFrame:
    """by, n, sd (between seeds, of best), plateau_sd (mean within runs), ratio, se, mdd from rows (by, best, sd)."""
    got = runs.groupBy(by).agg(F.count("best").alias("n"), F.stddev_samp("best").alias("between"), F.avg("sd").alias("plateau_sd"))
    return got.select(by, "n", "between", "plateau_sd", F.try_divide("plateau_sd", "between").alias("ratio"), (F.col("between") / F.sqrt("n")).alias("se"), F.when(F.col("n") > 1, mdd(F.col("between"), F.col("n"))).alias("mdd"))


def paired_effects(runs: DataFrame, reference: int, by: str = "config") -> DataFrame:
    """by, n, mean, mdd, significant: differences to the reference run of the same seed; mdd and significant null with one pair.

    Where no seed is shared, mean is the difference of the two means, n is 0
    (no pairs), and mdd and significant are null.
    """
    ref = runs.filter((F.col(by) == reference) & F.col("best").isNotNull()).select("seed", F.col("best").alias("ref"))
    rest = runs.filter(F.col(by) != reference)
    d = rest.join(ref, "seed", "left").withColumn("d", F.col("best") - F.col("ref"))
    got = d.groupBy(by).agg(F.count("d").alias("n"), F.avg("d").alias("paired"), F.stddev_samp("d").alias("sd"), F.avg("best").alias("own"))
    got = got.join(ref.agg(F.avg("ref").alias("other")), F.lit(True)).withColumn("mean", F.when(F.col("n") > 0, F.col("paired")).otherwise(F.col("own") - F.col("other"))).filter("mean is not null")
    least = F.when(F.col("n") > 1, mdd(F.col("sd"), F.col("n")))
    return got.select(by, "n", "mean", least.alias("mdd"), (F.abs("mean") > least).alias("significant"))


def seed_summary(runs: DataFrame, by: list[str], value: str = "best", seeds: int = 3) -> DataFrame:
    """by, n, mean, sd of groups with exactly the expected number of distinct seeds, each once."""
    got = runs.groupBy(*by).agg(F.count("*").alias("n"), F.countDistinct("seed").alias("_s"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return got.filter((F.col("_s") == seeds) & (F.col("n") == seeds)).drop("_s")


def interval(n: str, mean: str, sd: str) -> tuple:
    """Bounds of the 95 % interval of a mean."""
    half = t_critical(F.col(n) - 1) * F.col(sd) / F.sqrt(n)
    return F.col(mean) - half, F.col(mean) + half
