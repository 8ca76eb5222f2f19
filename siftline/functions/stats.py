"""Student t, minimum detectable effects, quantile conventions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import cut
from .ranges import running_sums

#: Two-sided 5 % points of Student's t for 1 to 30 degrees of freedom; fixed values.
T_CRITICAL = (12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131,
              2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042)


def t_critical(df: Column) -> Column:
    """The table up to 30; beyond it the Cornish-Fisher expansion around 1.96; infinite at 0 or less."""
    z = 1.959964
    g1, g2 = (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96
    d = df.cast("double")
    return F.when(df <= 0, F.lit(float("inf"))).when(df <= 30, F.element_at(F.array(*map(F.lit, T_CRITICAL)), F.greatest(df, F.lit(1)).cast("int"))).otherwise(z + g1 / d + g2 / (d * d))


def mdd(sigma: Column, n: Column) -> Column:
    """Smallest mean difference that n runs of this deviation can show."""
    return t_critical(n - 1) * sigma / F.sqrt(n)


def required_n(spark: SparkSession, targets: DataFrame, most: int = 5000) -> DataFrame:
    """For each row (sigma, target) the smallest n of 2 to ``most`` with mdd <= target, null if none; beside the row's columns."""
    factors = spark.range(2, most + 1).select(t_critical(F.col("id").cast("int") - 1) / F.sqrt("id"))
    table = [r[0] for r in factors.collect()]  # ``most`` numbers, falling
    # Bisection over a constant array: the smallest place whose factor is small enough.
    at = F.from_json(F.lit(json.dumps(table)), "array<double>")

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["low"] + s["high"]) / 2).cast("int")
        fits = F.coalesce(F.get(at, mid) * F.col("sigma") <= F.col("target"), F.lit(False))
        done = s["low"] >= s["high"]
        return F.struct(F.when(done | fits, s["low"]).otherwise(mid + 1).cast("int").alias("low"), F.when(done | ~fits, s["high"]).otherwise(mid).cast("int").alias("high"))

    rounds = F.array(*map(F.lit, range(len(table).bit_length() + 1)))
    found = F.aggregate(rounds, F.struct(F.lit(0).alias("low"), F.lit(len(table)).alias("high")), step)["low"]
    return targets.withColumn("n", F.when(found < len(table), found + 2))


def _ranked(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, v (distinct values), c (rows that have it), upto (rows up to it), n (all rows)."""
    # Written once: the ranges read it twice, to sample their borders, and the counts once more.
    values = cut(df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("c")))
    run = running_sums(values, by, "v", [], {"upto": F.col("c")}, descending=False)
    return run.join(values.groupBy(*by).agg(F.sum("c").alias("n")), by)


def linear_quantiles(df: DataFrame, by: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """by and a column for each name: quantiles by linear interpolation, of one ranking by ranges."""
    ranked = _ranked(df, by, value)
    at = lambda k: F.max(F.when((k < F.col("upto")) & (k >= F.col("upto") - F.col("c")), F.col("v")))

    def one(q: float) -> Column:
        place = (F.col("n") - 1) * q
        low = at(F.floor(place))
        return low + (at(F.ceil(place)) - low) * F.max(place - F.floor(place))

    return ranked.groupBy(*by).agg(*(one(q).alias(k) for k, q in qs.items()))


def quantiles(df: DataFrame, by: list[str], value: str, q: float) -> DataFrame:
    """One quantile by each of the five conventions in use: linear interpolation, nearest rank (halves to even), floor(n q), upper median, floor(q (n - 1))."""
    ranked = _ranked(df, by, value)
    at = lambda k: F.max(F.when((k < F.col("upto")) & (k >= F.col("upto") - F.col("c")), F.col("v")))
    n = F.col("n")
    place = (F.col("n") - 1) * q
    low, part = at(F.floor(place)), F.max(place - F.floor(place))
    return ranked.groupBy(*by).agg(
        (low + (at(F.ceil(place)) - low) * part).alias("linear"), at(F.bround((n - 1) * q).cast("int")).alias("nearest"), at(F.least(n - 1, F.floor(n * q))).alias("floor_n"),
        at(F.floor(n / 2)).alias("upper_median"), at(F.floor((n - 1) * q)).alias("floor_n1"),
    )
