"""Pearson, Spearman and partial correlation; binned means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.ranges import running_sums


def with_average_rank(df: DataFrame, col: str, by: list[str], name: str) -> DataFrame:
    """df with the rank of a column, ties averaged, by group. Distinct values are ranked, by ranges, and joined back."""
    values = df.groupBy(*by, col).agg(F.count("*").alias("_n"))
    run = running_sums(values, by, col, [], {"_upto": F.col("_n")}, descending=False)
    rank = run.select(*by, col, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(name))
    return df.join(rank, [*by, col])


def correlations(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """by, n, pearson, spearman; null where a side does not vary."""
    ranked = df.select(*by, F.col(x).alias("x"), F.col(y).alias("y")).filter("x is not null and y is not null")
    ranked = with_average_rank(with_average_rank(cut(ranked), "x", by, "rx"), "y", by, "ry")
    safe = lambda a, b: F.when((F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0), F.corr(a, b))
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), safe("x", "y").alias("pearson"), safe("rx", "ry").alias("spearman"))


def partial(xy: Column, xz: Column, yz: Column) -> Column:
    """Correlation of x and y without what z explains."""
    return F.try_divide(xy - xz * yz, F.sqrt((1 - xz * xz) * (1 - yz * yz)))


def binned_mean(df: DataFrame, x: str, y: str, bins: int, by: list[str]) -> DataFrame:
    b = F.least(F.floor(F.col(x) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"), F.avg(y).alias("mean"))
