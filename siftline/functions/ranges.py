"""Places and running sums over a whole group without ranking the group in one task.

Rows are dealt out by ranges of the order, whose borders Spark samples, so that
ranges are about equally deep however the values crowd; where the order has ties
broken, a single value that many rows share is cut as well. Sums by range are a
small table, whose running sums say what stands before each range; the rest is
work within a range. Results do not depend on where the borders are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut, written

_BEFORE = (Window.unboundedPreceding, -1)
_SO_FAR = (Window.unboundedPreceding, 0)


def ranged(rows: DataFrame, *order: str | Column, name: str = "_range") -> DataFrame:
    """rows with the number of their range, which never falls along the order; written once, as another run would sample other borders."""
    return written(rows.repartitionByRange(*order).withColumn(name, F.spark_partition_id()))


def running_sums(rows: DataFrame, by: list[str], score: str, ties: list[str], values: dict[str, Column], descending: bool = True) -> DataFrame:
    """rows, ``_range`` and for each name the sum of its value over the group's rows up to this one, itself included.

    The order is by score and then by ``ties``, ascending; ``_range`` rises
    along it. Group columns are not null.
    """
    way = F.desc if descending else F.asc
    return sums_in_ranges(ranged(rows, *by, way(score), *ties), by, score, ties, values, descending)


def sums_in_ranges(at: DataFrame, by: list[str], score: str, ties: list[str], values: dict[str, Column], descending: bool = True) -> DataFrame:
    """running_sums of rows that have their ``_range`` already, such as some of those that were ranked before; ``at`` is read twice."""
    way = F.desc if descending else F.asc
    sums = at.groupBy(*by, "_range").agg(*(F.sum(v).alias(f"_s_{n}") for n, v in values.items()))
    over = Window.partitionBy(*by).orderBy("_range").rowsBetween(*_BEFORE)
    before = sums.select(*by, "_range", *(F.coalesce(F.sum(f"_s_{n}").over(over), F.lit(0)).alias(f"_b_{n}") for n in values))
    inner = Window.partitionBy(*by, "_range").orderBy(way(score), *ties).rowsBetween(*_SO_FAR)
    both = at.join(before, [*by, "_range"])
    return both.select(*(c for c in at.columns if c != "_range"), "_range", *((F.sum(v).over(inner) + F.col(f"_b_{n}")).alias(n) for n, v in values.items()))


def numbered(rows: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """rows with ``number``, their place in the order from 0 on, and how many there are. Of the ranges a count each comes to the driver."""
    dealt = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    counts = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).collect()
    starts, total = [], 0
    for r in sorted(counts):
        starts.append((r["_part"], total))
        total += r["n"]
    before = F.broadcast(rows.sparkSession.createDataFrame(starts, "_part long, _before long"))  # a row for each range
    within = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.withColumn("_part", part).join(before, "_part").select(*rows.columns, (within + F.col("_before")).alias("number")), total
