"""Gates: set equality, inventories, tampering, comparability; each gives the rows that break it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """side, key of what stands on one side only; no rows: the sets are equal."""
    on = lambda df, a, b: df.select(key, F.lit(a).alias("_a"), F.lit(b).alias("_b"))
    # One grouping of both sides, which holds a key once, not two joins of distinct keys. A null equals no key, so it stands apart on each side that has it.
    both = on(left, True, False).unionByName(on(right, False, True)).groupBy(key).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    alone = both.filter((F.col("_a") != F.col("_b")) | F.col(key).isNull())
    sides = F.filter(F.array(F.when(F.col("_a"), "left"), F.when(F.col("_b"), "right")), lambda s: s.isNotNull())
    return alone.select(F.explode(sides).alias("side"), key)


def bag_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that occur more often on one side, with side; fingerprints of two versions are equal when there are none."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def inventory_faults(images: DataFrame, labels: DataFrame, on: list[str]) -> DataFrame:
    """Images without a label file, labels without an image, keys that repeat."""
    i, l = images.select(*on, F.lit(1).alias("_i")), labels.select(*on, F.lit(1).alias("_l"))  # noqa: E741
    both = i.join(l, on, "full_outer")
    missing = both.filter("_i is null or _l is null").select(*on, F.when(F.col("_i").isNull(), "label_without_image").otherwise("image_without_label").alias("fault"))
    twice = images.groupBy(*on).count().filter("count > 1").select(*on, F.lit("repeated").alias("fault"))
    return missing.unionByName(twice)


def changed(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """key, fault (removed, added, changed) between two digests of the same inventory; a null digest counts as changed."""
    b, a = before.select(key, F.col(digest).alias("_b"), F.lit(1).alias("_hb")), after.select(key, F.col(digest).alias("_a"), F.lit(1).alias("_ha"))
    fault = F.when(F.col("_ha").isNull(), "removed").when(F.col("_hb").isNull(), "added").when(F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)), None).otherwise("changed")
    return b.join(a, key, "full_outer").select(key, fault.alias("fault")).filter("fault is not null")


def not_comparable(runs: DataFrame, on: list[str], fields: list[str], sides: str = "method") -> DataFrame:
    """Pairs of runs that differ in a field or lack it: missing evidence counts as failure."""
    x, y = runs.alias("x"), runs.alias("y")
    pairs = x.join(y, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in on] + [F.col(f"x.{sides}") < F.col(f"y.{sides}")])
    faults = F.filter(F.array(*(F.when(~F.coalesce(F.col(f"x.{c}") == F.col(f"y.{c}"), F.lit(False)), F.lit(c)) for c in fields)), lambda c: c.isNotNull())
    return pairs.select(*(F.col(f"x.{c}").alias(c) for c in on), F.col(f"x.{sides}").alias("a"), F.col(f"y.{sides}").alias("b"), faults.alias("faults")).filter(F.size("faults") > 0)


def require_none(df: DataFrame, what: str) -> None:
    """Raise if a gate has rows; shows a few."""
    if rows := df.take(5):
        raise ValueError(f"{what}: {[r.asDict() for r in rows]}")
