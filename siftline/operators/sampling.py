"""Hash-defined partitions and samples, replication of negatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import sha_mod


def hash_partition(df: DataFrame, id_: str, folds: int, salt: str = "") -> DataFrame:
    """Adds fold: the salted id's SHA-256 modulo the number of folds; fold 0 is held out."""
    return df.withColumn("fold", sha_mod(F.concat(F.lit(salt), F.col(id_).cast("string")), folds).cast("int"))


def stratified_sample(df: DataFrame, strata: str, id_: str, n: int, salt: str = "") -> DataFrame:
    """The first n of each stratum in the order of the salted id's SHA-256; the same rows on any engine."""
    w = Window.partitionBy(strata).orderBy(F.sha2(F.concat(F.lit(salt), F.col(id_).cast("string")), 256), id_)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def oversample_negatives(images: DataFrame, repeats: int, negative: str = "negative") -> DataFrame:
    """Train negatives ``repeats`` times (column copy), everything else once; val and test never more than once."""
    times = F.when((F.col("split") == "train") & F.col(negative), repeats).otherwise(1)
    return images.withColumn("copy", F.explode(F.sequence(F.lit(1), times)))
