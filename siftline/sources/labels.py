"""Label text: five fields a line (class x y w h), strict and lenient."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Canonical class order; sources may use another and say so.
NAMES = ("fire", "smoke")


def parse_labels(lines: DataFrame, source_names: list[str], id_: str = "image_id", mode: str = "strict", also: tuple[str, ...] = (), text: str = "line") -> DataFrame:
    """id, the columns ``also``, cls, x, y, w, h, reason for each line (column ``text``) that isn't blank.

    cls is the canonical class. reason names the first fault that applies
    (field_count, not_finite, class, invalid_normalized_box, zero_area_box),
    else is null; boxes over the border are no fault. lenient drops faulty
    lines and takes more than five fields.
    """
    f = F.split(F.trim(text), r"\s+")
    v = [F.try_element_at(f, F.lit(i + 1)).try_cast("double") for i in range(5)]
    at = lines.filter(F.trim(text) != "").select(id_, *also, F.size(f).alias("n"), *(x.alias(c) for x, c in zip(v, ("c", "x", "y", "w", "h"), strict=True)))
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    any_bad = bad("c") | bad("x") | bad("y") | bad("w") | bad("h")
    count = F.col("n") != 5 if mode == "strict" else F.col("n") < 5
    order = F.array(*(F.lit(NAMES.index(n)) for n in source_names))
    wrong = (F.col("c") != F.floor("c")) | (F.col("c") < 0) | (F.col("c") >= len(source_names))
    outside = F.greatest("x", "y", "w", "h") > 1
    outside |= F.least("x", "y", "w", "h") < 0
    reason = F.when(count, "field_count").when(any_bad, "not_finite").when(wrong, "class").when(outside, "invalid_normalized_box").when((F.col("w") == 0) | (F.col("h") == 0), "zero_area_box")
    out = at.withColumn("reason", reason).select(id_, *also, F.when(F.col("reason").isNull(), F.get(order, F.col("c").try_cast("int"))).alias("cls"), "x", "y", "w", "h", "reason")
    return out if mode == "strict" else out.filter("reason is null").drop("reason")


def read_label_files(spark: SparkSession, path: str, source_names: list[str], mode: str = "strict") -> DataFrame:
    """Every label file below a folder; image_id is the file's stem, which another split may have too: versions.inventory tells them apart. An empty file has no rows here and is a background image in its inventory."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(path).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.txt$", 1).alias("image_id"), F.col("value").alias("line"))
    return parse_labels(text, source_names, mode=mode)


def apply_policy(images: DataFrame, parsed: DataFrame, policy: str, id_: str = "image_id") -> DataFrame:
    """images with excluded: ``error`` raises on any fault, ``exclude_invalid_images`` marks the whole image, never one box."""
    faults = parsed.filter("reason is not null").groupBy(id_).agg(F.count("*").alias("_n"))
    if policy == "error":
        if not faults.isEmpty():
            raise ValueError("faulty labels")
        return images.withColumn("excluded", F.lit(False))
    if policy != "exclude_invalid_images":
        raise ValueError(f"unknown policy {policy}")
    return images.join(faults, id_, "left").withColumn("excluded", F.col("_n").isNotNull()).drop("_n")
