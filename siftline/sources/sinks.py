"""Writers: nothing is overwritten, nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def without_nan(df: DataFrame) -> DataFrame:
    """Fails at run time on NaN or an infinity in a top-level number."""
    def check(c: str):
        bad = F.isnan(c) | (F.abs(c) == float("inf"))
        return F.when(bad, F.raise_error(F.lit(f"{c} is not finite"))).otherwise(F.col(c)).alias(c)

    return df.select(*(check(f.name) if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name) for f in df.schema))


def write_json(df: DataFrame, path: str) -> None:
    without_nan(df).write.mode("errorifexists").json(path)


def write_prepared(manifest: DataFrame, path: str, by: tuple[str, ...] = ("split",)) -> None:
    """A dataset version: Parquet, a folder per split (and subset)."""
    manifest.write.mode("errorifexists").partitionBy(*by).parquet(path)


def write_split_lists(manifest: DataFrame, path: str, order: str = "id") -> None:
    """One path a line for each split, in order: rows are range-sorted, so part files read one after another are in order."""
    manifest.select("split", order, "prepared_image").repartitionByRange("split", order).sortWithinPartitions("split", order).select("split", F.col("prepared_image").alias("value")).write.mode("errorifexists").partitionBy("split").text(path)


def write_report(df: DataFrame, path: str, order: list, most: int = 200_000) -> None:
    """A CSV report of the first rows in an order; the limit is the report's."""
    df.orderBy(*order).limit(most).coalesce(1).write.mode("errorifexists").option("header", "true").csv(path)


def markdown(df: DataFrame, most: int = 200) -> str:
    """A small result as a Markdown table."""
    rows = [df.columns, ["---"] * len(df.columns), *(["" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r] for r in df.take(most))]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)
