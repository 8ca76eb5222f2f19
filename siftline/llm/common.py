"""Shared helpers: the shared work folder, lineage cuts, ASCII white space."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The characters that separate words: space, tab, LF, VT, FF, CR.
WS = " \t\n\x0b\x0c\r"
WS_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, as a full URI (a path without a scheme lies in the default file system).

    Only where the session sets none and Spark runs in one process (tests, one
    machine) is a local one made; on a cluster that is an error.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not base:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="siftline-")
        spark.conf.set("spark.checkpoint.dir", base)
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(base)
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    full = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + full.removeprefix("file:") if full.startswith("file:/") and not full.startswith("file://") else full


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A new folder name below the shared folder, as a URI."""
    return f"{shared_dir(spark).rstrip('/')}/siftline-{what}-{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder, and go on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tasks that read files back, at most; beyond it a task reads several.
MAX_READERS = 20_000


def one_each(files: DataFrame) -> DataFrame:
    """The rows of a manifest, dealt out in turn to as many tasks as there are rows, or MAX_READERS."""
    return files.coalesce(1).repartition(max(1, min(files.count(), MAX_READERS)))
