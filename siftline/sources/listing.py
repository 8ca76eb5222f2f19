"""Listing folders in tasks: the driver holds folder names only, never those of files."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut

_ROWS = "path string, folder boolean, length long, modificationTime timestamp"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Spark's file sources spell it (local ones with one slash)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def _opened(uri: str) -> tuple[object, str, str]:
    """File system, path in it, and what stands before the path in the URI."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return LocalFileSystem(), "/" + rest.lstrip("/"), "file:"
    fs, path = FileSystem.from_uri(uri)
    return fs, path, uri.removesuffix(path)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow.fs import FileSelector, FileType

    schema = pa.schema([("path", pa.string()), ("folder", pa.bool_()), ("length", pa.int64()), ("modificationTime", pa.timestamp("us", "UTC"))])
    for b in batches:
        for uri in b.column(0).to_pylist():
            fs, path, at = _opened(uri)
            found = fs.get_file_info(FileSelector(path, recursive=False))
            for k in range(0, len(found), 10_000):
                rows = [(at + f.path, f.type == FileType.Directory, f.size or 0, f.mtime or datetime.fromtimestamp(0, timezone.utc)) for f in found[k : k + 10_000]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, length, modificationTime of every file below a folder, empty ones too; hidden ones (., _) are left out, as by Spark's readers.

    A job for each level of folders, a task for each folder. A missing folder
    is an error.
    """
    folders, parts = [qualified(spark, path).rstrip("/")], []
    while folders:
        here = spark.createDataFrame([(f,) for f in folders], "path string").repartition(min(len(folders), 1000), "path")
        found = cut(here.mapInArrow(_listed, _ROWS).filter(~F.regexp_extract("path", "([^/]*)$", 1).rlike("^[._]")))
        parts.append(found.filter("not folder").drop("folder"))
        folders = [r["path"] for r in found.filter("folder").select("path").collect()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
