"""Logs that grow: whole lines from where the last batch ended, whatever was appended since.

Spark's file source takes a file once and whole; a log that is being written
needs a place in every file. The offset of a batch is, for each file, the byte
after its last whole line; a last line without an end waits. A restart goes on
from the offsets in the query's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources.listing import _opened, qualified

_CHUNK = 1 << 20
SCHEMA = "path string, position long, line string"


class _Part(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


class _Reader(DataSourceStreamReader):
    def __init__(self, folder: str, suffix: str, split_bytes: int) -> None:
        self.folder, self.suffix, self.split_bytes = folder, suffix, split_bytes
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """By file the end of its last whole line; only what came since the last look is searched."""
        from pyarrow.fs import FileSelector, FileType

        fs, top, at = _opened(self.folder)
        out = {}
        for f in sorted(fs.get_file_info(FileSelector(top, recursive=True)), key=lambda f: f.path):
            if f.type == FileType.File and f.base_name[0] not in "._" and f.base_name.endswith(self.suffix):
                out[at + f.path] = self._whole(fs, f.path, self.known.get(at + f.path, 0), f.size)
        self.known = out
        return out

    @staticmethod
    def _whole(fs, path: str, low: int, high: int) -> int:
        """The byte after the last line end in [low, high); low where there is none. A file that is shorter than it was is another one."""
        low = 0 if high < low else low
        if high == low:
            return low
        with fs.open_input_file(path) as f:
            while high > low:
                start = max(low, high - _CHUNK)
                found = f.read_at(high - start, start).rfind(b"\n")
                if found >= 0:
                    return start + found + 1
                high = start
        return low

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """Ranges of bytes, cut at ``split_bytes``; a line belongs to the range that it begins in. A file that shrank was replaced and is read from its start."""
        out = []
        for path, stop in sorted(end.items()):
            at = start.get(path, 0)
            at = 0 if stop < at else at
            out += [_Part(path, k, min(k + self.split_bytes, stop)) for k in range(at, stop, self.split_bytes)]
        return [_Bounded(p, end[p.path], start.get(p.path, 0) if end[p.path] >= start.get(p.path, 0) else 0) for p in out]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        fs, path, _ = _opened(partition.path)
        schema = pa.schema([("path", pa.string()), ("position", pa.int64()), ("line", pa.string())])
        rows: list[tuple[str, int, str]] = []
        with fs.open_input_file(path) as f:
            at = partition.start
            if at > partition.first and f.read_at(1, at - 1) != b"\n":
                at = _next(f, at, partition.last)
            f.seek(at)
            left = b""
            while at < partition.end or left:
                data = left + f.read(min(_CHUNK, partition.last - at - len(left)))
                if not data:
                    break
                while at < partition.end and (k := data.find(b"\n")) >= 0:
                    rows.append((partition.path, at, data[:k].removesuffix(b"\r").decode("utf-8", "replace")))
                    at, data = at + k + 1, data[k + 1 :]
                    if len(rows) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows = []
                if at >= partition.end:
                    break
                left = data
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


class _Bounded(_Part):
    """A range, where its file's batch begins and ends."""

    def __init__(self, part: _Part, last: int, first: int) -> None:
        super().__init__(part.path, part.start, part.end)
        self.last, self.first = last, first


def _next(f, at: int, last: int) -> int:
    """The byte after the next line end from ``at`` on."""
    while at < last:
        data = f.read_at(min(_CHUNK, last - at), at)
        if (k := data.find(b"\n")) >= 0:
            return at + k + 1
        at += len(data)
    return last


class Tail(DataSource):
    """Options: path (a URI), suffix, splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "siftline_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        return _Reader(self.options["path"], self.options.get("suffix", ""), int(self.options.get("splitbytes", 64 << 20)))


def lines(spark: SparkSession, folder: str, suffix: str = ".jsonl", split_bytes: int = 64 << 20) -> DataFrame:
    """A stream of path, position, line: the whole lines of a folder's files and of what is appended to them."""
    spark.dataSource.register(Tail)
    return spark.readStream.format("siftline_tail").option("suffix", suffix).option("splitBytes", str(split_bytes)).load(qualified(spark, folder))


def json_lines(spark: SparkSession, folder: str, schema: str, suffix: str = ".jsonl") -> DataFrame:
    """The lines as JSON rows; those that are no JSON are left out."""
    at = lines(spark, folder, suffix).filter(F.try_parse_json("line").isNotNull())
    return at.select(F.from_json("line", schema).alias("r")).select("r.*")
