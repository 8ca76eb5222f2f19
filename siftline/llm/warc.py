"""WARC: deterministic sharded writer and reader.

Records are range-sorted by page_id and every task writes its range to files
that roll by compressed size. Each record is a gzip member of its own, with
headers, digests and record ids made from the data alone, so a task that runs
again writes the same bytes. A file is written under a temporary name and
renamed when it is whole; the manifest, a table with a row per file, is
written last, and readers read what it names.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import one_each

ROLL_BYTES = 64 << 20
MIN_REVISIT_BYTES = 1000
#: Fixed, so that archives don't depend on the time of writing.
DATE = "2000-01-01T00:00:00Z"
_MANIFEST = "file string, part long, roll long, n_records long, bytes long, sha1 string"
_RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, file string"


def plan(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest (SHA-1 in hex), sha256, refers_to, mark: a row per page (mark 1), and one before each that revisits (mark 0: id, digests and refers_to only).

    A null html is an empty payload. Payloads are equal if both digests are: the
    archive's own, SHA-1, has known collisions, which lose nothing here. Of payloads that are equal and long enough the one with the largest page_id
    is the response. Rows that repeat it, page_id and all, are responses too. A
    null page_id is never the largest unless a group has no other. Marks meet
    their pages in the range sort, so payloads are dealt out once.
    """
    at = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumns({"digest": F.sha1("payload"), "sha256": F.sha2("payload", 256)})
    same = ["digest", "sha256"]
    long_ = at.filter(F.octet_length("payload") >= MIN_REVISIT_BYTES).select("page_id", *same)
    last = long_.groupBy(*same).agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1")
    again = long_.join(last, same).filter(~F.col("page_id").eqNullSafe(F.col("last"))).select("page_id", *same, F.col("last").alias("refers_to")).distinct()
    marks = again.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), *same, "refers_to", F.lit(0).alias("mark"))
    return at.select("page_id", "url", "payload", *same, F.lit(None).cast("long").alias("refers_to"), F.lit(1).alias("mark")).unionByName(marks)


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    tail = urn.strip("<>").rpartition(":")[2]
    return None if tail == "none" else int(tail)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, not compressed. A revisit's block is empty; its headers tell digest and size of the payload."""
    revisit = refers_to is not None
    block = b"" if revisit else payload
    sha1 = lambda x: "sha1:" + base64.b32encode(x).decode()
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}",
        *([] if url is None else [f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~\'')}", f"X-Target-URI-Text: {base64.b64encode(url.encode()).decode()}"]),
        f"WARC-Block-Digest: {sha1(hashlib.sha1(block).digest())}", f"WARC-Payload-Digest: {sha1(bytes.fromhex(digest))}", f"X-Payload-Length: {len(payload)}",
        *([f"WARC-Refers-To: {_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip header without time or name
    return z.compress(data) + z.flush()


class _Roll:
    """One file under a temporary name, renamed when it is closed."""

    def __init__(self, fs, folder: str, part: int, roll: int, attempt: int) -> None:
        self.fs, self.part, self.roll = fs, part, roll
        self.path = f"{folder}/part-{part:05d}-{roll:05d}.warc.gz"
        self.temp = f"{folder}/.tmp-{part:05d}-{roll:05d}-{attempt}"
        self.out, self.sha, self.n, self.bytes = fs.open_output_stream(self.temp, compression=None), hashlib.sha1(), 0, 0

    def put(self, data: bytes) -> None:
        z = _gzip(data)
        self.out.write(z)
        self.sha.update(z)
        self.n, self.bytes = self.n + 1, self.bytes + len(z)

    def close(self) -> dict:
        self.out.close()
        self.fs.move(self.temp, self.path)  # same name, same bytes: a second attempt replaces them
        return {"file": self.path.rpartition("/")[2], "part": self.part, "roll": self.roll, "n_records": self.n, "bytes": self.bytes, "sha1": self.sha.hexdigest()}


def _writer(folder: str, roll_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        fs, path = FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        task, at, done, seen = TaskContext.get(), None, [], (None,) * 4
        for b in batches:
            for k in range(b.num_rows):
                *row, mark = (c[k].as_py() for c in b.columns)
                page_id, _, _, digest, sha256, refers_to = row
                if not mark:
                    seen = (page_id, digest, sha256, refers_to)
                    continue
                if seen[:3] == (page_id, digest, sha256):
                    refers_to = seen[3]
                if at is None:
                    at = _Roll(fs, path, task.partitionId(), len(done), task.taskAttemptId())
                at.put(record(*row[:4], refers_to))
                if at.bytes >= roll_bytes:
                    done.append(at.close())
                    at = None
        if at is not None:
            done.append(at.close())
        if done:
            yield pa.RecordBatch.from_pylist(done, pa.schema([("file", pa.string()), *((c, pa.int64()) for c in ("part", "roll", "n_records", "bytes")), ("sha1", pa.string())]))

    return run


def write(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write the archive below ``folder`` (a URI that all executors reach); the manifest, sorted by file, lies in folder/manifest.

    An empty table gives a manifest without rows.
    """
    rows = plan(pages)
    dealt = rows.repartitionByRange("page_id", "digest").sortWithinPartitions("page_id", "digest", "sha256", "mark", "url")
    made = dealt.select("page_id", "url", "payload", "digest", "sha256", "refers_to", "mark").mapInArrow(_writer(folder + "/data", roll_bytes), _MANIFEST)
    made.write.parquet(folder + "/manifest")
    return pages.sparkSession.read.schema(_MANIFEST).parquet(folder + "/manifest")


def _head(data: bytes) -> tuple[dict[str, str], int]:
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return dict(x.split(": ", 1) for x in lines[1:]), end + 4


def records(stream, n: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of a file of gzip members, one at a time."""
    left = b""
    while left or (left := stream.read(n)):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if not left and not (left := stream.read(n)):
                raise EOFError("the last record is cut off")
            parts.append(z.decompress(left))
            left = z.unused_data
        data = b"".join(parts)
        head, at = _head(data)
        size = int(head["Content-Length"])
        if len(data) != at + size + 4:
            raise ValueError("Content-Length doesn't fit the record")
        yield head, data[at : at + size]


def _reader(folder: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, path = FileSystem.from_uri(folder)
        names = [f.split()[0] for f in _RECORDS.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
        schema = pa.schema(list(zip(names, kinds, strict=True)))
        for b in batches:
            for name in b.column(0).to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for head, block in records(stream):
                        revisit = head["WARC-Type"] == "revisit"
                        hex_ = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        if base64.b32decode(head["WARC-Block-Digest"].removeprefix("sha1:")) != hashlib.sha1(block).digest() or not revisit and hashlib.sha1(block).hexdigest() != hex_:
                            raise ValueError(f"digest mismatch in {name}")
                        url = base64.b64decode(head["X-Target-URI-Text"]).decode() if "X-Target-URI-Text" in head else None
                        rows.append((_page(head["WARC-Record-ID"]), url, head["WARC-Type"], _page(head["WARC-Refers-To"]) if revisit else None, int(head["X-Payload-Length"]), hex_, None if revisit or not with_payload else block, name))
                        size += len(block) + 200
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)

    return run


def read(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of the files that the manifest names, digests checked. Payloads of revisits are null."""
    names = spark.read.schema(_MANIFEST).parquet(folder + "/manifest").select("file")
    return one_each(names).mapInArrow(_reader(folder + "/data", with_payload), _RECORDS)
