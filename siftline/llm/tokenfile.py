"""Token files: frequency-ranked ids in byte-aligned variable-length code, control bytes apart.

A file is a row of blocks; a block holds some documents, in order. In each the
ids are replaced by their rank among the block's ids (most frequent first, ties
by id), and a rank takes one to four bytes. The lengths, two bits each, four to
a control byte, stand before the data, so that a control byte looks up the
places of four ranks at once and a block is decoded without a loop over ids.

Block, little-endian: magic, then u32 documents, u64 ids, u32 distinct ids, u64
data bytes; the distinct ids by rank (u32); document ids (i64) and flags (u8,
1: null); lengths (u64); control bytes; data bytes; CRC-32 of all before it.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import one_each
from .pieces import Pieces, chunks

MAGIC = b"SLTB"
_HEAD = struct.Struct("<4sIQIQ")
BLOCK_TOKENS, FILE_BLOCKS = 2_000_000, 64
END_ID = 0
CACHE_PIECES = 600_000
CHUNK_BYTES = 16_000_000
#: Ids below this are counted in a table.
TABLE_IDS = 1 << 24

_CODES = np.arange(256, dtype=np.uint8)[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3
#: By control byte: length of each of its four ranks, their places, and the length of all.
LENGTHS = (_CODES + 1).astype(np.int64)
PLACES = np.cumsum(LENGTHS, axis=1) - LENGTHS
TOTALS = LENGTHS.sum(axis=1)


def encode_block(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    ids = np.ascontiguousarray(ids, np.uint32)
    # Ids are a vocabulary's: counted in a table. Far larger ones are first numbered in their order.
    near = not len(ids) or int(ids.max()) < TABLE_IDS
    names, places = (None, ids) if near else np.unique(ids, return_inverse=True)
    counts = np.bincount(places)
    found = np.flatnonzero(counts)
    order = found[np.lexsort((found, -counts[found]))]
    rank_of = np.zeros(len(counts), np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    ranked = order.astype("<u4") if near else names[order].astype("<u4")
    ranks = rank_of[places]
    size = np.ones(len(ids), np.int64)
    for most in (0xFF, 0xFFFF, 0xFFFFFF):
        if len(order) > most + 1:
            size += ranks > most
    at = np.cumsum(size) - size
    data = np.empty(int(size.sum()), np.uint8)
    data[at] = ranks & 0xFF
    for k in range(1, 4):
        if len(order) > 1 << (8 * k):
            have = np.flatnonzero(size > k)
            data[at[have] + k] = (ranks[have] >> (8 * k)) & 0xFF
    codes = np.zeros(-(-len(ids) // 4) * 4, np.uint8)
    codes[: len(ids)] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    out = b"".join((
        _HEAD.pack(MAGIC, len(doc_ids), len(ids), len(ranked), len(data)), ranked.tobytes(),
        np.array([i or 0 for i in doc_ids], "<i8").tobytes(), bytes(int(i is None) for i in doc_ids),
        np.array(lengths, "<u8").tobytes(), control.tobytes(), data.tobytes(),
    ))
    return out + struct.pack("<I", zlib.crc32(out))


def decode_block(head: tuple, body: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, lengths, ids."""
    _, docs, n, distinct, n_data = head
    at = 0

    def part(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(body, kind, count, at)
        at += out.nbytes
        return out

    ranked, doc_ids, nulls, lengths, control = part("<u4", distinct), part("<i8", docs), part("u1", docs), part("<u8", docs), part("u1", -(-n // 4))
    data = np.concatenate([part("u1", n_data), np.zeros(16, np.uint8)])
    totals = TOTALS[control]
    places = ((np.cumsum(totals) - totals)[:, None] + PLACES[control]).ravel()[:n]
    size = LENGTHS[control].ravel()[:n]
    ranks = data[places].astype(np.uint32)
    for k in range(1, 4):
        have = size > k
        if have.any():
            ranks[have] |= data[places[have] + k].astype(np.uint32) << np.uint32(8 * k)
    return [None if z else i for i, z in zip(doc_ids.tolist(), nulls.tolist(), strict=True)], lengths.astype(np.int64), ranked[ranks]


def blocks(stream) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    while head := stream.read(_HEAD.size):
        magic, docs, n, distinct, n_data = got = _HEAD.unpack(head)
        size = 4 * distinct + 17 * docs + -(-n // 4) + n_data
        body = stream.read(size + 4)
        if magic != MAGIC or len(body) != size + 4 or zlib.crc32(body[:-4], zlib.crc32(head)) != struct.unpack("<I", body[-4:])[0]:
            raise ValueError("damaged block")
        yield decode_block(got, body[:-4])


class PieceEncoder(Pieces):
    """The tokenizer's ids: none are added, and the strings of its own special tokens in texts are these tokens, as the library has it."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        super().__init__(public_tokenizers.PATTERN, CACHE_PIECES, special)

    def words(self, words: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(words), 20_000):
            found = self.tokenizer.encode_batch_fast(words[at : at + 20_000], add_special_tokens=False)
            out += [array("I", e.ids).tobytes() for e in found]
        return out


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


_MANIFEST = "file string, part long, roll long, n_docs long, n_tokens long, bytes long"


class _File:
    """Under a temporary name until it is whole."""

    def __init__(self, fs, folder: str, part: int, roll: int, attempt: int) -> None:
        self.fs, self.name = fs, f"part-{part:05d}-{roll:05d}.tok"
        self.folder, self.temp = folder, f"{folder}/.tmp-{part:05d}-{roll:05d}-{attempt}"
        self.part, self.roll, self.out = part, roll, fs.open_output_stream(self.temp, compression=None)
        self.docs = self.tokens = self.bytes = self.blocks = 0

    def put(self, doc_ids: list, lengths: list[int], ids: np.ndarray) -> None:
        data = encode_block(doc_ids, lengths, ids)
        self.out.write(data)
        self.docs, self.tokens, self.bytes, self.blocks = self.docs + len(doc_ids), self.tokens + len(ids), self.bytes + len(data), self.blocks + 1

    def close(self) -> dict:
        self.out.close()
        self.fs.move(self.temp, f"{self.folder}/{self.name}")
        return {"file": self.name, "part": self.part, "roll": self.roll, "n_docs": self.docs, "n_tokens": self.tokens, "bytes": self.bytes}


def _writer(folder: str, tokenizer: str, block_tokens: int, file_blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        fs, path = FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        task, encode = TaskContext.get(), encoder(tokenizer)
        done, file, doc_ids, lengths, parts, held = [], None, [], [], [], 0

        def flush() -> None:
            nonlocal file, doc_ids, lengths, parts, held
            if not doc_ids:
                return
            if file is None:
                file = _File(fs, path, task.partitionId(), len(done), task.taskAttemptId())
            file.put(doc_ids, lengths, np.concatenate(parts))
            doc_ids, lengths, parts, held = [], [], [], 0
            if file.blocks >= file_blocks:
                done.append(file.close())
                file = None

        for b in batches:
            for a, z in chunks(b.column(1), CHUNK_BYTES):
                ids, n = encode.encode(b.column(1)[a:z])
                doc_ids += b.column(0)[a:z].to_pylist()
                lengths += (n + 1).tolist()
                parts.append(np.insert(ids, np.cumsum(n), END_ID))
                held += len(parts[-1])
                if held >= block_tokens:
                    flush()
        flush()
        if file is not None:
            done.append(file.close())
        if done:
            yield pa.RecordBatch.from_pylist(done, pa.schema([("file", pa.string()), *((c, pa.int64()) for c in ("part", "roll", "n_docs", "n_tokens", "bytes"))]))

    return run


def write(docs: DataFrame, folder: str, tokenizer: str, block_tokens: int = BLOCK_TOKENS, file_blocks: int = FILE_BLOCKS) -> DataFrame:
    """Encode every text (null: empty), END_ID after each, into files below ``folder`` in ascending order of doc_id (nulls first; ties by text); returns the manifest."""
    dealt = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(_writer(folder + "/data", tokenizer, block_tokens, file_blocks), _MANIFEST).write.parquet(folder + "/manifest")
    return docs.sparkSession.read.schema(_MANIFEST).parquet(folder + "/manifest")


_DOCS = "doc_id long, start long, n_tokens long, ids binary"


def _reader(folder: str, fold):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, path = FileSystem.from_uri(folder)
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for doc_ids, lengths, ids in blocks(stream):
                        ends = np.cumsum(lengths)
                        starts = ends - lengths
                        yield fold(doc_ids, start + starts, lengths, [ids[a:z] for a, z in zip(starts.tolist(), ends.tolist(), strict=True)])
                        start += int(lengths.sum())

    return run


def _starts(spark: SparkSession, folder: str) -> DataFrame:
    """file, start: the ids before each file, a task for each. The window sees one row per file."""
    m = spark.read.schema(_MANIFEST).parquet(folder + "/manifest")
    at = m.selectExpr("file", "coalesce(sum(n_tokens) over (order by part, roll rows between unbounded preceding and 1 preceding), 0) as start")
    return one_each(at)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian u32) from the files that the manifest names."""
    fold = lambda d, s, n, parts: pa.record_batch({"doc_id": pa.array(d, pa.int64()), "start": pa.array(s, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids": pa.array([p.astype("<u4").tobytes() for p in parts], pa.binary())})
    return _starts(spark, folder).mapInArrow(_reader(folder + "/data", fold), _DOCS)


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """As read, with the CRC-32 of the ids instead of the ids."""
    fold = lambda d, s, n, parts: pa.record_batch({"doc_id": pa.array(d, pa.int64()), "start": pa.array(s, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_crc32": pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64())})
    return _starts(spark, folder).mapInArrow(_reader(folder + "/data", fold), _DOCS.replace("ids binary", "ids_crc32 long"))
