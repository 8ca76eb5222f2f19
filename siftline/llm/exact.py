"""Exact dedup by a cuckoo-filter index of live digests.

The key of a text is the SHA-256 of its normal form. Keys live in an index: a
cuckoo filter (short fingerprints, two places each, insertion and deletion) in
front of buckets by key that hold the normal form itself. A filter miss proves
a key new without touching the buckets; a hit is verified against the bucket's
content, so a false positive costs a look but never a document, and two texts
of one digest would be an error and not a lost document. An insertion that
finds no place doubles the filter, which is rebuilt from the stored keys.

Over a table the index works twice: each input task folds its rows into an
index of its own and hands on one row per key and task (so a key with a third
of all rows reaches no task more than once per input task), then the keys are
dealt by hash and each task folds what it got. What a task holds is bounded by
``max_keys`` and ``max_bytes`` of content: beyond that it hands on what it has
and starts anew, before the deal; after the deal equal keys stand next to each
other, so the index is emptied between keys without losing a match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS_CLASS

#: Keys, and bytes of their contents, that one index holds before it is handed on.
MAX_KEYS, MAX_BYTES = 500_000, 64_000_000
SLOTS, KICKS = 4, 200
_KEYS = "key binary, keep_id long, group_size long"
_CONTENTS = _KEYS.replace(",", ", content binary,", 1)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return x ^ (x >> np.uint64(29))


class CuckooFilter:
    """16-bit fingerprints of 64-bit hashes in buckets of 4; a multiset, so a key may be put in more than once."""

    def __init__(self, capacity: int = 1024) -> None:
        self.n = 1 << max(2, int(np.ceil(np.log2(max(capacity, 1) / SLOTS / 0.8 + 1))))
        self.slots = np.zeros((self.n, SLOTS), np.uint16)
        self.size, self._turn = 0, 0

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        prints = ((hashes >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)
        one = (hashes & np.uint64(self.n - 1)).astype(np.int64)
        return prints, one, self.other(one, prints)

    def other(self, place: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return place ^ (_mix(prints.astype(np.uint64)) & np.uint64(self.n - 1)).astype(np.int64)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        prints, one, two = self.places(hashes)
        return ((self.slots[one] == prints[:, None]) | (self.slots[two] == prints[:, None])).any(axis=1)

    def _put(self, place: int, mark: int) -> bool:
        row = self.slots[place]
        for k in range(SLOTS):
            if row[k] == 0:
                row[k] = mark
                return True
        return False

    def insert(self, h: int) -> bool:
        """False if no place was found: then one fingerprint has lost its place, and the owner must rebuild."""
        prints, one, two = self.places(np.array([h], np.uint64))
        mark, place = int(prints[0]), int(one[0])
        if self._put(place, mark) or self._put(int(two[0]), mark):
            self.size += 1
            return True
        for _ in range(KICKS):
            self._turn = (self._turn * 5 + 1) % (SLOTS * 64)
            k = self._turn % SLOTS
            mark, self.slots[place, k] = int(self.slots[place, k]), mark
            place = int(self.other(np.array([place]), np.array([mark], np.uint16))[0])
            if self._put(place, mark):
                self.size += 1
                return True
        return False

    def insert_many(self, hashes: np.ndarray) -> bool:
        """As insert, for many: those that find a free slot at once go in together, one to a place and round."""
        prints, one, two = self.places(hashes)
        left = np.arange(len(hashes))
        for place in (one, two):
            for _ in range(SLOTS):
                if not len(left):
                    break
                first = np.unique(place[left], return_index=True)[1]
                at = place[left[first]]
                free = self.slots[at] == 0
                has = free.any(axis=1)
                self.slots[at[has], free[has].argmax(axis=1)] = prints[left[first[has]]]
                left = np.delete(left, first[has])
        self.size += len(hashes) - len(left)
        return all(self.insert(h) for h in hashes[left].tolist())

    def delete(self, h: int) -> bool:
        prints, one, two = self.places(np.array([h], np.uint64))
        for place in (int(one[0]), int(two[0])):
            at = np.flatnonzero(self.slots[place] == prints[0])
            if len(at):
                self.slots[place, at[0]] = 0
                self.size -= 1
                return True
        return False


class DigestIndex:
    """Live keys with their content, the smallest document id and the number of documents of each."""

    def __init__(self, capacity: int = 4096) -> None:
        self.filter = CuckooFilter(capacity)
        self.buckets: dict[bytes, list] = {}
        self.resizes = self.bytes = 0

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(k[:8] for k in keys), "<u8")

    def resize(self) -> None:
        """A filter of twice the size, from the stored keys."""
        capacity, hashes = self.filter.n * SLOTS * 2, self.hashes(list(self.buckets))
        while True:
            self.filter, self.resizes = CuckooFilter(capacity), self.resizes + 1
            if self.filter.insert_many(hashes):
                return
            capacity *= 2

    @staticmethod
    def _same(held: list, content: bytes) -> list:
        if held[0] != content:
            raise ValueError("two texts of one digest")
        return held

    def add(self, keys: list[bytes], contents: list[bytes], ids: list, counts: list[int]) -> None:
        if not keys:
            return
        hashes, fresh = self.hashes(keys), {}
        hit = self.filter.contains(hashes)
        for k, (key, content, i, n, seen) in enumerate(zip(keys, contents, ids, counts, hit.tolist(), strict=True)):
            held = self.buckets.get(key) if seen or key in fresh else None
            if held is None:
                self.buckets[key] = [content, i, n]
                self.bytes += len(content)
                fresh[key] = k
            else:
                self._same(held, content)
                held[1] = i if held[1] is None or (i is not None and i < held[1]) else held[1]
                held[2] += n
        if not self.filter.insert_many(hashes[list(fresh.values())]):
            self.resize()

    def lookup(self, keys: list[bytes], contents: list[bytes]) -> list:
        """(smallest id, count) of each key that is live, else None."""
        if not keys:
            return []
        hit = self.filter.contains(self.hashes(keys)).tolist()
        held = [self.buckets.get(k) if seen else None for k, seen in zip(keys, hit, strict=True)]
        return [None if h is None else tuple(self._same(h, c)[1:]) for h, c in zip(held, contents, strict=True)]

    def remove(self, key: bytes, content: bytes, n: int = 1) -> bool:
        """Take n documents from a key; with its last one the key leaves filter and buckets. False if it isn't live."""
        h = self.hashes([key])
        if not self.filter.contains(h)[0] or key not in self.buckets:
            return False
        held = self._same(self.buckets[key], content)
        held[2] -= n
        if held[2] <= 0:
            del self.buckets[key]
            self.bytes -= len(content)
            self.filter.delete(int(h[0]))
        return True

    def full(self, max_keys: int, max_bytes: int) -> bool:
        return len(self.buckets) >= max_keys or self.bytes >= max_bytes

    def drain(self, with_content: bool = True) -> pa.RecordBatch:
        rows = list(zip(*self.buckets.values(), strict=True)) or [(), (), ()]
        out = pa.record_batch(
            {"key": pa.array(list(self.buckets), pa.binary())} | ({"content": pa.array(rows[0], pa.binary())} if with_content else {})
            | {"keep_id": pa.array(rows[1], pa.int64()), "group_size": pa.array(rows[2], pa.int64())}
        )
        self.buckets, self.filter, self.bytes = {}, CuckooFilter(4096), 0
        return out


#: Rows that an index takes at a time; between them it may be handed on.
ROWS = 1000


def _fold(batches: Iterator[pa.RecordBatch], max_keys: int = MAX_KEYS, max_bytes: int = MAX_BYTES, ordered: bool = False) -> Iterator[pa.RecordBatch]:
    index = DigestIndex(16_384)
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            b = whole.slice(at, ROWS)
            if index.full(max_keys, max_bytes):
                last = index.buckets.popitem() if ordered else None  # the last key may go on in this batch
                if index.buckets:
                    yield index.drain(not ordered)
                if last:
                    index.filter, index.bytes = CuckooFilter(4096), 0
                    index.add([last[0]], *([x] for x in last[1]))
            index.add(*(b.column(c).to_pylist() for c in ("key", "content", "keep_id", "group_size")))
    if index.buckets:
        yield index.drain(not ordered)


def normal_form(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), WS_CLASS + "+", " ")


def keyed(docs: DataFrame, *keep: str) -> DataFrame:
    return docs.select(*keep, F.unhex(F.sha2(normal_form(F.col("text")), 256)).alias("key"))


def groups(docs: DataFrame, max_keys: int = MAX_KEYS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """key, keep_id, group_size: one row per distinct key of (doc_id, text)."""
    one = docs.select(F.col("doc_id").alias("keep_id"), normal_form(F.col("text")).alias("t"))
    # Through a generator of one row, so that the normal form is made once and not for the digest and the content each.
    one = one.select(F.inline(F.array(F.struct(F.col("t").cast("binary").alias("content"), F.sha2("t", 256).alias("sha")))), "keep_id")
    one = one.select(F.unhex("sha").alias("key"), "content", "keep_id", F.lit(1).cast("long").alias("group_size"))
    near = one.mapInArrow(lambda it: _fold(it, max_keys, max_bytes), _CONTENTS)
    dealt = near.repartition(F.col("key")).sortWithinPartitions("key")
    return dealt.mapInArrow(lambda it: _fold(it, max_keys, max_bytes, ordered=True), _KEYS)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    Null texts count as empty, and empty texts are equal to each other. Of rows
    that share text and smallest doc_id (repeated rows) all have kept true. A
    null doc_id is never smallest unless a group has no other. An empty table
    gives an empty result; columns beyond doc_id and text play no part.
    """
    joined = keyed(docs, "doc_id").join(groups(docs), "key")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("key")).alias("text_sha256"))
