"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

A document's set (2-word shingles by default) is sketched in T coordinates:
in round i every element is put into one hashed bin with value i + fraction,
and a bin keeps its smallest value; after HASHED rounds a last one puts every
element into every bin that is still empty, so each coordinate fills. A sketch
takes about T ln T / n rounds for n elements, and coordinates agree with
probability equal to the Jaccard similarity. Bands of ROWS coordinates make the
candidates; at similarity 0.8 a pair is missed with probability
(1 - 0.8^5)^40, about 1e-7.

Documents with equal sets are one node, so copies never meet in a bucket. A
bucket's nodes are first checked against its smallest one (a star, not all
pairs), which links nearly all there is to link. Then nodes of a bucket that
are still in different components are compared by one bit of each coordinate:
at 0.8 a tenth of the T bits differ, with a deviation of 0.66 %, and pairs that
differ in more than 13 % (4.5 deviations, three pairs in a million at 0.8) are
let go inside the join, which also gives each pair in the first band it shares
only. Links are confirmed on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from .common import cut

T, ROWS, BANDS, HASHED = 2048, 5, 40, 512
MAX_DIFFERENT = 266
PERCENT = 80
CHUNK_CHARS = 1_000_000
#: What a document counts at least, as its sketch takes 8 T bytes and several times that while bits are made, however short it is.
CHUNK_LEAST = 4_000
_FREE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles; of the whole sequence if it is shorter; none without words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and the six white space characters
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(len(h), width), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(len(h), width)):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


def sketch(sets: list[np.ndarray], t: int = T) -> np.ndarray:
    """A row of t values for each set; no set is empty."""
    n = len(sets)
    out = np.full(n * t, _FREE, np.uint64)
    all_, of = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    for i in range(HASHED):
        x = _mix(all_ ^ _mix(np.array([i + 1], np.uint64)))
        place = ((x & np.uint64(0xFFFFFFFF)) * np.uint64(t) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(out, of * t + place, (np.uint64(i) << np.uint64(32)) | (x >> np.uint64(32)))
        if i >= 3 and i % 4 == 3:
            more = (out.reshape(n, t) == _FREE).any(axis=1)[of]
            if not more.any():
                break
            if not more.all():
                all_, of = all_[more], of[more]
    rows = out.reshape(n, t)
    for k in np.flatnonzero((rows == _FREE).any(axis=1)):  # small sets only
        free = np.flatnonzero(rows[k] == _FREE)
        x = _mix(sets[k][:, None] ^ _mix(np.uint64(HASHED + 1) + free.astype(np.uint64))[None, :])
        rows[k, free] = (np.uint64(HASHED) << np.uint64(32)) | (x >> np.uint64(32)).min(axis=0)
    return out.reshape(n, t)


def _bands(s: np.ndarray) -> np.ndarray:
    rows = s[:, : BANDS * ROWS].reshape(len(s), BANDS, ROWS)
    out = np.broadcast_to(_mix(np.arange(1, BANDS + 1, dtype=np.uint64)), rows.shape[:2]).copy()
    for k in range(ROWS):
        out = _mix(out ^ rows[:, :, k]) + np.uint64(k)
    return out.view(np.int64)


def _bits(s: np.ndarray) -> np.ndarray:
    """A bit of each coordinate, in T / 64 longs."""
    bit = (_mix(s) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bit, axis=1).view("<i8").reshape(len(s), T // 64)


def _chunks(b: pa.RecordBatch) -> Iterator[tuple[list, list]]:
    """Ids and texts, about CHUNK_CHARS at a time, and at most CHUNK_CHARS / CHUNK_LEAST texts."""
    ids, texts, n = [], [], 0
    for i, t in zip(b.column(0), b.column(1), strict=True):
        ids.append(i.as_py())
        texts.append(t.as_py())
        n += len(texts[-1] or "") + CHUNK_LEAST
        if n >= CHUNK_CHARS:
            yield ids, texts
            ids, texts, n = [], [], 0
    if ids:
        yield ids, texts


def _longs(rows: np.ndarray, have: list[int], n: int) -> pa.Array:
    """A list column with the rows at the places ``have``, else null."""
    size = np.zeros(n, np.int32)
    size[have] = rows.shape[1] if len(rows) else 0
    at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    mask = np.ones(n, bool)
    mask[have] = False
    return pa.ListArray.from_arrays(pa.array(at), pa.array(rows.ravel(), pa.int64()), mask=pa.array(mask))


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, texts in _chunks(b):
                sets = [shingle_set(t, width) for t in texts]
                have = [k for k, s in enumerate(sets) if len(s)]
                s = sketch([sets[k] for k in have]) if have else np.empty((0, T), np.uint64)
                bits = _bits(s)
                yield pa.record_batch({
                    "doc_id": pa.array(ids, pa.int64()), "n_shingles": pa.array([len(x) for x in sets], pa.int64()),
                    "key": pa.array([xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets], pa.binary()),
                    "bands": _longs(_bands(s), have, len(ids)), "bits": _longs(bits, have, len(ids)),
                })

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, texts in _chunks(b):
                sets = [shingle_set(t, width).view(np.int64) for t in texts]
                at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "items": pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets), pa.int64()))})

    return run


def components(edges: DataFrame) -> DataFrame:
    """node, label (smallest node reachable) from edges a, b; nodes without edges are absent.

    Each round takes the smallest label around and then the label's own label,
    so paths shorten by more than half a round; every round ends in a checkpoint.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        around = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m"))
        near = labels.join(around, labels["node"] == around["a"]).select("node", "label", F.least("label", "m").alias("to"))
        up = labels.select(F.col("node").alias("to"), F.col("label").alias("top"))
        new = cut(near.join(up, "to").select("node", F.col("top").alias("label"), (F.col("top") != F.col("label")).alias("moved")))
        labels = new.select("node", "label")
        if new.filter("moved").isEmpty():
            return labels


def _close(a: str, b: str):
    """Sizes and bits of two nodes allow a link."""
    far = sum(F.bit_count(F.col(f"{a}.bits")[k].bitwiseXOR(F.col(f"{b}.bits")[k])) for k in range(T // 64))
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (100 * F.least(na, nb) >= PERCENT * F.greatest(na, nb)) & (far <= MAX_DIFFERENT)


def _verified(pairs: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """Those of the pairs a, b whose whole sets are similar enough."""
    pairs = cut(pairs)
    ids = pairs.select(F.col("a").alias("doc_id")).distinct().unionByName(pairs.select(F.col("b").alias("doc_id")).distinct())
    sets = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").mapInArrow(_sets(width), "doc_id long, items array<long>")
    sets = cut(sets)
    one = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y")), "b")
    two = one.join(sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x")), "a")
    both = F.size(F.array_intersect("x", "y"))
    return two.filter(100 * both >= PERCENT * (F.size("x") + F.size("y") - both)).select("a", "b").distinct()


def near_dedup(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Null, empty and blank texts have no shingles and are linked with nothing,
    not even each other: their component is their own id. Rows that share a
    doc_id are one document of that id. A null doc_id is linked with nothing:
    its component_id is null and it is kept.
    """
    docs = docs.select("doc_id", "text")
    rows = cut(docs.mapInArrow(_sketches(width), "doc_id long, n_shingles long, key binary, bands array<long>, bits array<long>"))
    live = rows.filter("doc_id is not null and key is not null")
    nodes = live.groupBy("key").agg(F.min("doc_id").alias("node"))
    heads = live.join(nodes, (live["key"] == nodes["key"]) & (live["doc_id"] == nodes["node"])).select("node", F.col("n_shingles").alias("n"), "bits", "bands")
    heads = cut(heads)
    info = heads.select("node", "n", "bits")
    # Dealt by the joins' own exchanges, whose large partitions Spark splits.
    dealt = heads.select("node", F.explode("bands").alias("band"))
    buckets = dealt.groupBy("band").agg(F.min("node").alias("lead"), F.count("*").alias("size")).filter("size > 1")
    met = cut(dealt.join(buckets, "band").filter("node != lead").select("band", "lead", "node", "size"))
    star = met.select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    star = star.join(info.alias("s"), F.col("a") == F.col("s.node")).join(info.alias("t"), F.col("b") == F.col("t.node")).filter(_close("s", "t")).select("a", "b")
    links = cut(_verified(star, docs, width))
    labels = components(links)
    # What a bucket still holds apart, its lead aside, which has met all.
    apart = met.filter("size > 2").join(labels, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label"))
    torn = apart.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("band")
    side = cut(apart.join(torn, "band").join(heads.select("node", "n", "bits", "bands"), "node"))
    shared = F.zip_with("s.bands", "t.bands", lambda x, y: x == y)
    first = F.element_at("s.bands", F.array_position(shared, True).cast("int")) == F.col("s.band")
    cross = side.alias("s").join(side.alias("t"), (F.col("s.band") == F.col("t.band")) & (F.col("s.label") < F.col("t.label")) & _close("s", "t") & first)
    more = _verified(cross.select(F.col("s.node").alias("a"), F.col("t.node").alias("b")).distinct(), docs, width)
    more = cut(more)
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    named = nodes.join(labels, "node", "left").select("key", F.coalesce("label", "node").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key")).join(named, "key", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
