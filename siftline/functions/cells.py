"""Hashes close in one of a few wide bands: each value of a band is a cell.

A hash goes to its own cell of every band and to those within the band's reach.
Where cells are few (large radii) each is a group of a shuffle, in which numpy
compares its own hashes with all that came: a row of distances at a time, so a
task holds one cell's hashes and nothing of their square. Where cells are many
and hold a few hashes each, they are the keys of a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .identity import band_value, hamming


def _around(width: int, reach: int) -> list[int]:
    """The differences of band values by at most ``reach`` bits."""
    return [sum(1 << b for b in some) for n in range(min(reach, width) + 1) for some in combinations(range(width), n)]


def _in(h: np.ndarray, shift: int, width: int) -> np.ndarray:
    return (h >> np.uint64(shift)) & np.uint64((1 << width) - 1)


def _compare(radius: int, cuts: list[tuple[int, int, int]]):
    def run(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, cell = key[0].as_py(), key[1].as_py()
        shift, width, _ = cuts[k]
        come = [b.column("h").to_numpy(zero_copy_only=False) for b in rows]
        there = np.sort(np.concatenate(come)).view(np.uint64)  # ascending as signed numbers, so q > p lie after p
        p, q = [], []
        n = 0
        for i in np.flatnonzero(_in(there, shift, width) == np.uint64(cell)):
            near = np.flatnonzero(np.bitwise_count(there[i + 1 :] ^ there[i]) <= radius)
            if len(near):
                p.append(np.full(len(near), there[i]))
                q.append(there[i + 1 :][near])
                n += len(near)
            if n >= 100_000:
                yield _first(p, q, k, cuts)
                p, q, n = [], [], 0
        if n:
            yield _first(p, q, k, cuts)

    return run


def _first(p: list[np.ndarray], q: list[np.ndarray], k: int, cuts: list[tuple[int, int, int]]) -> pa.RecordBatch:
    """Pairs with their distances, without those that an earlier band has in its reach: a pair is given in one cell of one band."""
    a, b = np.concatenate(p), np.concatenate(q)
    x = a ^ b
    new = np.ones(len(x), bool)
    for shift, width, reach in cuts[:k]:
        new &= np.bitwise_count(_in(x, shift, width)) > reach
    return pa.record_batch({"p": pa.array(a[new].view(np.int64)), "q": pa.array(b[new].view(np.int64)), "distance": pa.array(np.bitwise_count(x[new]).astype(np.int32))})


def _dealt(one: DataFrame, cuts: list[tuple[int, int, int]]) -> DataFrame:
    """h, k, cell: each hash once in its own cell of every band and in those within the band's reach."""
    at = [F.struct(F.lit(k).alias("k"), band_value(F.col("h"), s, w).bitwiseXOR(F.lit(m).cast("long")).alias("cell")) for k, (s, w, reach) in enumerate(cuts) for m in _around(w, reach)]
    return one.select("h", F.explode(F.array(*at)).alias("c")).select("h", "c.k", "c.cell")


def close(one: DataFrame, radius: int, cuts: list[tuple[int, int, int]]) -> DataFrame:
    """p, q, distance of all pairs p < q of the distinct hashes (h) within the radius, each once; cuts as identity.reaches has them."""
    return _dealt(one, cuts).groupBy("k", "cell").applyInArrow(_compare(radius, cuts), "p long, q long, distance int")


def joined(one: DataFrame, radius: int, cuts: list[tuple[int, int, int]]) -> DataFrame:
    """The same by a join: what comes to a cell meets the cell's own. A pair is in one cell of a band at most, and the first band that has it in its reach gives it."""
    x, y = _dealt(one, cuts).alias("x"), _dealt(one, [(s, w, 0) for s, w, _ in cuts]).alias("y")
    p, q = F.col("x.h"), F.col("y.h")
    far = [F.bit_count(band_value(p.bitwiseXOR(q), s, w)) > reach for s, w, reach in cuts]
    first = F.lit(True)
    for k, apart in enumerate(far[:-1]):
        first &= (F.col("x.k") <= k) | apart
    d = hamming(p, q)
    return x.join(y, (F.col("x.k") == F.col("y.k")) & (F.col("x.cell") == F.col("y.cell")) & (p < q) & (d <= radius) & first).select(p.alias("p"), q.alias("q"), d.cast("int").alias("distance"))
