"""An index of fingerprints that a stream queries and then grows: near duplicates as they come.

Rows of a micro-batch are first collapsed where they are read, to one row for
each class of equal hash and place, so copies, however many, cost a row a task.
Classes go to radius + 1 bands, whose groups (band, value) hold the classes seen;
two within the radius share a whole band, and the first band they share links
them. State is one entry for each class, dropped when it has not been seen for a
given time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.identity import band_value, bands

#: The state store that keyed state with a time limit needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LINKS = "kind string, a long, b long, distance int, n long"
_CLASS = "id long, hash long, place string, n long"


def _collapse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.groupby(["hash", "place"], sort=False, as_index=False, dropna=False).agg(id=("id", "min"), n=("id", "size"))[["id", "hash", "place", "n"]]


class _Index(StatefulProcessor):
    def __init__(self, radius: int, apart: bool, keep_ms: int | None) -> None:
        self.radius, self.apart, self.keep_ms = radius, apart, keep_ms
        self.cuts = bands(radius)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "hash long, place string", "first long, n long", ttlDurationMs=self.keep_ms)

    def _first_band(self, x: int, y: int) -> int:
        same = ~(x ^ y) & (2**64 - 1)
        return next(k for k, (shift, width) in enumerate(self.cuts) if (same >> shift) & ((1 << width) - 1) == (1 << width) - 1)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).groupby(["hash", "place"], as_index=False, dropna=False).agg(id=("id", "min"), n=("n", "sum")).sort_values("id")
        held = {(h, p): (first, n) for (h, p), (first, n) in self.seen.iterator()}
        keys, out = list(held), []
        hashes = np.array([h for h, _ in keys], np.int64).view(np.uint64)
        for place, id_, hash_, n in zip(new["place"], new["id"], new["hash"], new["n"], strict=True):
            place, id_, hash_, n = str(place), int(id_), int(hash_), int(n)
            if (hash_, place) in held:
                first, before = held[hash_, place]
                held[hash_, place] = (first, before + n)
                more = n
            else:
                far = np.bitwise_count(hashes ^ np.array([hash_], np.int64).view(np.uint64))
                for k in np.flatnonzero(far <= self.radius):
                    other, where = keys[k]
                    if (not self.apart or where != place) and self._first_band(hash_, other) == key[0]:
                        out.append(("link", held[keys[k]][0], id_, int(far[k]), 1))
                held[hash_, place] = (id_, n)
                keys.append((hash_, place))
                hashes = np.append(hashes, np.array([hash_], np.int64).view(np.uint64))
                more = n - 1
            if more and key[0] == 0:  # every class has a band 0
                out.append(("copies", held[hash_, place][0], id_, 0, more))
            self.seen.updateValue((hash_, place), held[hash_, place])
        if out:
            yield pd.DataFrame(out, columns=["kind", "a", "b", "distance", "n"])

    def close(self) -> None:
        pass


def near_links(rows: DataFrame, radius: int, place: str | None = None, keep: float | None = None) -> DataFrame:
    """kind, a, b, distance, n of a stream of (id, hash and, if named, a place).

    A class is what shares hash and place, named by the id it came with first
    (the smallest of its batch). ``link``: class b is new and class a, seen
    before or with a smaller id in the same batch, is within the radius; with
    places, only classes of different places are linked. ``copies``: n more rows
    of class a came, b the smallest id of them, itself a where the class is new.
    Rows with a null hash are left out. ``keep`` seconds without a row end a
    class. Sessions need the state store that ``with_state`` sets.
    """
    at = F.coalesce(F.col(place).cast("string"), F.lit("")) if place else F.lit("")
    one = rows.filter("hash is not null").select("id", "hash", at.alias("place")).mapInPandas(_collapse, _CLASS)
    cuts = [F.struct(F.lit(k).alias("k"), band_value(F.col("hash"), s, w).alias("v")) for k, (s, w) in enumerate(bands(radius))]
    keyed = one.select("*", F.explode(F.array(*cuts)).alias("band")).select(F.col("band.k").alias("k"), F.col("band.v").alias("v"), "id", "hash", "place", "n")
    index = _Index(radius, place is not None, None if keep is None else int(1000 * keep))
    return keyed.groupBy("k", "v").transformWithStateInPandas(index, outputStructType=LINKS, outputMode="Append", timeMode="None" if keep is None else "ProcessingTime")


def with_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
