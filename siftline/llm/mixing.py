"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks.

Sources get blocks of ``block_words`` words by highest quotient of their
targets; within a source the blocks go to its shards (documents by hash) by
highest quotient of the shards' sizes, as integer quotas. In each shard the
documents stand in a seeded order and are cut into n blocks of equal size, to a
word, n being the shard's words over ``block_words``. A quota takes every block as often as it covers the shard, and the
rest of it is a seeded choice of blocks: block b is chosen if (b * step +
offset) mod n is under the rest, which picks just that many, as step and n have
no factor in common. A document takes its share of each of its blocks.

Sizes are counted in one pass into a small table; only (id, hash, size) rows
are dealt out, by source and shard: a hot source has many shards. The driver
sees a row per source, at most ``MAX_SOURCES``; quotas of shards are worked out
a source at a time on the executors, at most ``MAX_SHARDS`` rows each.
"""

from __future__ import annotations

import heapq
import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

BLOCK_WORDS = 64
MAX_REPEAT = 3
SHARD_WORDS, SHARD_DOCS, MAX_SHARDS = 200_000, 50_000, 4096
#: More sources than this are an error.
MAX_SOURCES = 1_000_000


def n_words(text: Column) -> Column:
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D]", " ")
    return F.size(F.array_remove(F.split(plain, " "), "")).cast("long")


def targets(sizes: list[int]) -> list[float]:
    """Words for each source, in the given order: weights 1, 2, 3, repeating, share the total; none gets more than MAX_REPEAT times its size, and what is over is shared again by weight."""
    left, weights, out = float(sum(sizes)), [1 + i % 3 for i in range(len(sizes))], [0.0] * len(sizes)
    free = [i for i in range(len(sizes))]
    while free:
        share = left / sum(weights[i] for i in free)
        full = [i for i in free if weights[i] * share > MAX_REPEAT * sizes[i]]
        if not full:
            for i in free:
                out[i] = weights[i] * share
            break
        for i in full:
            out[i] = float(MAX_REPEAT * sizes[i])
            left -= out[i]
        gone = set(full)
        free = [i for i in free if i not in gone]
    return out


def sainte_lague(votes: list[float], seats: int, most: list[int]) -> list[int]:
    """Seats by highest quotients votes / (2 k + 1), no more than ``most`` each; ties to the first.

    All but a few seats per party come from one division: with the final
    divisor d a party has votes / d rounded, so seats of a somewhat larger d
    are certain and the rest go one by one from a heap.
    """
    seats = min(seats, sum(m for v, m in zip(votes, most, strict=True) if v > 0))
    if seats <= 0:
        return [0] * len(votes)
    v, cap = np.array(votes, float), np.array([m if x > 0 else 0 for x, m in zip(votes, most, strict=True)], np.int64)
    at = lambda d: np.minimum(cap, np.floor(v / d + 0.5).astype(np.int64))
    low, high = v[v > 0].min() / (2.0 * seats + 2) / 2, v.max() * 4
    while at(low).sum() < seats:
        low /= 2
    for _ in range(200):  # at(high) stays at seats or below
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if at(mid).sum() > seats else (low, mid)
    got = at(high * (1 + 1e-9)).tolist()  # equal quotients all go through the heap
    heap = [(-v[i] / (2 * k + 1), i) for i, k in enumerate(got) if k < cap[i]]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < cap[i]:
            heapq.heappush(heap, (-v[i] / (2 * got[i] + 1), i))
    return got


def _sized(docs: DataFrame, *keep: str) -> DataFrame:
    # mark tells apart rows that share an id.
    mark = F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull())
    return docs.select("doc_id", "source", *keep, mark.alias("mark"), n_words(F.col("text")).alias("size"))


def _shard(n: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("mark")), n).cast("int")


_QUOTA = "place int, shard int, w long, n long, whole long, rest long, step long, offset long"


def _quotas(seed: int, block_words: int):
    def of_source(cells: pd.DataFrame) -> pd.DataFrame:
        """place, shard, w, seats of one source to the quota of each shard."""
        cells = cells.sort_values("shard")
        n = [max(1, (int(w) + block_words // 2) // block_words) for w in cells["w"]]
        most = [MAX_REPEAT * k if w else 0 for k, w in zip(n, cells["w"], strict=True)]
        got = sainte_lague([float(w) for w in cells["w"]], int(cells["seats"].iloc[0]), most)
        rows = []
        for place, shard, w, k, q in zip(cells["place"], cells["shard"], cells["w"], n, got, strict=True):
            rnd = random.Random(f"{seed} {place} {shard}")
            step = rnd.randrange(1, k + 1)
            while math.gcd(step, k) != 1:
                step = step % k + 1
            rows.append((place, shard, w, k, q // k, q % k, step, rnd.randrange(k)))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _QUOTA.split(", ")])

    return of_source


def mix(docs: DataFrame, *keep: str, seed: int = 1, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, source, ``keep`` columns, size, source_size, target, taken for every row.

    Null sources are one source, the last. Null and empty texts have size 0 and
    taken 0. Rows that repeat are separate documents, in a fixed order; rows
    that share an id and differ in text have an order of their own too. An
    empty table gives an empty result. Reruns with one seed agree.
    """
    spark = docs.sparkSession
    sized = cut(_sized(docs))
    found = sized.groupBy("source").agg(F.sum("size").alias("w"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    # Python orders strings by code point.
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    goal = targets([r["w"] for r in found])
    shards = [min(MAX_SHARDS, max(1, -(-r["w"] // SHARD_WORDS), -(-r["n"] // SHARD_DOCS))) for r in found]
    seats = sainte_lague(goal, round(sum(goal) / block_words), [-(-MAX_REPEAT * r["w"] // block_words) for r in found])
    kinds = "source string, source_size long, target double, n_shards int, place int, seats long"
    rows = [(r["source"], r["w"], t, k, i, q) for i, (r, t, k, q) in enumerate(zip(found, goal, shards, seats, strict=True))]
    sources = spark.createDataFrame(rows, kinds)
    # No hint: Spark broadcasts the sources while they are few, and else joins by key and splits hot ones.

    def placed(rows: DataFrame, *keep: str) -> DataFrame:
        at = rows.join(sources, rows["source"].eqNullSafe(sources["source"])).drop(sources["source"])
        return at.select("doc_id", "source", *keep, "mark", "size", "source_size", "target", "place", "seats", _shard(F.col("n_shards"), seed).alias("shard"))

    cells = placed(sized).groupBy("place", "shard", "seats").agg(F.sum("size").alias("w"))
    quota = cells.groupBy("place").applyInPandas(_quotas(seed, block_words), _QUOTA)
    dealt = placed(_sized(docs, *keep) if keep else sized, *keep).join(quota, ["place", "shard"])
    order = f"xxhash64({seed + 1}, doc_id, mark), doc_id, mark"
    before = F.expr(f"coalesce(sum(size) over (partition by place, shard order by {order} rows between unbounded preceding and 1 preceding), 0)")
    # Block b is the words from b w / n on, rounded down; a word x is in block ((x + 1) n - 1) / w.
    dealt = dealt.withColumn("first", before).withColumn("end", F.col("first") + F.col("size")).withColumn("w", F.greatest("w", F.lit(1)))
    some = F.expr("""
        aggregate(sequence(((first + 1) * n - 1) div w, (end * n - 1) div w), 0L, (a, b) -> a + case when (b * step + offset) % n < rest
          then least(end, (b + 1) * w div n) - greatest(first, b * w div n) else 0L end)""")
    taken = F.when(F.col("size") > 0, F.col("whole") * F.col("size") + some).otherwise(0)
    return dealt.select("doc_id", "source", *keep, "size", "source_size", "target", taken.cast("long").alias("taken"))
