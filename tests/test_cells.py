"""Links of hashes within a large radius, by cells of wide bands."""

import random
from math import comb

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftline.functions import cells, pixels
from siftline.functions.identity import reaches
from siftline.operators import dedup
from siftline.plans import content


def _close(values, radius):
    return sorted((p, q, n) for i, p in enumerate(values) for q in values[i + 1 :] if (n := ((p ^ q) & (2**64 - 1)).bit_count()) <= radius)


@pytest.mark.parametrize("radius", [7, 8, 14, 21])
def test_links_are_those_of_all_pairs(spark, radius):
    """Chains of hashes that differ by about the radius, dense cells and both signs; each link comes once."""
    rng = random.Random(radius)
    values = {-(2**63), 2**63 - 1, -1, 0}
    for _ in range(40):
        h = rng.getrandbits(64)
        for n in (1, radius - 1, radius, radius + 1):
            for b in rng.sample(range(64), n):
                h ^= 1 << b
            values.add(h - 2**64 if h >= 2**63 else h)
    values |= {x << 8 for x in range(60)}  # one cell of the lowest band
    values = sorted(values)
    rows = spark.createDataFrame([(v,) for v in [*values, *values, None]], "hash long")
    got = sorted(tuple(r) for r in dedup.near_classes(rows, radius).collect())
    assert got == _close(values, radius)


def test_a_large_radius_compares_a_part_of_all_pairs():
    """At a radius of 14, bands that agree wholly had 16 values each, and 15 of them let 15 / 16 of all pairs meet."""
    for radius in (8, 14):
        cuts = reaches(radius)
        assert sum(reach + 1 for *_, reach in cuts) == radius + 1 and sum(w for _, w, _ in cuts) == 64
        assert sum(sum(comb(w, n) for n in range(reach + 1)) / 2**w for _, w, reach in cuts) < 0.3


def test_a_large_radius_is_no_join(spark):
    """Candidates are not rows: the cells compare them in place."""
    rows = spark.createDataFrame([(1,), (2,)], "hash long")
    plan = dedup.near_classes(rows, 14)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "FlatMapGroupsInArrow" in plan


def test_pairs_of_frames_are_not_dealt_out(spark):
    """Each pair comes once without a distinct: the only exchanges are those of the rows."""
    rng = random.Random(3)
    frames = [(i, rng.choice(["train", "val", "test"]), rng.randrange(3), rng.randrange(-30, 30)) for i in range(300)]
    got = dedup.adjacent_frames(spark.createDataFrame(frames, "id long, split string, prefix int, number long"))
    want = sorted((a[0], b[0]) for a in frames for b in frames if a[0] < b[0] and a[1] != b[1] and a[2] == b[2] and abs(a[3] - b[3]) <= 3)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("radius", [0, 1, 2, 4, 5, 6])
def test_links_of_a_small_radius_are_those_of_all_pairs(spark, radius):
    """Hashes around the radius apart, dense ones and both signs; each link comes once, of whichever bands agree."""
    rng = random.Random(radius)
    values = {-(2**63), 2**63 - 1, -1, 0, *range(40)}
    for _ in range(40):
        h = rng.getrandbits(64)
        for n in (1, max(1, radius - 1), radius, radius + 1):
            for b in rng.sample(range(64), n):
                h ^= 1 << b
            values.add(h - 2**64 if h >= 2**63 else h)
    values = sorted(values)
    rows = spark.createDataFrame([(v,) for v in [*values, *values, None]], "hash long")
    assert sorted(tuple(r) for r in dedup.near_classes(rows, radius).collect()) == _close(values, radius)


def test_hashes_that_are_not_near_hardly_meet(spark):
    """At a radius of 5 six bands of 10 or 11 bits let 6 / 2048 of all pairs meet as rows of a join: about 50,000 of these 6,000 hashes."""
    rng = random.Random(1)
    rows = spark.createDataFrame([(rng.getrandbits(64) - 2**63,) for _ in range(6000)], "h long")
    cuts = reaches(5, most=3)
    assert [w for _, w, _ in cuts] == [21, 22, 21] and [n for *_, n in cuts] == [1, 1, 1]
    come = cells._dealt(rows, cuts).withColumnRenamed("h", "i")
    assert come.join(cells._dealt(rows, [(s, w, 0) for s, w, _ in cuts]), ["k", "cell"]).filter("i < h").count() < 2000
    assert "Aggregate" not in cells.joined(rows, 5, cuts)._jdf.queryExecution().optimizedPlan().toString()


def test_similarity_of_windows_is_that_of_each_window(spark):
    """By sums of blocks: the same as from the windows themselves, also of flat images and of bytes; and images are read once for hashes, classes and copies."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(0, 256, (6, 32, 32)), np.full((2, 32, 32), 7)])
    y = np.clip(x + rng.integers(-30, 31, x.shape) * (np.arange(8) % 4 > 0)[:, None, None], 0, 255)
    cut = lambda v: np.lib.stride_tricks.sliding_window_view(v.astype(float), (8, 8), axis=(1, 2))[:, ::4, ::4]
    want = np.clip(pixels._similarity(cut(x), cut(y), (3, 4), 1), -1, 1).mean(axis=(1, 2))
    packed = lambda v: pd.Series([(r.ravel() - 128).astype(np.int8) for r in v])
    plain = lambda v: pd.Series([r.ravel().astype(float) for r in v])
    for form in (packed, plain):
        assert np.allclose(pixels.ssim_windowed.func(form(x), form(y)), want, rtol=0, atol=1e-12)


def test_images_are_read_once(spark, monkeypatch):
    """Classes, their copies and the links between them are all made from one written table."""
    rng = np.random.default_rng(3)
    gray = [[int(v) for v in rng.integers(0, 256, 1024)] for _ in range(3)]
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    images = spark.createDataFrame([(i, gray[i // 2]) for i in range(6)], "id long, gray array<int>").mapInPandas(counted, "id long, gray array<int>")
    monkeypatch.setattr(content, "derive", lambda *_: images)
    got = content.two_hash_confirmed(spark, "").collect()
    assert sorted((r["a"], r["b"]) for r in got if r["kind"] == "copy") == [(0, 1), (2, 3), (4, 5)] and seen.value == 6


def test_components_compare_hashes_once(spark, monkeypatch):
    """Components read their edges more than once, so these come from a written table and not from the comparison."""
    plans, was = [], dedup.components
    monkeypatch.setattr(dedup, "components", lambda edges: (plans.append(edges._jdf.queryExecution().executedPlan().toString()), was(edges))[1])
    rows = spark.createDataFrame([(1, 0), (2, 3), (3, 3), (4, -1), (5, 2**40 - 1)], "id long, hash long")
    assert sorted(tuple(r) for r in dedup.near_components(rows, 14).collect()) == [(1, 1), (2, 1), (3, 1)]
    assert len(plans) == 1 and "FlatMapGroupsInArrow" not in plans[0]


def test_matches_compare_hashes_once(spark):
    """Links are read in both directions, so these come from a written table and not from the comparison."""
    added = spark.createDataFrame([(1, "x", 0), (2, "y", 2**40 - 1)], "id long, sha string, hash long")
    known = spark.createDataFrame([(7, "x", 3), (8, "z", 0)], "id long, sha string, hash long")
    got = dedup.matches_in_reference(added, known, 14)
    assert "FlatMapGroupsInArrow" not in got._jdf.queryExecution().executedPlan().toString()
    assert [(r["id"], [m["with"] for m in r["matches"]]) for r in got.collect()] == [(1, [7, 8, 7])]


def test_frames_are_counted_by_place(spark):
    """The number of the pairs that the listing has, nulls aside; a place of many rows is one row to the joins."""
    rng = random.Random(5)
    frames = [(k, rng.choice(["train", "val", "test", None]), rng.choice([0, 1, None]), rng.choice([*range(12), None])) for k in range(400)]
    rows = spark.createDataFrame(frames, "id long, split string, prefix int, number long")
    got = dedup.adjacent_frame_count(rows).first()["n"]
    assert got == dedup.adjacent_frames(rows).count() > 2000
    many = spark.range(200_000).select("id", F.when(F.col("id") % 2 == 0, "train").otherwise("val").alias("split"), F.lit(1).alias("prefix"), F.lit(7).alias("number"))
    assert dedup.adjacent_frame_count(many).first()["n"] == 100_000**2
    assert dedup.adjacent_frame_count(many.filter("id < 0")).first()["n"] == 0
