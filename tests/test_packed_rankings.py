"""Several rankings of the same detections, packed by ranges of the order."""

import random

import pytest
from pyspark.sql import functions as F

from siftline.functions import rankings
from siftline.operators import ap, reports


def _brute(rows, n_gt):
    """ap of (score, image_id, det_idx, flag) by the definition."""
    rows = sorted(rows, key=lambda r: (-r[0], r[1], r[2]))
    hits, precisions, flags = 0, [], [r[3] for r in rows]
    for k, flag in enumerate(flags):
        hits += flag
        precisions.append(hits / (k + 1))
    return sum(max(precisions[k:]) for k, flag in enumerate(flags) if flag) / n_gt


def _found(n):
    """Detections with many equal scores, qualities and images; a third of them hit."""
    rng = random.Random(n)
    return [(k % 2, rng.randrange(40) - 20, k, rng.randrange(1, 9) / 10, rng.randrange(1, 6) / 8, rng.random() < 0.3) for k in range(n)]


def _wanted(found, gamma=0.5):
    for cls in (0, 1):
        own = [r for r in found if r[0] == cls]
        hits = [r for r in own if r[5]]
        places = [r[3] for r in sorted(hits, key=lambda r: (-r[3], r[1], r[2]))]
        moved = {r[2]: p for r, p in zip(sorted(hits, key=lambda r: (-r[4], r[1], r[2])), places, strict=True)}
        kinds = {"p": lambda r: r[3], "pq": lambda r: r[3] * r[4], "pq_gamma": lambda r: r[3] * r[4] ** gamma, "q": lambda r: r[4], "oracle": lambda r, m=moved: m.get(r[2], r[3])}
        for name, score in kinds.items():
            yield cls, name, round(_brute([(round(score(r), 9), r[1], r[2], int(r[5])) for r in own], 100), 12)


@pytest.mark.parametrize("entries", [7, 60, 500_000])
def test_five_rankings_without_a_row_for_each(spark, monkeypatch, entries):
    """The same as by the definition, whatever the ranges, and a class without detections has 0; no row is made for a detection and a ranking."""
    monkeypatch.setattr(rankings, "RANGE_ROWS", entries)
    monkeypatch.setattr(rankings, "HELD_ROWS", 50)
    made, was = [], rankings._borders
    monkeypatch.setattr(rankings, "_borders", lambda rows, *a: (made.append(rows.count()), was(rows, *a))[1])
    found = _found(400)
    rows = spark.createDataFrame(found, "cls int, image_id long, det_idx int, conf double, quality double, hit boolean")
    totals = spark.createDataFrame([(0, 100), (1, 100), (2, 5), (3, 0)], "cls int, n_gt long")
    got = ap.average_precision_by(reports.score_variants(rows.drop("hit"), rows.filter("hit").drop("hit")), totals, ["cls"], reports.VARIANTS).collect()
    want = set(_wanted(found)) | {(c, v, a) for c, a in ((2, 0.0), (3, None)) for v in reports.VARIANTS}
    assert {(r["cls"], r["variant"], r["ap"] if r["ap"] is None else round(r["ap"], 12)) for r in got} == want and len(got) == 20
    hits = sum(r[5] for r in found)
    assert made == [len(found) + 3 * hits]


def test_ranges_follow_the_order():
    """Entries of one score are told apart by their ids, and those of a border lie behind it."""
    import numpy as np

    borders = np.array([-3.0, -2.0, -2.0, -1.0]), np.array([5, 1, 4, 0])
    score, image = np.array([4.0, 3.0, 3.0, 2.5, 2.0, 2.0, 2.0, 1.0, 0.0]), np.array([9, 4, 5, 0, 0, 1, 9, 0, 0])
    assert rankings._range_of(score, image, borders).tolist() == [0, 0, 1, 1, 1, 2, 3, 4, 4]


def test_ranked_rows_are_a_table(spark):
    """Ranges are read from a Parquet table: a checkpoint writes each row as a Java object of its own."""
    from siftline.functions.ranges import ranged

    at = ranged(spark.range(100).withColumn("v", F.col("id") % 7), "v")
    assert "parquet" in at._jdf.queryExecution().executedPlan().toString().lower() and at.count() == 100


def test_lines_are_numbered_once_for_boxes_and_predictions(spark):
    """The tables of the two texts, from lines that a plan reads and does not number."""
    from conftest import DATA

    from siftline.sources import fixtures

    boxes, found = fixtures.boxes_and_predictions(spark, DATA)
    for got, text in ((boxes, fixtures.BOXES), (found, fixtures.PREDICTIONS)):
        want = fixtures.derive(spark, DATA, text)
        assert got.dtypes == want.dtypes and sorted(got.collect()) == sorted(want.collect())
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "l_linenumber" not in plan(boxes) + plan(found)


def test_variants_rank_nothing_when_read(spark):
    """The rows are read three times, so no window is left in their plan."""
    found = spark.createDataFrame(_found(50), "cls int, image_id long, det_idx int, conf double, quality double, hit boolean")
    rows = reports.score_variants(found.drop("hit"), found.filter("hit").drop("hit"))
    assert "Window" not in rows._jdf.queryExecution().optimizedPlan().toString() and rows.count() == 50 + 3 * found.filter("hit").count()
