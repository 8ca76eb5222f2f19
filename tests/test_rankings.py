"""Rankings are made once, however many overlaps and bands read them."""

from pyspark.sql import functions as F

from siftline.functions import ranges, stats
from siftline.operators import ap, integrity, reports


def _counted(monkeypatch, module, name):
    calls, was = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **k: (calls.append(1), was(*a, **k))[1])
    return calls


def _detections(spark):
    rows = [(i % 2, i, i % 7, ((i * 37) % 11) / 10, None if i % 5 == 0 else ((i * 13) % 50 + 50) / 100) for i in range(200)]
    return spark.createDataFrame(rows, "cls int, image_id long, det_idx int, conf double, iou double")


def test_one_ranking_serves_all_overlaps(spark, monkeypatch):
    found, steps = _detections(spark), [0.5, 0.75, 0.9]
    totals = spark.createDataFrame([(0, 120), (1, 0), (2, 3)], "cls int, n_gt long")
    want = set()
    for t in steps:
        flags = found.withColumn("flag", F.coalesce((F.col("iou") >= t).cast("int"), F.lit(0)))
        want |= {(r["cls"], t, r["n_gt"], None if r["ap"] is None else round(r["ap"], 12)) for r in ap.average_precision(flags, totals, ["cls"]).collect()}
    calls = _counted(monkeypatch, ranges, "ranged")
    got = ap.average_precision_at(found, totals, ["cls"], steps).collect()
    assert {(r["cls"], r["t"], r["n_gt"], None if r["ap"] is None else round(r["ap"], 12)) for r in got} == want and len(calls) == 1


def test_bands_and_thresholds_rank_once(spark, monkeypatch):
    boxes = spark.createDataFrame([(i, 0, 0, 0.5, 0.5, 0.2, 0.2, float(i)) for i in range(20)], "image_id long, box_idx int, cls int, x double, y double, w double, h double, size double")
    found = spark.createDataFrame([(i, 1, 0, 0.5, 0.5, 0.2, 0.2 if i % 3 else 0.13, 1 - i / 40) for i in range(24)], "image_id long, det_idx int, cls int, x double, y double, w double, h double, conf double")
    calls = _counted(monkeypatch, ranges, "ranged")
    got = {r["band"]: (r["n_gt"], r["ap50"], r["ap75"]) for r in ap.stratified_ap(boxes, found, {"all": (0.0, float("inf")), "low": (0.0, 10.0), "none": (50.0, 60.0)}, [0.5, 0.75]).collect()}
    assert len(calls) == 1 and got["none"] == (0, None, None) and got["all"][:2] == (20, 1.0) and got["low"][:2] == (10, 1.0)
    # At 0.75 images 0, 3, 6 and so on are false: the k-th true one below 10 is at rank 2, 3, 5, 6, 8, 9, and from there on precision is 2/3 at most.
    assert abs(got["low"][2] - 6 * (2 / 3) / 10) < 1e-12


def test_quantiles_and_edges_read_their_rows_once(spark, monkeypatch):
    """What is read again is written first: values of a ranking, and matched pairs with their errors."""
    calls, more = _counted(monkeypatch, stats, "cut"), _counted(monkeypatch, reports, "cut")
    pairs = spark.createDataFrame([(0, 0.5 + k / 10, *([0.5, 0.5, 0.2, 0.2] * 2)) for k in range(4)], "g_cls int, iou double, g_x double, g_y double, g_w double, g_h double, d_x double, d_y double, d_w double, d_h double")
    row = reports.edge_errors(pairs).collect()[0]
    assert (row["n"], *(round(row[c], 9) for c in ("iou", "left", "bottom"))) == (4, 0.65, 0.0, 0.0) and len(calls) == len(more) == 1


def test_sets_are_compared_by_one_grouping(spark):
    a, b = (spark.createDataFrame([(k,) for k in ks], "k long") for ks in ([1, 2, 2, None, 3], [3, 4, 4, None]))
    got = integrity.set_difference(a, b, "k")
    assert sorted(((r["side"], r["k"]) for r in got.collect()), key=str) == sorted([("left", 1), ("left", 2), ("left", None), ("right", 4), ("right", None)], key=str)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
