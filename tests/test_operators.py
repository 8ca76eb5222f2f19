"""Single operators on hand values, and against exhaustive versions."""

import random

import pytest
from pyspark.sql import functions as F

from siftline.functions import geometry, identity, stats
from siftline.operators import alarms, ap, curves, dedup, integrity, matching, sampling
from siftline.sources.labels import apply_policy, parse_labels

BOX = "image_id long, box_idx int, cls int, x double, y double, w double, h double"
DET = "image_id long, det_idx int, cls int, x double, y double, w double, h double, conf double"


def test_labels(spark):
    lines = ["0 .5 .5 .2 .3", "0 nan .5 .2 .3", "3 .5 .5 .2 .3", "0 .5 .5 0 .2", "0 .5 .5 .2", "0 0.99 0.5 0.04 0.2", "  ", "0.5 .5 .5 .2 .2", "1 1.5 .5 .2 .2"]
    got = parse_labels(spark.createDataFrame(list(enumerate(lines)), "image_id int, line string"), ["smoke", "fire"]).orderBy("image_id").collect()
    assert [(r["image_id"], r["cls"], r["reason"]) for r in got] == [(0, 1, None), (1, None, "not_finite"), (2, None, "class"), (3, None, "zero_area_box"), (4, None, "field_count"), (5, 1, None), (7, None, "class"), (8, None, "invalid_normalized_box")]
    parsed = parse_labels(spark.createDataFrame([(0, "0 .5 .5 0 .2"), (1, "0 .5 .5 .1 .2")], "image_id int, line string"), ["fire", "smoke"])
    images = spark.createDataFrame([(0,), (1,), (2,)], "image_id int")
    assert [r["excluded"] for r in apply_policy(images, parsed, "exclude_invalid_images").orderBy("image_id").collect()] == [True, False, False]
    with pytest.raises(ValueError):
        apply_policy(images, parsed, "error")


def test_geometry(spark):
    one = spark.createDataFrame([(0.99, 0.5, 0.04, 0.2, 15.99), (0.5, 0.5, 0.1, 0.1, 16.0)], "x double, y double, w double, h double, v double")
    got = one.select(geometry.crosses_border().alias("c"), geometry.band(F.col("v"), (8.0, 16.0, 32.0)).alias("b")).collect()
    assert [tuple(r) for r in got] == [(True, 1), (False, 2)]


def test_threshold(spark):
    def fit(scores, labels):
        return alarms.threshold_under_budget(spark.createDataFrame([(0, s, y) for s, y in zip(scores, labels, strict=True)], "cls int, score double, label int"), 0.0).first()

    r = fit([0.9, 0.9, 0.8], [1, 0, 1])
    assert r["threshold"] > 1 and r["recall"] == 0
    r = fit([0.9, 0.7, 0.8], [1, 0, 1])
    assert (r["threshold"], r["recall"]) == (0.8, 1.0)
    assert alarms.threshold_under_budget(spark.createDataFrame([(0, 0.5, 1)], "cls int, score double, label int"), 0.1).count() == 0


def test_calibration(spark):
    rows = spark.createDataFrame([(0, 1.0, 1), (0, 0.0, 0)], "cls int, score double, label int")
    r = alarms.ece_brier(rows).first()
    assert r["ece"] == 0 and r["brier"] == 0
    p = spark.createDataFrame([(0.2,), (0.9,)], "p double").select(alarms.scaled(F.col("p"), 1.0).alias("q")).collect()
    assert [round(r["q"], 9) for r in p] == [0.2, 0.9]


def test_banded_search_is_complete(spark):
    random.seed(42)
    hashes = [random.getrandbits(8) for _ in range(60)] + [-1, 2**63 - 1, 5, 5]
    df = spark.createDataFrame(list(enumerate(hashes)), "id long, hash long")
    for radius in (0, 2, 5):
        got = {(r["a"], r["b"], r["distance"]) for r in dedup.near_pairs(df, radius).collect()}
        far = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
        assert got == {(i, j, far(a, b)) for i, a in enumerate(hashes) for j, b in enumerate(hashes) if i < j and far(a, b) <= radius}


ROW = "source_id string, split string, byte_sha string, pixel_sha string, dataset string, decode_error int"


@pytest.mark.parametrize("rows,kept,reasons", [
    ([("target", "train", "a", "p", "target", 0), ("ref", "test", "a", "p", "reference", 0)], [], {"cross_dataset_byte_duplicate"}),
    ([("target", "val", "a", "p", "target", 0), ("ref", "train", "b", "p", "reference", 0)], [], {"cross_dataset_decoded_duplicate"}),
    ([("t", "train", "a", "p", "target", 0), ("v", "val", "b", "p", "target", 0), ("test-z", "test", "c", "p", "target", 0), ("test-a", "test", "d", "p", "target", 0)], ["test-a"], {"cross_split_decoded_duplicate", "within_split_decoded_duplicate"}),
    ([("a", "train", "a", "p", "target", 0), ("b", "test", "b", "q", "target", 0)], ["a", "b"], set()),
    ([("bad", "train", "a", None, "target", 1)], [], {"image_decode_failure"}),
])
def test_survivors(spark, rows, kept, reasons):
    for order in (rows, rows[::-1]):
        got = dedup.select_survivors(spark.createDataFrame(order, ROW)).collect()
        assert sorted(r["source_id"] for r in got if r["kept"]) == kept and {r["reason"] for r in got if not r["kept"]} == reasons


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["label"] for r in dedup.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def _iou(a, b):
    side = lambda p, w: max(0.0, min(a[p] + a[w] / 2, b[p] + b[w] / 2) - max(a[p] - a[w] / 2, b[p] - b[w] / 2))
    both = side(0, 2) * side(1, 3)
    return both / (a[2] * a[3] + b[2] * b[3] - both)


def test_greedy_against_loop(spark):
    random.seed(7)
    box = lambda: (random.choice([0.4, 0.45, 0.5]), random.choice([0.4, 0.5]), 0.3, random.choice([0.2, 0.3]))
    gt = [(i, k, 0, *box(), random.choice([5.0, 20.0])) for i in range(30) for k in range(random.randint(0, 4))]
    det = [(i, k, 0, *box(), round(random.random(), 2)) for i in range(30) for k in range(random.randint(0, 6))]
    got = matching.greedy_flags(spark.createDataFrame(gt, BOX + ", size double"), spark.createDataFrame(det, DET), [0.5, 0.75], (10.0, 100.0)).collect()
    want = set()
    for t in (0.5, 0.75):
        for i in range(30):
            used, mine = set(), [g for g in gt if g[0] == i]
            for d in sorted((d for d in det if d[0] == i), key=lambda d: (-d[7], d[1])):
                free = [(_iou(g[3:7], d[3:7]), -k) for k, g in enumerate(mine) if k not in used]
                best = max(free, default=(-1, 0))
                flag = 0
                if best[0] >= t:
                    used.add(-best[1])
                    flag = 1 if 10 <= mine[-best[1]][7] < 100 else -1
                want.add((i, t, d[1], flag))
    assert {(r["image_id"], r["threshold"], r["det_idx"], r["flag"]) for r in got} == want


def test_average_precision(spark):
    random.seed(3)
    flags = [(0, 1, k, random.random(), random.choice([0, 1, 1, -1])) for k in range(50)]
    n = sum(f[4] == 1 for f in flags) + 5
    live = [f[4] for f in sorted(flags, key=lambda f: -f[3]) if f[4] >= 0]
    prec = [sum(live[: k + 1]) / (k + 1) for k in range(len(live))]
    want = sum(max(prec[k:]) for k in range(len(live)) if live[k]) / n
    rows = spark.createDataFrame(flags, "cls int, image_id long, det_idx int, conf double, flag int")
    totals = spark.createDataFrame([(0, n), (1, 0), (2, 4)], "cls int, n_gt long")
    got = {r["cls"]: r["ap"] for r in ap.average_precision(rows, totals, ["cls"]).collect()}
    assert abs(got[0] - want) < 1e-12 and got[1] is None and got[2] == 0.0


def test_fold_of_a_digest(spark):
    import hashlib

    df = sampling.hash_partition(spark.createDataFrame([(f"x{i}",) for i in range(50)], "id string"), "id", 7, "s")
    assert all(r["fold"] == int(hashlib.sha256(("s" + r["id"]).encode()).hexdigest(), 16) % 7 for r in df.collect())
    assert spark.range(1).select(identity.signed64(F.lit("ffffffffffffffff")).alias("v")).first()["v"] == -1


def test_required_n_and_t(spark):
    got = spark.createDataFrame([(0,), (1,), (30,), (1000,)], "d int").select(stats.t_critical(F.col("d")).alias("t")).collect()
    assert got[0]["t"] == float("inf") and got[1]["t"] == 12.706 and got[2]["t"] == 2.042 and abs(got[3]["t"] - 1.9623) < 1e-3
    t = spark.createDataFrame([(1.0, 0.0001), (1.0, 1.0)], "sigma double, target double")
    assert {r["target"]: r["n"] for r in stats.required_n(spark, t).collect()} == {0.0001: None, 1.0: 7}


def test_gates(spark):
    a, b = spark.createDataFrame([("x", "1"), ("y", None)], "k string, d string"), spark.createDataFrame([("x", "2"), ("z", "1"), ("y", None)], "k string, d string")
    assert {(r["k"], r["fault"]) for r in integrity.changed(a, b, "k", "d").collect()} == {("x", "changed"), ("y", "changed"), ("z", "added")}
    runs = spark.createDataFrame([(0, "p", 1, None), (0, "q", 1, None), (1, "p", 1, 2), (1, "q", 1, 2)], "seed int, method string, e int, f int")
    assert [tuple(r) for r in integrity.not_comparable(runs, ["seed"], ["e", "f"]).collect()] == [(0, "p", "q", ["f"])]


def test_curves(spark):
    c = spark.createDataFrame([(1, e, float(v)) for e, v in enumerate([3, 5, 5, 2], 1)], "run int, epoch int, metric double")
    r = curves.best_and_last(c).first()
    assert (r["best_epoch"], r["best"], r["last"]) == (2, 5.0, 2.0)
    assert curves.missing_epochs(c.filter("epoch != 3")).collect()[0]["epoch"] == 3
