"""Operators that once did less than the whole job, against exhaustive versions."""

import random

import numpy as np
import pytest

from siftline.functions import pixels
from siftline.operators import alarms, dedup, power


def _far(a, b):
    return (int(a) ^ int(b)).bit_count() if (a ^ b) >= 0 else ((int(a) ^ int(b)) & (2**64 - 1)).bit_count()


def test_two_hashes_confirm(spark):
    rng, rows = np.random.default_rng(4), []
    for i in range(24):
        base = np.kron(rng.integers(40, 200, (8, 8)), np.ones((4, 4))) if i % 6 else np.full((32, 32), 90.0) + rng.integers(0, 3, (32, 32))
        corner, noise, tilt = np.zeros((32, 32)), rng.integers(-90, 90, (32, 32)), np.arange(32)[None, :] * 2.5
        corner[:12, :12] = 55
        rows += [np.clip(np.round(base + x), 0, 255) for x in (0, 15, corner, noise, noise // 4, tilt)]
    gray, ids = [[int(v) for v in r.ravel()] for r in rows], range(len(rows))
    import pandas as pd

    one = pd.Series(gray)
    right, left, low = pixels.dhash_right.func(one), pixels.dhash_left.func(one), pixels.phash.func(one)
    pair = lambda f, i, j: float(f.func(pd.Series([gray[i]]), pd.Series([gray[j]]))[0])
    both, screen, dh, ph, rejected = set(), set(), set(), set(), 0
    place = [(["target", "reference"][i % 5 == 0], ["train", "val"][i % 2]) for i in ids]
    for i in ids:
        for j in range(i + 1, len(rows)):
            dd, dp = _far(right[i], right[j]), _far(low[i], low[j])
            (dh if dd <= 5 else set()).add((i, j)), (ph if dp <= 5 else set()).add((i, j))
            if min(dd, dp) <= 5:
                ok = dd <= 18 and dp <= 12 and (pair(pixels.ssim_windowed, i, j) >= 0.88 or (dd <= 4 and dp <= 6))
                rejected += not ok
                both |= {(i, j, dd, dp)} if ok else set()
            dd = _far(left[i], left[j])
            (a, p), (b, q) = place[i], place[j]
            if dp <= 4 and dd <= 4 and (a != b or p != q) and not a == b == "reference" and pair(pixels.ssim_global, i, j) >= 0.95:
                screen.add((i, j, dp, dd, bool(min(rows[i].std(), rows[j].std()) < 5)))
    assert both and screen and dh - ph and ph - dh and rejected and {s[4] for s in screen} == {True, False}
    df = spark.createDataFrame([(i, *place[i], gray[i]) for i in ids] + [(-1, "target", "val", None)], "id long, dataset string, split string, gray array<int>")
    assert {(r["a"], r["b"], r["dhash_distance"], r["phash_distance"]) for r in dedup.two_hash_confirmed(df).collect()} == both
    assert {(r["a"], r["b"], r["phash_distance"], r["dhash_distance"], r["low_texture"]) for r in dedup.near_screen(df).collect()} == screen
    assert all(r["pairs"] == 1 for r in [*dedup.two_hash_confirmed(df).collect(), *dedup.near_screen(df).collect()])


def _expanded(links, members):
    """The pairs of ids that links between classes and the classes' members stand for."""
    held = {}
    for r in members:
        held.setdefault(r["rep"], []).append(r["id"])
    own = {(i, j) for ids in held.values() for i in ids for j in ids if i < j}
    return own | {(min(i, j), max(i, j)) for r in links for i in held[r["a"]] for j in held[r["b"]] if i != j}


def test_confirmation_on_classes_of_copies(spark):
    """Copies are one class: links and members stand for exactly the pairs of an exhaustive comparison, and counts by scope for its counts."""
    import pandas as pd

    rng = np.random.default_rng(7)
    bases = [np.kron(rng.integers(40, 200, (8, 8)), np.ones((4, 4))) for _ in range(3)] + [np.full((32, 32), 77.0)]
    near = [np.clip(b + rng.integers(-6, 7, (32, 32)), 0, 255) for b in bases[:3]]
    gray = [[int(v) for v in g.ravel()] for g in [*bases, *near] for _ in range(int(rng.integers(1, 9)))]
    order = rng.permutation(len(gray))
    gray = [gray[k] for k in order]
    place = [(["target", "reference"][i % 4 == 0], ["train", "val"][i % 3 == 0]) for i in range(len(gray))]
    right, left, low = (f.func(pd.Series(gray)) for f in (pixels.dhash_right, pixels.dhash_left, pixels.phash))
    pair = lambda f, i, j: float(f.func(pd.Series([gray[i]]), pd.Series([gray[j]]))[0])
    both, screen, scopes = set(), set(), {}
    for i in range(len(gray)):
        for j in range(i + 1, len(gray)):
            dd, dp = _far(right[i], right[j]), _far(low[i], low[j])
            if min(dd, dp) <= 5 and dd <= 18 and dp <= 12 and (pair(pixels.ssim_windowed, i, j) >= 0.88 or (dd <= 4 and dp <= 6)):
                both.add((i, j))
            apart = place[i] != place[j] and not place[i][0] == place[j][0] == "reference"
            if apart and dp <= 4 and _far(left[i], left[j]) <= 4 and pair(pixels.ssim_global, i, j) >= 0.95:
                screen.add((i, j))
                x, y = sorted("/".join(p) for p in (place[i], place[j]))
                scopes[("pairs", f"{x} <-> {y}")] = scopes.get(("pairs", f"{x} <-> {y}"), 0) + 1
    for at in {"/".join(p) for p in place}:
        n = len({k for s in screen for k in s if "/".join(place[k]) == at})
        scopes |= {("images", at): n} if n else {}
    df = spark.createDataFrame([(i, *place[i], gray[i]) for i in range(len(gray))], "id long, dataset string, split string, gray array<int>")
    members = dedup.gray_classes(df, "dataset", "split")[0]
    assert _expanded(dedup.two_hash_confirmed(df).collect(), members.collect()) == both
    found = dedup.near_screen(df)
    assert sum(r["pairs"] for r in found.collect()) == len(screen)
    links = found.filter("a != b").selectExpr("a as p", "b as q")
    assert {(r["kind"], r["scope"]): r["n"] for r in dedup.scope_counts(members, links, "rep").collect()} == scopes


def test_near_dup_audit_by_value(spark):
    """The query's counts are those of the pairs that the screen's links stand for."""
    from conftest import DATA

    from siftline.plans import registry
    from siftline.sources.fixtures import GRAYS, derive

    images = derive(spark, DATA, GRAYS)
    found, members = dedup.near_screen(images).collect(), dedup.gray_classes(images, "dataset", "split")[0].collect()
    at = {r["id"]: (r["dataset"], r["split"]) for r in members}
    apart = lambda i, j: at[i] != at[j] and not at[i][0] == at[j][0] == "reference"
    pairs = {p for p in _expanded(found, members) if apart(*p)}
    flat = {p for p in _expanded([r for r in found if r["low_texture"]], [m for m in members if any(r["low_texture"] and m["rep"] in (r["a"], r["b"]) for r in found)]) if apart(*p)}
    want = {("candidates", "review"): len(pairs), ("candidates", "low_texture"): len(flat)}
    for i, j in pairs:
        key = ("pairs", " <-> ".join(sorted("/".join(at[k]) for k in (i, j))))
        want[key] = want.get(key, 0) + 1
    for p in {"/".join(v) for v in at.values()}:
        n = len({k for s in pairs for k in s if "/".join(at[k]) == p})
        want |= {("images", p): n} if n else {}
    got = registry.queries()["near_dup_audit"](spark, DATA).collect()
    assert {(r["kind"], r["scope"]): r["n"] for r in got} == want and len(pairs) > 0


def test_a_large_group_of_copies_is_a_row_a_scope(spark):
    n = 100_000
    rows = spark.range(n).selectExpr("id", "cast(7 as long) as hash", "'target' as dataset", "case when id % 4 = 0 then 'val' else 'train' end as split")
    assert dedup.class_pairs(rows, dedup.near_classes(rows, 14)).count() == 1
    got = {(r["kind"], r["scope"]): r["n"] for r in dedup.scope_counts(rows, dedup.near_classes(rows, 14)).collect()}
    assert got == {("pairs", "target/train <-> target/val"): (n // 4) * (3 * n // 4), ("images", "target/train"): 3 * n // 4, ("images", "target/val"): n // 4}


def test_components_of_paths_and_stars(spark):
    """A path of 100,000 nodes, a star, loops, repeated edges, and names in any order."""
    rng = random.Random(6)
    path = spark.range(100_000).selectExpr("id as a", "id + 1 as b")
    got = dedup.components(path)
    assert (got.count(), got.filter("label != 0").count()) == (100_001, 0)
    names = list(range(1, 400))
    rng.shuffle(names)
    edges = [(names[0], x) for x in names[1:100]] + [(names[100 + k], names[101 + k]) for k in range(150)] + [(names[260], names[260]), (names[5], names[5]), (names[0], names[3])]
    edges += [(names[270 + rng.randrange(100)], names[270 + rng.randrange(100)]) for _ in range(70)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["label"] for r in got} == {x: find(x) for x in parent} and len(got) == len(parent)
    none = spark.createDataFrame([], "a long, b long")
    assert dedup.components(none).count() == 0


def test_all_64_signs(spark):
    from conftest import DATA

    from siftline.plans import registry

    v = {r["vec_id"]: np.array(r["embedding"]) > 0 for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    want = {(i, j, int((v[i] != v[j]).sum())) for i in v for j in v if i < j and (v[i] != v[j]).sum() <= 14}
    assert {tuple(r) for r in registry.queries()["near_dup_banded_64"](spark, DATA).collect()} == want


SCORED = "image_id long, cls int, score double, label int, scene string"


def test_background_sweep(spark):
    from siftline.plans.alarms import GRID, SWEEP, TARGETS

    random.seed(9)
    y = np.array([[int(random.random() < 0.3), int(random.random() < 0.3)] for _ in range(400)])
    p = np.round(np.array([[random.random() ** 2, random.random() ** 3] for _ in y]) * 0.6, 2)
    t = np.array([0.12, 0.08])
    rows = spark.createDataFrame([(i, c, float(p[i, c]), int(y[i, c]), None) for i in range(len(y)) for c in (0, 1)], SCORED)
    limits = spark.createDataFrame([(0, 0.12), (1, 0.08)], "cls int, threshold double")

    def point(k):
        hit, bg = p >= t * k, y.sum(1) == 0
        return hit[y[:, 0] == 1, 0].mean(), hit[y[:, 1] == 1, 1].mean(), (hit & (y == 1)).any(1)[~bg].mean(), hit[bg].any(1).mean()

    assert np.array_equal(np.array(GRID), np.linspace(0.05, 12, 240))
    got = {r["factor"]: tuple(r)[1:] for r in alarms.background_sweep(rows, limits, SWEEP).collect()}
    assert set(got) == set(SWEEP) and len(SWEEP) == 11 and all(np.allclose(got[k], point(k)) for k in SWEEP)
    got = {r["target"]: r["factor"] for r in alarms.background_matched(alarms.background_sweep(rows, limits, GRID), TARGETS).collect()}
    assert got == {a: min(GRID, key=lambda k: (abs(point(k)[3] - a), k)) for a in (0.02, 0.05, 0.1)}
    none = alarms.background_sweep(rows.filter("cls = 0").withColumn("label", rows["label"] * 0 + 1), limits, SWEEP).first()
    assert none["alarm"] is None and none["recall_1"] is None and none["recall_0"] == none["recall_any"]


def test_bootstrap_units(spark):
    import hashlib

    random.seed(2)
    rows = [(i, c, random.random(), int(random.random() < 0.4), None) for i in range(40) for c in (0, 1)]
    limits = spark.createDataFrame([(0, 0.5), (1, 0.4)], "cls int, threshold double")
    for scene in (lambda i: None, lambda i: f"s{i % 7}"):
        use = [(*r[:4], scene(r[0])) for r in rows]
        units = {}
        for r in use:
            units.setdefault(r[4] if r[4] is not None else r[0], []).append(r)
        units, values = [units[k] for k in sorted(units)], {}
        for b in range(1000):
            drawn = [r for u in range(len(units)) for r in units[int(hashlib.md5(f"0:{b}:{u}".encode()).hexdigest()[:12], 16) % len(units)]]
            on = [(r[1], r[3], r[2] >= (0.5, 0.4)[r[1]]) for r in drawn]
            for c in (0, 1):
                values.setdefault(("recall", c), []).append(np.mean([h for k, label, h in on if k == c and label]))
            pairs = [(on[k][2] or on[k + 1][2]) for k in range(0, len(on), 2) if not on[k][1] and not on[k + 1][1]]
            values.setdefault(("background_alarm_fraction", None), []).extend([np.mean(pairs)] if pairs else [])
        got = {(r["metric"], r["cls"]): (r["n_replicates"], r["low"], r["high"]) for r in alarms.bootstrap_report(spark.createDataFrame(use, SCORED), limits).collect()}
        assert set(got) == set(values) and all(np.allclose(got[k], (len(v), *np.quantile(v, [0.025, 0.975]))) for k, v in values.items())
    with pytest.raises(Exception, match="all or none"):
        alarms.bootstrap_report(spark.createDataFrame([(*rows[0][:4], "s"), *rows[1:]], SCORED), limits).collect()


def test_effects_without_a_common_seed(spark):
    runs = spark.createDataFrame([(0, 1, 1.0), (0, 2, 2.0), (3, 1, 1.5), (3, 2, 2.75), (6, 8, 5.0), (6, 9, 6.0)], "config int, seed int, best double")
    got = {r["config"]: tuple(r)[1:] for r in power.paired_effects(runs, 0).collect()}
    assert got[6] == (0, 4.0, None, None) and got[3][:2] == (2, 0.625) and got[3][3] is False
