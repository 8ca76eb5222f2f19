"""Commands, guards, run folders, image files, and operators on classes of copies."""

import json
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline import __main__ as commands
from siftline.functions import ranges
from siftline.operators import dedup, guards, reports
from siftline.sources import images, protocol, readers, runs

CONFIG = """
# a comment
protocol: paper-v1
datasets:
  d:
    root: {root}   # places
    layout: dfire
    source_names: [smoke, fire]
    invalid_box_policy: exclude_invalid_images
prepared_root: {root}/prepared
results_root: results
seeds: [0, 1]
methods:
  baseline: {{architecture: baseline, alpha: 0.25, style: false}}
  names:
    - a
    - 'b'
"""


def _png(px, filters=(0,), colour=2):
    h, w, n = px.shape
    rows, above = b"", np.zeros(w * n, int)
    for y in range(h):
        row, kind = px[y].reshape(-1).astype(int), filters[y % len(filters)]
        left = np.concatenate([np.zeros(n, int), row[:-n]])
        corner = np.concatenate([np.zeros(n, int), above[:-n]])
        p = left + above - corner
        near = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = {0: 0 * row, 1: left, 2: above, 3: (left + above) // 2, 4: near}[kind]
        rows += bytes([kind]) + ((row - guess) & 255).astype(np.uint8).tobytes()
        above = row
    part = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def _bmp(px):
    h, w, _ = px.shape
    rows = b"".join(px[y, :, ::-1].tobytes() + bytes(-3 * w % 4) for y in range(h - 1, -1, -1))
    return b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows


def test_image_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    px = rng.integers(0, 256, (23, 17, 3), dtype=np.uint8)
    for d in ("images/train", "images/val"):
        (tmp_path / d).mkdir(parents=True)
    files = {"images/train/a.png": _png(px, (0, 1, 2, 3, 4)), "images/train/b.bmp": _bmp(px), "images/train/c.png": _png(px[:, :, :1], (4,), 0), "images/val/d.png": _png(px)[:60], "images/val/e.jpg": b"\xff\xd8\xff\xe1" + struct.pack(">H", 34) + b"Exif\0\0" + struct.pack("<2sHIHHHIHxxI", b"II", 42, 8, 1, 0x0112, 3, 1, 6, 0) + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, 50, 90, 1) + bytes(3), "images/val/f.png": b"", "images/val/x.txt": b"no"}
    for k, v in files.items():
        (tmp_path / k).write_bytes(v)
    got = {r["path"].rpartition("/")[2]: r for r in images.content_scan(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.png", "b.bmp", "c.png", "d.png", "e.jpg", "f.png"}
    assert got["a.png"]["decoded_sha256"] == got["b.bmp"]["decoded_sha256"] != got["c.png"]["decoded_sha256"] and got["a.png"]["sha256"] != got["b.bmp"]["sha256"]
    assert (got["a.png"]["width"], got["a.png"]["height"]) == (17, 23) and got["a.png"]["decode_error"] is None and len(got["a.png"]["gray"]) == 1024
    assert got["d.png"]["decode_error"] and got["d.png"]["width"] == 17 and got["f.png"]["decode_error"] and got["f.png"]["width"] is None
    assert (images.decode(files["images/train/a.png"]) == px).all() and (images.decode(files["images/train/c.png"])[:, :, 2] == px[:, :, 0]).all()
    sizes = {r["path"].rpartition("/")[2]: (r["width"], r["height"]) for r in images.header_scan(spark, str(tmp_path)).collect()}
    assert sizes["e.jpg"] == (50, 90) and sizes["a.png"] == (17, 23) and sizes["f.png"] == (None, None)
    assert images.content_scan(spark, str(tmp_path), per_split=1).count() == 2
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).select("path", "length", "modificationTime")
    before = spark.createDataFrame(listed.collect())
    (tmp_path / "images/val/x.txt").write_bytes(b"other")
    (tmp_path / "images/val/d.png").unlink()
    assert {(r["path"].rpartition("/")[2], r["fault"]) for r in images.changed_files(before, spark, str(tmp_path)).collect()} == {("x.txt", "changed"), ("d.png", "removed")}


def test_protocol(tmp_path):
    config = protocol.parse_yaml(CONFIG.format(root="/x"))
    assert config["datasets"]["d"] == {"root": "/x", "layout": "dfire", "source_names": ["smoke", "fire"], "invalid_box_policy": "exclude_invalid_images"}
    assert config["seeds"] == [0, 1] and config["methods"]["baseline"] == {"architecture": "baseline", "alpha": 0.25, "style": False} and config["methods"]["names"] == ["a", "b"]
    (tmp_path / "p.yaml").write_text(CONFIG.format(root="/x").replace("paper-v1", "paper-v2"))
    with pytest.raises(ValueError):
        protocol.read_protocol(str(tmp_path / "p.yaml"))
    (tmp_path / "q.yaml").write_text(CONFIG.format(root="/x").replace("layout: dfire", "layout: other"))
    with pytest.raises(ValueError):
        protocol.read_protocol(str(tmp_path / "q.yaml"))
    assert protocol.class_names({"names": {1: "b", 0: "a"}}) == ["a", "b"] and protocol.class_names({}) == ["fire", "smoke"] and protocol.resolve("a", "/r/") == "/r/a"


def test_guards(spark):
    config = protocol.parse_yaml(CONFIG.format(root="/x"))
    assert guards.check_run(config, "d", "baseline", 1, "v-1_a") == "d/v-1_a/baseline/seed1"
    for bad in (("e", "baseline", 0, "v"), ("d", "other", 0, "v"), ("d", "baseline", 7, "v"), ("d", "baseline", 0, "a b"), ("d", "baseline", 0, "")):
        with pytest.raises(ValueError):
            guards.check_run(config, *bad)
    rows = [{"split": "test", "seed": s, "checkpoint_sha256": str(s), "metrics": {"m": 1}} for s in (0, 1)]
    guards.check_summary(rows, [1, 0])
    for bad in ([rows[0]], [rows[0], rows[1] | {"checkpoint_sha256": "0"}], [rows[0], rows[1] | {"metrics": {"k": 1}}], [rows[0], rows[1] | {"split": "val"}]):
        with pytest.raises(ValueError):
            guards.check_summary(bad, [0, 1])
    assert guards.resolve_reference("p", ["p2", "base"]) == "p2" and guards.resolve_reference("p", ["p2", "p3"]) is None and guards.resolve_reference("p2", ["p2", "p2x"]) == "p2"
    assert guards.canonical_sha256({"b": [1], "a": "é"}) == guards.canonical_sha256({"a": "é", "b": [1]})
    with pytest.raises(ValueError):
        guards.canonical_sha256({"a": float("nan")})
    assert set(guards.provenance(["x"], {"f": b"1"})) == {"created", "python", "spark", "argv", "sources"}
    m, scan = spark.createDataFrame([("a", 1), ("b", 2)], "name string, k int"), spark.createDataFrame([("a", "s"), ("b", "t"), ("c", "u"), ("c", "v")], "name string, sha string")
    assert {tuple(r) for r in guards.join_by_name(m, scan).collect()} == {("a", 1, "s"), ("b", 2, "t")}
    for extra in ("c", "zz"):
        with pytest.raises(Exception, match="not once"):
            guards.join_by_name(m.union(spark.createDataFrame([(extra, 3)])), scan).collect()
    both = guards.append_exclusions(spark.createDataFrame([("x", "r")], "id string, reason string"), spark.createDataFrame([("y", 1)], "id string, line int"), "old")
    assert {tuple(r) for r in both.collect()} == {("x", "r", None), ("y", "old", 1)}


def test_run_folders(spark, tmp_path):
    for k, (head, rows) in {"p/base/seed0": ("epoch,time, metrics/a ,val/x", ["1,10,0.5,2", "2,20,0.7,1", "3,30,0.7,x"]), "p/big_module-z_x_seed1": ("val/x,epoch,metrics/a", ["9,1,0.25", "8,2,"])}.items():
        (tmp_path / k).mkdir(parents=True)
        (tmp_path / k / "results.csv").write_text("\n".join([head, *rows]) + "\n")
    (tmp_path / "p/base/seed0/args.yaml").write_text("imgsz: 800 # px\nbatch: 16\nseed: 0\nmodel: 'm.pt'\n")
    (tmp_path / "p/base/seed0/run.json").write_text(json.dumps({"protocol": "paper-v1", "seed": 0, "training_finished": True}))
    (tmp_path / "p/big_module-z_x_seed1/run.json").write_text("{broken")
    got = {(r["run"].rpartition("/p/")[2], r["epoch"], r["metric"]): r["value"] for r in runs.curves(spark, str(tmp_path)).collect()}
    assert got["base/seed0", 1, "val/x"] == 2 and got["big_module-z_x_seed1", 1, "val/x"] == 9 and got["big_module-z_x_seed1", 1, "metrics/a"] == 0.25
    assert ("base/seed0", 3, "val/x") not in got and ("big_module-z_x_seed1", 2, "metrics/a") not in got
    assert {r["metric"] for r in readers.curves(spark, str(tmp_path), "metrics/").collect()} == {"metrics/a"}
    best = runs.best_rows(runs.curves(spark, str(tmp_path)), "metrics/a")
    row = {r["run"].rpartition("/p/")[2]: tuple(r)[1:] for r in best.collect()}
    assert row["base/seed0"] == (2, 0.7, 3, 0.7, 3, 10.0) and row["big_module-z_x_seed1"] == (1, 0.25, 1, 0.25, 1, None)
    assert [tuple(r)[1:5] for r in runs.settings(spark, str(tmp_path)).collect()] == [(800, 16, 0, "m.pt")]
    meta = runs.metadata(spark, str(tmp_path))
    assert {(r["run"].rpartition("/p/")[2], r["protocol"], r["finished"]) for r in meta.collect()} == {("base/seed0", "paper-v1", True), ("big_module-z_x_seed1", None, None)}
    assert runs.run_status(best, meta, 3).filter("complete and finished").count() == 1
    (tmp_path / "cost.csv").write_text("run_match,params,gflops\nBase,10,6.5\n,1,2\nx,1,no\n")
    assert [tuple(r) for r in runs.costs(spark, str(tmp_path / "cost.csv")).collect()] == [("base", 10, 6.5)]
    (tmp_path / "bundle.json").write_text(json.dumps({"h/a/results.csv": "epoch, m\n1, 2\n", "h/a/other": "x"}))
    assert [tuple(r) for r in runs.bundled_curves(spark, str(tmp_path / "bundle.json")).collect()] == [("h/a", 1, "m", 2.0)]
    names = ["/r/x/base/seed2", "/r/x/base_seed1", "/r/x/base_module-z_x", "/r/D-Fire_p2__a_seed3"]
    k = [tuple(r["k"]) for r in spark.createDataFrame([(n,) for n in names], "r string").select(runs.run_keys(F.col("r"), "/r", "D-Fire_").alias("k")).collect()]
    assert k == [("x/base", 2), ("x/base", 1), ("x/base", None), ("p2_a", 3)]
    k = [tuple(r["k"]) for r in spark.createDataFrame([("D_p2_seed3",), ("D_p2_seed3_module-x",), ("D_",)], "r string").select(runs.legacy_keys(F.col("r"), "D_").alias("k")).collect()]
    assert k == [("p2", 3), ("p2", None), ("D_", None)]


def test_classes_of_copies(spark):
    """Counts, subsets and components by classes against all pairs; copies, nulls and lone rows among them."""
    random.seed(3)
    base = [random.getrandbits(62) for _ in range(12)]
    rows = [(i, random.choice(["train", "val", "test"]), None if i % 17 == 0 else random.choice(base) ^ (1 << random.randrange(60) if i % 3 else 0)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, split string, hash long")
    pairs = [(a, b) for a in rows for b in rows if a[0] != b[0] and a[2] is not None and b[2] is not None and (a[2] ^ b[2]).bit_count() <= 3]
    want = {(s, t): len({a[0] for a, b in pairs if a[1] == s and b[1] == t}) for s in ("train", "val", "test") for t in ("train", "val", "test")}
    assert {(r["split_a"], r["split_b"]): r["matched"] for r in dedup.leakage_matrix(df, 3).collect()} == want
    dup = {a[0] for a, b in pairs if b[1] == "train"}
    assert {r["id"]: r["subset"] for r in dedup.clean_and_duplicate(df, 3).collect()} == {r[0]: "dup" if r[0] in dup else "clean" for r in rows if r[1] != "train"}
    edges = spark.createDataFrame([(a[0], b[0]) for a, b in pairs], "a long, b long")
    assert {tuple(r) for r in dedup.near_components(df, 3).collect()} == {tuple(r) for r in dedup.components(edges).collect()}


def test_survivors_by_either_digest(spark):
    cols = "source_id string, dataset string, split string, byte_sha string, pixel_sha string, decode_error int"
    rows = [("a", "target", "train", "b1", "p1", 0), ("b", "target", "test", "b1", "p2", 0), ("c", "target", "val", "b2", "p2", 0), ("d", "target", "val", "b3", None, 0), ("e", "target", "val", None, None, 0), ("f", "target", "train", "b3", "p9", 0), ("g", "target", "train", "b4", "p4", 1), ("h", "target", "train", "b5", "p7", 0), ("r", "reference", "train", "b6", "p7", 0)]
    got = {r["source_id"]: (r["kept"], r["reason"]) for r in dedup.select_survivors(spark.createDataFrame(rows, cols)).collect()}
    assert got == {"a": (False, "cross_split_byte_duplicate"), "b": (True, None), "c": (False, "cross_split_decoded_duplicate"), "d": (True, None), "e": (True, None), "f": (False, "cross_split_byte_duplicate"), "g": (False, "image_decode_failure"), "h": (False, "cross_dataset_decoded_duplicate")}


def test_running_sums(spark):
    random.seed(5)
    rows = [(random.randrange(2), round(random.uniform(-0.2, 1.2), 2), i, random.randrange(5)) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, s double, i int, v int")
    for down in (True, False):
        got = {r["i"]: r["sum"] for r in ranges.running_sums(df, ["g"], "s", ["i"], {"sum": F.col("v")}, down).collect()}
        for g in (0, 1):
            total = 0
            for r in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1] if down else r[1], r[2])):
                total += r[3]
                assert got[r[2]] == total


def test_ranges_of_crowded_scores(spark):
    """Scores crowded near 0, and a third of all rows at one score: no range is much deeper than the others, and results are those of one ranking."""
    n = 60_000
    df = spark.range(n).selectExpr("id as i", "0 as g", "case when id % 3 = 0 then 0.001D else pow((id * 7919 % 60013) / 60013D, 8) end as s").repartition(16)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        run = ranges.running_sums(df, ["g"], "s", ["i"], {"place": F.lit(1)}).cache()
        depth = [r["n"] for r in run.groupBy("_range").agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert len(depth) > 4 and max(depth) <= 4 * n / len(depth)
    ranked = sorted(((r["s"], r["i"], r["place"]) for r in run.collect()), key=lambda r: (-r[0], r[1]))
    assert [r[2] for r in ranked] == list(range(1, n + 1))
    made, total = ranges.numbered(df, "s", "i")
    ranked = sorted((r["s"], r["i"], r["number"]) for r in made.collect())
    assert total == n and [r[2] for r in ranked] == list(range(n))
    assert ranges.numbered(df.limit(0), "s", "i")[1] == 0


def test_names_and_tags(spark):
    df = spark.createDataFrame([("a/fire_12.jpg",), ("x9_1",), ("plain",), ("Ünï7b08",)], "n string")
    got = [(r["c"], r["p"]["letters"], int(r["p"]["number"])) for r in df.select(reports.name_category(F.col("n")).alias("c"), reports.stem_parts(F.col("n")).alias("p")).collect()]
    assert got == [("fire", "afirejpg", 12), ("(other)", "x", 91), ("(other)", "plain", -1), ("(other)", "Ünïb", 708)]


def test_commands(spark, tmp_path):
    root = tmp_path / "data"
    px = np.random.default_rng(2).integers(0, 256, (20, 20, 3), dtype=np.uint8)
    for split, n in (("train", 3), ("val", 2), ("test", 1)):
        for kind in ("images", "labels"):
            (root / kind / split).mkdir(parents=True)
        for i in range(n):
            (root / f"images/{split}/{split}{i}.png").write_bytes(_png(px if i == 0 else 255 - px))
            (root / f"labels/{split}/{split}{i}.txt").write_text("" if i == 1 else "0 0.5 0.5 0.2 0.2\n" if split != "train" or i == 0 else "0 0.5 0.5 0 0.2\n")
    (tmp_path / "c.yaml").write_text(CONFIG.format(root=root))
    run = lambda *a: commands.main(["--config", str(tmp_path / "c.yaml"), *map(str, a)])
    assert run("plan", "--dataset", "d", "--seed", 1)["run"] == "results/d/v1/baseline/seed1"
    with pytest.raises(SystemExit):
        run("train", "--dataset", "d", "--execute")
    with pytest.raises(ValueError):
        run("plan", "--dataset", "d", "--seed", 9)
    assert run("check-model", "--output", tmp_path / "m.json")["checked"] is False
    got = run("prepare", "--dataset", "d")
    assert got["images"] == {"train": 2, "val": 2, "test": 1} and got["excluded"] == 1
    got = run("audit", "--datasets", "d", "--output", tmp_path / "audit", "--hashes")
    assert [(r["split"], r["images"], r["background"], r["excluded"], r["smoke_boxes"]) for r in got["counts"]] == [("test", 1, 0, 0, 1), ("train", 3, 1, 1, 1), ("val", 2, 1, 0, 1)]
    assert got["label_issues"][0]["reason"] == "zero_area_box" and got["exact_groups"] == 2 and got["near_pairs"] == 5
    random.seed(1)
    for split in ("val", "test"):
        rows = []
        for i in range(60):
            truth = [[c, 0.5, 0.5, 0.2, 0.2] for c in (0, 1) if random.random() < 0.4]
            rows.append({"id": f"{split}{i}", "group": None, "truth": truth, "predictions": [[*t, random.uniform(0.4, 1)] for t in truth] + [[random.randrange(2), 0.2, 0.2, 0.1, 0.1, random.uniform(0, 0.6)]]})
        head = {"schema": 1, "dataset": "d", "split": split, "names": ["fire", "smoke"], "checkpoint_sha256": "c", "manifest_sha256": "m", "training_dataset": "d", "method": "baseline", "seed": 0, "tag": "v1", "images": rows}
        (tmp_path / f"{split}.json").write_text(json.dumps(head))
        (tmp_path / f"{split}1.json").write_text(json.dumps(head | {"seed": 1, "checkpoint_sha256": "e"}))
    cal = run("calibrate", "--predictions", tmp_path / "val.json", "--output", tmp_path / "cal.json", "--max-fpr", 0.05)
    assert len(cal["classes"]) == 2 and all(c["fpr"] <= 0.05 for c in cal["classes"])
    with pytest.raises(ValueError):
        run("calibrate", "--predictions", tmp_path / "test.json", "--output", tmp_path / "x.json")
    rel = run("reliability", "--predictions", tmp_path / "test.json", "--calibration", tmp_path / "cal.json", "--output", tmp_path / "rel.json", "--bootstrap", 20)
    assert {r["metric"] for r in rel["intervals"]} == {"recall", "background_alarm_fraction"} and rel["background"]["n_background"] == rel["background_boxes"]["n_background"]
    with pytest.raises(ValueError):
        run("reliability", "--predictions", tmp_path / "test1.json", "--calibration", tmp_path / "cal.json", "--output", tmp_path / "y.json")
    files = []
    for k in ("test", "test1"):
        files.append(tmp_path / f"{k}-metrics.json")
        got = run("evaluate", "--predictions", tmp_path / f"{k}.json", "--dataset", "d", "--split", "test", "--output", files[-1])
        assert 0.5 < got["metrics"]["mAP50"] <= 1
    got = run("summarize", "--metrics", *files, "--output", tmp_path / "s.json")
    assert {(g["metric"], g["n"], g["sd"]) for g in got["groups"]} == {("mAP50", 2, 0.0), ("mAP50_95", 2, 0.0)}
    (tmp_path / "times.json").write_text("".join(json.dumps({"n": n, "milliseconds": 100.0 if n < 3 else float(n)}) + "\n" for n in range(23)))
    got = run("benchmark", "--times", tmp_path / "times.json", "--output", tmp_path / "b.json", "--warmup", 3)
    assert (got["n"], got["mean"], got["median"], got["p95"], round(got["per_second"], 6)) == (20, 12.5, 12.5, 21.0, 80.0)
    with pytest.raises(FileExistsError):
        run("benchmark", "--times", tmp_path / "times.json", "--output", tmp_path / "b.json", "--warmup", 3)
    with pytest.raises(ValueError):
        run("benchmark", "--times", tmp_path / "times.json", "--output", tmp_path / "c.json")
