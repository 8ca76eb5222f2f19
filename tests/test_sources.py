"""Readers and writers on small files, pixel functions, streams."""

import base64
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.functions import pixels
from siftline.operators import integrity
from siftline.sources import labels, readers, sinks
from siftline.streaming import monitor


def test_label_files_and_inventory(spark, tmp_path):
    for split in ("train", "valid"):
        for kind in ("images", "labels"):
            (tmp_path / kind / split).mkdir(parents=True)
        for name in "ab":
            (tmp_path / "images" / split / f"{name}.JPG").write_bytes(b"x" * 3)
        (tmp_path / "labels" / split / "a.txt").write_text("0 0.5 0.5 0.2 0.3\n\n1 .1 .1 .1 .1 9\n")
    strict = labels.read_label_files(spark, str(tmp_path / "labels"), ["smoke", "fire"])
    assert {(r["cls"], r["reason"]) for r in strict.collect()} == {(1, None), (None, "field_count")}
    assert labels.read_label_files(spark, str(tmp_path / "labels"), ["smoke", "fire"], "lenient").count() == 4
    images = readers.file_inventory(spark, str(tmp_path / "images"))
    assert {(r["split"], r["stem"], r["length"]) for r in images.collect()} == {(s, n, 3) for s in ("train", "val") for n in "ab"}
    faults = integrity.inventory_faults(images, readers.file_inventory(spark, str(tmp_path / "labels"), ("txt",)), ["split", "stem"])
    assert {(r["split"], r["stem"], r["fault"]) for r in faults.collect()} == {("train", "b", "image_without_label"), ("val", "b", "image_without_label")}
    with pytest.raises(ValueError):
        integrity.require_none(faults, "inventory")
    got = images.select(readers.label_path(F.col("path")).alias("p")).collect()
    assert all(r["p"].endswith(".txt") and "/labels/" in r["p"] for r in got)


def test_split_list(spark, tmp_path):
    (tmp_path / "l.txt").write_bytes(b"./images/b.jpg\r\n./images/a.jpg\r\n\r\n")
    assert [r["entry"] for r in readers.split_list(spark, str(tmp_path / "l.txt")).orderBy("line").collect()] == ["./images/b.jpg", "./images/a.jpg"]
    (tmp_path / "bad.txt").write_text("./images/../x.jpg\n")
    with pytest.raises(Exception, match="not below"):
        readers.split_list(spark, str(tmp_path / "bad.txt")).collect()


def test_predictions(spark, tmp_path):
    doc = {"schema": 1, "dataset": "d", "split": "val", "images": [{"id": "i", "group": None, "truth": [[0, 0.5, 0.5, 0.1, 0.1]], "predictions": [[0, 0.5, 0.5, 0.1, 0.1, 0.9], [1, 0.1, 0.1, 0.1, 0.1, 0.2]]}, {"id": "j", "group": "g", "truth": [], "predictions": []}]}
    (tmp_path / "predictions.json").write_text(json.dumps(doc))
    header, images = readers.predictions(spark, str(tmp_path))
    assert header.first()["split"] == "val" and images.count() == 2
    assert [(r["image_id"], r["det_idx"], r["cls"], r["conf"]) for r in readers.exploded(images, "predictions", "det_idx").orderBy("det_idx").collect()] == [("i", 0, 0, 0.9), ("i", 1, 1, 0.2)]


def test_unsigned_hashes(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text(json.dumps({"source_id": "a", "dhash": 2**64 - 1, "phash": 7}) + "\n")
    r = readers.content_scan(spark, str(tmp_path)).first()
    assert (r["dhash"], r["phash"]) == (-1, 7)


def test_curves_and_run_keys(spark, tmp_path):
    run = tmp_path / "paper-v1" / "base" / "seed2"
    run.mkdir(parents=True)
    (run / "results.csv").write_text("epoch, metrics/mAP50(B) ,val/loss\n1,0.5,x\n2, 0.6,1.5\n")
    got = readers.curves(spark, str(tmp_path)).collect()
    assert {(r["epoch"], r["metric"], r["value"]) for r in got} == {(1, "metrics/mAP50(B)", 0.5), (2, "metrics/mAP50(B)", 0.6), (2, "val/loss", 1.5)}
    k = spark.createDataFrame([("/x/base/seed2",), ("/x/base_seed1",), ("/x/base_module-z",)], "r string").select(readers.run_keys(F.col("r")).alias("k")).collect()
    assert [tuple(r["k"]) for r in k] == [("base", 2), ("base", 1), ("base", None)]


def test_yaml_and_flat_json(spark, tmp_path):
    (tmp_path / "data.yaml").write_text("# c\nimgsz: 640 # px\nname: 'x'\nlist:\n  - 1\n")
    assert {r["key"]: r["value"] for r in readers.yaml_keys(spark, str(tmp_path / "data.yaml")).collect()} == {"imgsz": "640", "name": "x", "list": ""}


def _flat(x, at=""):
    if isinstance(x, dict):
        return {p: v for k, y in x.items() for p, v in _flat(y, f"{at}.{k}" if at else k).items()}
    if isinstance(x, list):
        return {p: v for k, y in enumerate(x) for p, v in _flat(y, f"{at}[{k}]").items()}
    return {at: float(x)} if isinstance(x, (int, float)) and not isinstance(x, bool) else {}


def test_json_leaves_at_any_depth(spark):
    docs = [{"a": 1, "b": {"c": 2.5, "d": "x"}, "e": True}, {"a": {"b": {"c": {"d": [1, {"e": [[2], "3", None]}], "f g": -1e30}}}, "n": None}, [1, [2]], 7, {}, {"x.y": {"z": 0.1}}]
    rows = [(k, json.dumps(d)) for k, d in enumerate(docs)] + [(90, None), (91, "{broken"), (92, '"text"')]
    got = {}
    for r in readers.json_leaves(spark.createDataFrame(rows, "id long, doc string"), "doc", "id").collect():
        got.setdefault(r["id"], {})[r["path"]] = r["value"]
    assert got == {k: _flat(d) for k, d in enumerate(docs) if _flat(d)}
    assert readers.json_leaves(spark.createDataFrame([], "id long, doc string"), "doc", "id").count() == 0


def test_splits_in_all_forms(spark, tmp_path):
    for n in ("images/train/a.jpg", "images/train/deep/b.PNG", "images/val/c.jpg", "images/val/note.md", "more/d.jpg", "lists/e.jpg"):
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(b"x")
    (tmp_path / "lists/test.txt").write_bytes(f"./e.jpg\r\n\n{tmp_path}/more/d.jpg\nnote.md\n./e.jpg\n".encode())
    (tmp_path / "lists/bad.txt").write_text("../more/d.jpg\n")
    got = readers.resolve_splits(spark, str(tmp_path), {"train": ["images/train", f"{tmp_path}/more"], "val": "./images/val/", "test": "lists/test.txt", "one": "more/d.jpg", "none": None})
    assert sorted((r["split"], r["path"].removeprefix(f"file:{tmp_path}/")) for r in got.collect()) == [("one", "more/d.jpg"), ("test", "lists/e.jpg"), ("test", "more/d.jpg"), ("train", "images/train/a.jpg"), ("train", "images/train/deep/b.PNG"), ("train", "more/d.jpg"), ("val", "images/val/c.jpg")]
    assert readers.resolve_splits(spark, str(tmp_path), {}).count() == 0
    with pytest.raises(Exception, match="leaves the root"):
        readers.resolve_splits(spark, str(tmp_path), {"x": "lists/bad.txt"}).collect()
    with pytest.raises(ValueError, match="leaves the root"):
        readers.resolve_splits(spark, str(tmp_path), {"x": "../other"})


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", "train", "p2", 0.5), ("a", "train", "p1", 1.0), ("c", "val", "p3", 2.0)], "id string, split string, prepared_image string, v double")
    sinks.write_prepared(df, str(tmp_path / "v1"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        sinks.write_prepared(df, str(tmp_path / "v1"))
    sinks.write_split_lists(df, str(tmp_path / "lists"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "lists/split=train")).collect()] == ["p1", "p2"]
    with pytest.raises(Exception, match="not finite"):
        sinks.write_json(df.withColumn("v", F.lit(float("nan"))), str(tmp_path / "j"))
    assert sinks.markdown(df.orderBy("id")).splitlines()[2] == "| a | train | p1 | 1.0000 |"


def test_pixels(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 255, (3, 32, 32)).astype(float)
    rows = [(i, x[i].ravel().tolist(), (x[i] + (5 if i == 1 else 0)).ravel().tolist()) for i in range(3)]
    df = spark.createDataFrame(rows, "i int, a array<double>, b array<double>")
    got = df.select(pixels.ssim_global("a", "b").alias("s"), pixels.ssim_windowed("a", "b").alias("w"), pixels.phash("a").alias("p"), pixels.phash("b").alias("q"), pixels.dhash_left("a").alias("l"), pixels.dhash_right("a").alias("r")).collect()
    assert got[0]["s"] == pytest.approx(1) and got[0]["w"] == pytest.approx(1) and got[1]["s"] < 1
    assert all(r["p"] == r["q"] or i == 1 for i, r in enumerate(got)) and all(r["l"] & r["r"] == 0 for r in got)
    block = pixels._cosine(32) @ pixels._cosine(32).T
    assert np.allclose(block, np.eye(32))
    assert base64.b64decode(base64.b64encode(bytes(1024))) == bytes(1024)


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:10:00", "u", "a", 1.0), (2, "2024-01-01 00:20:00", "u", "a", 2.0), (3, "2024-01-01 02:00:00", "v", "a", 4.0), (1, "2024-01-01 02:01:00", "u", "a", 1.0)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def run(out, mode, name):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    assert sorted((r["n"], r["total"]) for r in run(monitor.windowed(stream()), "update", "w")) == sorted((r["n"], r["total"]) for r in monitor.windowed(df).collect())
    assert len(run(monitor.first_sightings(stream(), "event_id", "3 hours"), "append", "f")) == 3
    log = spark.createDataFrame([(1, 10, 2, 0.5), (1, 10, 3, 0.5), (2, 0, 0, 0.5)], readers.EXPOSURE)
    assert {r["epoch"]: r["fraction"] for r in monitor.exposure_by_epoch(log).collect()} == {1: 0.25, 2: None}
