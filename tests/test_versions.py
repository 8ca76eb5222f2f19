"""Inventories of both layouts, versions that are committed whole, and each fault that a verified reader finds."""

import json
import shutil

import pytest
from pyspark.sql import functions as F

from siftline.sources import images, listing, readers, versions

ENTRY = {"source_names": ["smoke", "fire"], "invalid_box_policy": "exclude_invalid_images"}


def _first(root, files):
    """Layout dfire: {(split, stem): label text}."""
    for (split, stem), text in files.items():
        for kind, name, data in (("images", f"{stem}.png", f"{split}{stem}".encode()), ("labels", f"{stem}.txt", text.encode())):
            (root / kind / split).mkdir(parents=True, exist_ok=True)
            (root / kind / split / name).write_bytes(data)
    return ENTRY | {"root": str(root), "layout": "dfire"}


def _second(root, lists, texts):
    """Layout fasdd."""
    (root / "images").mkdir(parents=True)
    (root / versions.LISTS / "labels").mkdir(parents=True)
    for split, names in lists.items():
        (root / versions.LISTS / f"{split}.txt").write_bytes("".join(f"./images/{n}\r\n" for n in names).encode())
        for n in names:
            (root / "images" / n).write_bytes(n.encode())
    for stem, text in texts.items():
        (root / versions.LISTS / "labels" / f"{stem}.txt").write_text(text)
    return ENTRY | {"root": str(root), "layout": "fasdd"}


ONE, TWO, BAD = "0 0.5 0.5 0.2 0.2\n", "1 0.5 0.5 0.2 0.2\n0 0.25 0.5 0.125 0.2\n", "0 0.5 0.5 0 0.2\n"
FILES = {("train", "a"): ONE, ("val", "a"): TWO, ("test", "a"): "", ("train", "b c"): "", ("train", "d"): ONE + BAD, ("val", "d"): ONE}


def test_a_name_in_two_splits(spark, tmp_path):
    """Each image has its own split's boxes, and one split's faulty label excludes no image of another."""
    rows, _ = versions.labelled(spark, "x", _first(tmp_path, FILES))
    got = {r["id"]: ([(b["cls"], b["x"]) for b in r["boxes"]], r["excluded"], [(i["line"], i["reason"]) for i in r["label_issues"] or []]) for r in rows.collect()}
    assert got == {
        "x/train/a.png": ([(1, 0.5)], False, []), "x/val/a.png": ([(0, 0.5), (1, 0.25)], False, []), "x/test/a.png": ([], False, []),
        "x/train/b c.png": ([], False, []), "x/train/d.png": ([(1, 0.5)], True, [(2, "zero_area_box")]), "x/val/d.png": ([(1, 0.5)], False, []),
    }


def test_the_layout_with_lists(spark, tmp_path):
    entry = _second(tmp_path / "ok", {"train": ["b.png", "a.jpg"], "val": ["c.png"], "test": ["e.png"]}, {"a": ONE, "b": "", "c": TWO, "e": ""})
    rows, _ = versions.labelled(spark, "y", entry)
    assert {r["id"]: len(r["boxes"]) for r in rows.collect()} == {"y/train/a.jpg": 1, "y/train/b.png": 0, "y/val/c.png": 2, "y/test/e.png": 0}
    for name, lists, texts, match in (
        ("repeated", {"train": ["a.png"], "val": ["a.png"], "test": ["e.png"]}, {"a": "", "e": ""}, "repeated"),
        ("empty", {"train": ["a.png"], "val": [], "test": ["e.png"]}, {"a": "", "e": ""}, "empty splits"),
        ("unlabelled", {"train": ["a.png"], "val": ["b.png"], "test": ["e.png"]}, {"a": "", "e": ""}, "missing labels"),
    ):
        with pytest.raises(ValueError, match=match):
            versions.inventory(spark, "y", _second(tmp_path / name, lists, texts))
    entry = _second(tmp_path / "gone", {"train": ["a.png"], "val": ["b.png"], "test": ["e.png"]}, {"a": "", "b": "", "e": ""})
    (tmp_path / "gone/images/b.png").unlink()
    with pytest.raises(ValueError, match="missing images"):
        versions.inventory(spark, "y", entry)


def test_faults_of_the_first_layout(spark, tmp_path):
    entry = _first(tmp_path / "a", FILES)
    (tmp_path / "a/labels/val/a.txt").unlink()
    with pytest.raises(ValueError, match="differ"):
        versions.inventory(spark, "x", entry)
    with pytest.raises(ValueError, match="empty splits"):
        versions.inventory(spark, "x", _first(tmp_path / "b", {("train", "a"): ONE, ("val", "a"): ONE}))
    with pytest.raises(ValueError, match="unknown layout"):
        versions.inventory(spark, "x", entry | {"layout": "z"})
    with pytest.raises(ValueError, match="faulty labels"):
        versions.labelled(spark, "x", _first(tmp_path / "c", FILES) | {"invalid_box_policy": "error"})


@pytest.fixture
def version(spark, tmp_path):
    rows, _ = versions.labelled(spark, "x", _first(tmp_path / "source", FILES))
    out = str(tmp_path / "prepared/x")
    return out, versions.commit(spark, versions.hashed(spark, rows), out, {"dataset": "x"}, neg_repeat=3)


def test_a_version(spark, tmp_path, version):
    out, made = version
    meta, rows = versions.load(spark, out, rehash=True)
    assert meta == made and made["counts"] == {"train": 4, "val": 2, "test": 1} and made["excluded"] == {"train": 1}
    assert sorted((r["id"], r["copy"], len(r["boxes"])) for r in rows.collect()) == [("x/test/a.png", 1, 0), ("x/train/a.png", 1, 1), *(("x/train/b c.png", k, 0) for k in (1, 2, 3)), ("x/val/a.png", 1, 2), ("x/val/d.png", 1, 1)]
    lists = {s: [r["value"].rpartition("/")[2] for r in spark.read.text(f"{out}/lists/split={s}").collect()] for s in ("train", "val", "test")}
    assert lists == {"train": ["a.png", *["b c.png"] * 3], "val": ["a.png", "d.png"], "test": ["a.png"]}
    assert (tmp_path / "prepared/x/labels/val/a.txt").read_text() == "0 0.5 0.5 0.2 0.2\n1 0.25 0.5 0.125 0.2\n" and (tmp_path / "prepared/x/labels/test/a.txt").read_text() == ""
    with pytest.raises(FileExistsError):
        versions.commit(spark, rows, out, {})
    assert all(r["ok"] for r in versions.regression(meta, rows, rows).collect())
    bad = versions.regression(meta | {"neg_repeat": 1}, rows, rows.filter("split != 'val'")).collect()
    assert {r["check"] for r in bad if not r["ok"]} == {"train_background_times", "content_differences"}
    rows2, _ = versions.labelled(spark, "x", _first(tmp_path / "elsewhere", FILES))
    other = versions.commit(spark, rows2, str(tmp_path / "prepared/y"), {"dataset": "x"})
    assert other["portable_content_sha256"] == made["portable_content_sha256"] and not other["image_content_hashed"]


def test_a_subset(spark, tmp_path, version):
    out, made = version
    keep = spark.createDataFrame([("x/train/b c.png",), ("x/val/a.png",), ("none",)], "id string")
    got = versions.subset(spark, out, keep, str(tmp_path / "prepared/part"), {"dataset": "x", "subset": "clean"})
    meta, rows = versions.load(spark, str(tmp_path / "prepared/part"), rehash=True)
    assert got == meta and meta["subset_of"] == made["files_sha256"] and meta["counts"] == {"train": 1, "val": 1}
    assert sorted((r["id"], len(r["boxes"])) for r in rows.collect()) == [("x/train/b c.png", 0), ("x/val/a.png", 2)]


def test_backfill(spark, tmp_path):
    entry = _first(tmp_path, FILES)
    for k in ("val/a", "train/b c"):
        (tmp_path / f"labels/{k}.txt").unlink()
    want = [("train", "labels/train/b c.txt"), ("val", "labels/val/a.txt")]
    assert sorted(map(tuple, versions.backfill(spark, str(tmp_path)).collect())) == want and not (tmp_path / want[0][1]).exists()
    assert sorted(map(tuple, versions.backfill(spark, str(tmp_path), write=True).collect())) == want
    assert all((tmp_path / p).read_bytes() == b"" for _, p in want) and versions.backfill(spark, str(tmp_path)).count() == 0
    assert versions.inventory(spark, "x", entry).count() == len(FILES)


def _edit(folder, change):
    """Change the first visible file with content below a folder, and what guards its bytes."""
    f = next(p for p in sorted(folder.rglob("*")) if p.is_file() and p.name[0] not in "._" and p.stat().st_size)
    f.write_bytes(change(f.read_bytes()))
    f.with_name(f".{f.name}.crc").unlink(missing_ok=True)


def test_each_fault_at_its_own_step(spark, tmp_path, version):
    out, _ = version
    source = tmp_path / "source"
    for k, (what, harm) in enumerate({
        "table of files": lambda v: _files_without_one(spark, v), "manifest": lambda v: _edit(v / "manifest", lambda b: b.replace(b"0.25", b"0.75")), "labels were changed": lambda v: (v / "labels/val/a.txt").write_text(ONE),
        "label files": lambda v: (v / "labels/train/a.txt").write_text("1 0.50 0.5 0.2 0.2\n"), "split lists": lambda v: _edit(v / "lists/split=val", lambda b: b"\n".join(b.splitlines()[::-1]) + b"\n"),
        "data.yaml": lambda v: _edit_text(v / "data.yaml", "fire", "fyre"),
    }.items()):
        v = tmp_path / f"copy{k}"
        shutil.copytree(out, v)
        versions.load(spark, str(v))
        harm(v)
        with pytest.raises(ValueError, match=what):
            versions.load(spark, str(v))
    (source / "images/val/a.png").write_bytes(b"other")
    versions.load(spark, out)
    with pytest.raises(ValueError, match="image bytes"):
        versions.load(spark, out, rehash=True)
    (source / "images/val/a.png").unlink()
    with pytest.raises(ValueError, match="images are missing"):
        versions.load(spark, out)
    assert versions.load(spark, out, verify=False)[1].count() == 7


def _files_without_one(spark, v):
    some = spark.read.parquet(str(v / "files")).filter("path not like 'labels/val/d%'")
    some.write.parquet(str(v / "files2"))
    shutil.rmtree(v / "files")
    shutil.move(v / "files2", v / "files")


def _edit_text(f, a, b):
    f.write_text(f.read_text().replace(a, b))
    f.with_name(f".{f.name}.crc").unlink(missing_ok=True)


def test_a_killed_write_leaves_nothing(spark, tmp_path, monkeypatch):
    rows, _ = versions.labelled(spark, "x", _first(tmp_path / "source", FILES))
    out = tmp_path / "prepared/x"
    monkeypatch.setattr(versions, "_rename", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        versions.commit(spark, rows, str(out), {})
    assert not out.exists() and not [p for p in (tmp_path / "prepared").iterdir() if not p.name.endswith(".crc")]
    monkeypatch.undo()
    versions.commit(spark, rows, str(out), {})
    other = tmp_path / "prepared/_staging-x-other"
    other.mkdir()
    with pytest.raises(Exception, match="exist"):
        versions._rename(spark, str(other), str(out))
    with pytest.raises(ValueError, match="no images are left"):
        versions.commit(spark, rows.withColumn("excluded", F.col("split") == "test"), str(tmp_path / "prepared/z"), {})


def test_listing_in_tasks(spark, tmp_path):
    names = ["a.txt", "b c.txt", "d%20e.txt", "f[1].txt", "g/h/ü.txt", "g/empty.txt", "+x.txt"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(b"" if "empty" in n else n.encode())
    (tmp_path / "_hidden").write_bytes(b"x")
    (tmp_path / "g/.crc").write_bytes(b"x")
    got = {r["path"].removeprefix(f"file:{tmp_path}/"): r["length"] for r in listing.listing(spark, str(tmp_path)).collect()}
    assert got == {n: 0 if "empty" in n else len(n.encode()) for n in names}
    read = {r["path"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).select("path").collect()}
    assert {f"file:{tmp_path}/{n}" for n in names if "empty" not in n} == read
    assert readers.file_inventory(spark, str(tmp_path), ("txt",)).filter("length = 0").count() == 1


def test_per_split_opens_only_what_it_takes(spark, tmp_path):
    for split in ("train", "val"):
        (tmp_path / "images" / split).mkdir(parents=True)
        for k in range(6):
            (tmp_path / "images" / split / f"{k}[x].png").write_bytes(b"not an image" if k else b"")
    got = images.content_scan(spark, str(tmp_path), per_split=2).collect()
    assert sorted((r["path"].rpartition("/images/")[2], r["decode_error"] is None) for r in got) == [(f"{s}/{k}[x].png", False) for s in ("train", "val") for k in (0, 1)]


def test_damaged_headers_are_rows(spark, tmp_path):
    for name, data in (("a.bmp", b"BM" + bytes(10)), ("b.png", b"\x89PNG\r\n\x1a\n" + bytes(4) + b"IHDR" + bytes(3)), ("c.png", b"\x89PNG\r\n\x1a\n")):
        (tmp_path / name).write_bytes(data)
    assert all(r["decode_error"] for r in images.content_scan(spark, str(tmp_path)).collect())
    assert json.dumps([r["width"] for r in images.header_scan(spark, str(tmp_path)).collect()]) is not None
