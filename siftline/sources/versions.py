"""Inventories of source datasets in both layouts, and dataset versions that are committed whole and verified when read.

A version is a folder with a manifest (JSON lines), a label file for each image,
a list of images for each split, data.yaml, a table of all these files with their
digests, and metadata.json, which has the digest of that table. All of it is made
in a staging folder and appears by one rename, which fails where the name is
taken: a write that is killed leaves no version, and two writers don't mix.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import inventory_digest
from ..functions.lineage import cut
from ..operators import integrity
from ..operators.sampling import oversample_negatives
from .labels import NAMES, apply_policy, parse_labels
from .listing import _opened, listing, qualified
from .readers import IMAGE_SUFFIXES, split_list

SPLITS = ("train", "val", "test")
# Where the second layout has its lists and labels.
LISTS = "annotations/YOLO_CV"
_BOX = "array<struct<cls:int,x:double,y:double,w:double,h:double>>"
_ROW = f"id string, dataset string, split string, image string, label string, boxes {_BOX}, `group` string, image_sha256 string, prepared_label string, copy int"


def _name(path: Column | str) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def _stem(path: Column | str) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def _files(spark: SparkSession, folder: str, suffixes: tuple[str, ...]) -> DataFrame:
    return listing(spark, folder).filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*suffixes)).select("path", _stem("path").alias("stem"))


def inventory(spark: SparkSession, dataset: str, entry: Mapping, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """id, dataset, split, image, label, stem: every image of a dataset with the place of its label; a row is told by split and name, never by name alone.

    Layout dfire: images/<split>/ and labels/<split>/, whose stems must be the
    same. Layout fasdd: annotations/YOLO_CV/<split>.txt names files of images/,
    labels are in annotations/YOLO_CV/labels/. Empty splits, images that repeat
    within or across splits, missing images and missing labels are errors.
    """
    root, layout = qualified(spark, entry["root"]).rstrip("/"), entry["layout"]
    if layout == "dfire":
        folder = lambda kind: F.regexp_extract("path", rf"/{kind}/([^/]+)/[^/]+$", 1).alias("split")
        at = _files(spark, f"{root}/images", IMAGE_SUFFIXES).select(folder("images"), "stem", F.col("path").alias("image"))
        texts = _files(spark, f"{root}/labels", ("txt",)).select(folder("labels"), "stem", F.col("path").alias("label"))
        at, texts = (x.filter(F.col("split").isin(*splits)) for x in (at, texts))
        faults = integrity.inventory_faults(at.select("split", "stem").distinct(), texts, ["split", "stem"])
        integrity.require_none(faults, f"{dataset}: images and labels differ")
        at = at.join(texts, ["split", "stem"])
    elif layout == "fasdd":
        at = None
        for s in splits:
            one = split_list(spark, f"{root}/{LISTS}/{s}.txt").select(F.lit(s).alias("split"), F.concat(F.lit(f"{root}/images/"), _name("entry")).alias("image"))
            at = one if at is None else at.unionByName(one)
        at = at.withColumn("stem", _stem("image"))
        held = _files(spark, f"{root}/images", IMAGE_SUFFIXES).select(F.col("path").alias("image"))
        integrity.require_none(at.join(held, "image", "left_anti"), f"{dataset}: missing images")
        texts = _files(spark, f"{root}/{LISTS}/labels", ("txt",)).select("stem", F.col("path").alias("label"))
        integrity.require_none(at.join(texts, "stem", "left_anti"), f"{dataset}: missing labels")
        at = at.join(texts, "stem")
    else:
        raise ValueError(f"unknown layout {layout!r}")
    at = cut(at.select(F.concat_ws("/", F.lit(dataset), "split", _name("image")).alias("id"), F.lit(dataset).alias("dataset"), "split", "image", "label", "stem"))
    integrity.require_none(at.groupBy("image").count().filter("count > 1"), f"{dataset}: repeated images")
    there = {r["split"] for r in at.select("split").distinct().collect()}
    if missing := [s for s in splits if s not in there]:
        raise ValueError(f"{dataset}: empty splits {missing}")
    return at


def label_lines(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """label, line (from 1 on), text of the lines of label files (column label); an empty file has none."""
    folders = [r["f"] for r in paths.select(F.regexp_extract("label", r"^(.*)/[^/]+$", 1).alias("f")).distinct().collect()]
    if not folders:
        return paths.select("label", F.lit(0).alias("line"), F.lit("").alias("text")).limit(0)
    at = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folders).select(F.col("path").alias("label"), F.decode("content", "UTF-8").alias("t"))
    some = at.join(paths.select("label").distinct(), "label", "left_semi")
    return some.select("label", F.posexplode(F.split("t", r"\r\n|\n|\r")).alias("k", "text")).select("label", (F.col("k") + 1).alias("line"), "text")


def with_boxes(images: DataFrame, lines: DataFrame, names: list[str], policy: str) -> tuple[DataFrame, DataFrame]:
    """images with boxes (in the order of their lines), label_issues and excluded, and the parsed lines (label, line, cls, ..., reason). Each image has its own label file's."""
    parsed = cut(parse_labels(lines.select("label", "line", F.col("text").alias("line_text")), names, id_="label", also=("line",), text="line_text"))
    box = F.transform(F.sort_array(F.collect_list(F.when(F.col("reason").isNull(), F.struct("line", "cls", "x", "y", "w", "h")))), lambda b: F.struct(b["cls"].alias("cls"), b["x"].alias("x"), b["y"].alias("y"), b["w"].alias("w"), b["h"].alias("h")))
    issue = F.sort_array(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("line", "reason"))))
    by = parsed.groupBy("label").agg(box.alias("boxes"), issue.alias("label_issues"))
    at = apply_policy(images, parsed, policy, id_="label").join(by, "label", "left")
    return at.withColumn("boxes", F.coalesce("boxes", F.array().cast(_BOX))), parsed


def labelled(spark: SparkSession, dataset: str, entry: Mapping, splits: tuple[str, ...] = SPLITS) -> tuple[DataFrame, DataFrame]:
    """The inventory with boxes, label_issues and excluded, and the parsed lines."""
    images = inventory(spark, dataset, entry, splits)
    return with_boxes(images, label_lines(spark, images), entry["source_names"], entry.get("invalid_box_policy", "error"))


def label_text(boxes: Column) -> Column:
    line = lambda b: F.concat_ws(" ", *(b[k].cast("string") for k in ("cls", "x", "y", "w", "h")))
    return F.array_join(F.transform(boxes, lambda b: F.concat(line(b), F.lit("\n"))), "")


def _write_texts(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path, _ = _opened(folder)
        for b in batches:
            for name, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                full = f"{path}/{name}"
                fs.create_dir(full.rpartition("/")[0], recursive=True)
                with fs.open_output_stream(full, compression=None) as out:  # same name, same bytes: an attempt may repeat
                    out.write(text.encode())
            yield pa.record_batch([pa.array([b.num_rows], pa.int64())], ["n"])

    return run


def _fs(spark: SparkSession, path: str) -> tuple[object, object]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _put(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, False)
    out.write(bytearray(text.encode()))
    out.close()


def _get(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _rename(spark: SparkSession, old: str, new: str) -> None:
    """One step, which fails where the name is taken, unlike the rename of a FileSystem."""
    jvm, (fs, a), (_, b) = spark._jvm, _fs(spark, old), _fs(spark, new)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(a, b, options)


def _content(spark: SparkSession, root: str, folders: tuple[str, ...]) -> DataFrame:
    """path (below the root), sha256 of the files of some folders of a version; of an empty file too."""
    at = None
    for f in folders:
        full = f"{root}/{f}"
        read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(full).select("path", F.sha2("content", 256).alias("sha256"))
        both = listing(spark, full).select("path").join(read, "path", "left").select(F.expr(f"substring(path, {len(root) + 2})").alias("path"), F.coalesce("sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("sha256"))
        at = both if at is None else at.unionByName(both)
    return at


def _digest(files: DataFrame) -> str:
    row = files.withColumn("_r", F.sha2(F.concat_ws(":", "path", "sha256"), 256))
    got = inventory_digest(row.withColumn("_all", F.lit(1)), ["_all"], "_r").first()
    return got["digest"] if got else ""


def _data_yaml(splits: tuple[str, ...], names: tuple[str, ...]) -> str:
    return "".join([*(f"{s}: lists/split={s}\n" for s in splits), "names:\n", *(f"  {k}: {n}\n" for k, n in enumerate(names))])


def commit(spark: SparkSession, rows: DataFrame, out: str, metadata: Mapping, neg_repeat: int = 1, splits: tuple[str, ...] = SPLITS, names: tuple[str, ...] = NAMES) -> dict:
    """Write a version of labelled images (id, dataset, split, image, label, stem, boxes, excluded) to the new folder ``out``; its metadata.

    Excluded images stand in a table of their own. Images without boxes stand
    ``neg_repeat`` times in train, with a number; others once.
    """
    out = qualified(spark, out).rstrip("/")
    fs, final = _fs(spark, out)
    if fs.exists(final):
        raise FileExistsError(f"{out} exists; make another version")
    if neg_repeat < 1:
        raise ValueError("neg_repeat is 1 at least")
    parent, _, name = out.rpartition("/")
    staging = f"{parent}/_staging-{name}-{uuid.uuid4().hex[:12]}"
    stage_fs, stage = _fs(spark, staging)
    try:
        rows = cut(rows)
        if empty := set(splits) - {r["split"] for r in rows.filter("not excluded").select("split").distinct().collect()}:
            raise ValueError(f"no images are left in {sorted(empty)}")
        kept = rows.filter("not excluded").withColumn("prepared_label", F.concat(F.lit("labels/"), "split", F.lit("/"), "stem", F.lit(".txt")))
        rows.filter("excluded").select("id", "split", "image", "label_issues").write.json(f"{staging}/excluded")
        made = kept.select("prepared_label", label_text(F.col("boxes")).alias("text")).distinct()
        made.mapInArrow(_write_texts(staging), "n long").agg(F.sum("n")).collect()
        many = oversample_negatives(kept.withColumn("negative", F.size("boxes") == 0), neg_repeat).withColumn("copy", F.col("copy").cast("int"))
        for c in ("group", "image_sha256"):
            many = many if c in many.columns else many.withColumn(c, F.lit(None).cast("string"))
        many = cut(many.select("id", "dataset", "split", "image", "label", "boxes", "group", "image_sha256", "prepared_label", "copy"))
        order = ["split", "id", "copy"]
        ranged = many.repartitionByRange(*order).sortWithinPartitions(*order)
        ranged.write.json(f"{staging}/manifest")
        ranged.select("split", F.col("image").alias("value")).write.partitionBy("split").text(f"{staging}/lists")
        _put(spark, f"{staging}/data.yaml", _data_yaml(splits, names))
        files = cut(_content(spark, staging, ("manifest", "labels", "lists", "excluded")))
        files.write.parquet(f"{staging}/files")
        count = lambda df: {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}
        document = {
            **metadata, "names": list(names), "splits": list(splits), "neg_repeat": neg_repeat, "counts": count(many), "excluded": count(rows.filter("excluded")), "files_sha256": _digest(files),
            "data_yaml_sha256": hashlib.sha256(_data_yaml(splits, names).encode()).hexdigest(), "image_content_hashed": "image_sha256" in rows.columns, "portable_content_sha256": content_digest(many),
        }
        _put(spark, f"{staging}/metadata.json", json.dumps(document, sort_keys=True, indent=2, ensure_ascii=False))
        _rename(spark, staging, out)
    except BaseException:
        stage_fs.delete(stage, True)
        raise
    return document


def content_digest(rows: DataFrame) -> str:
    """Digest of the distinct (split, file name, boxes): the same wherever a version lies and however often it repeats a row."""
    one = rows.select("split", _name("image").alias("n"), F.to_json("boxes").alias("b")).distinct()
    got = inventory_digest(one.select(F.lit(1).alias("_all"), F.sha2(F.to_json(F.struct("split", "n", "b")), 256).alias("_r")), ["_all"], "_r").first()
    return got["digest"] if got else ""


def load(spark: SparkSession, out: str, verify: bool = True, rehash: bool = False) -> tuple[dict, DataFrame]:
    """Metadata and manifest of a version. ``verify`` raises at the first of: table of files, manifest, missing images, labels (bytes, then boxes as the manifest has them), split lists, data.yaml. ``rehash`` reads every image, too, and compares its digest with the manifest's."""
    out = qualified(spark, out).rstrip("/")
    meta = json.loads(_get(spark, f"{out}/metadata.json"))
    rows = spark.read.schema(_ROW).json(f"{out}/manifest")
    if not verify:
        return meta, rows
    files = spark.read.parquet(f"{out}/files")
    if _digest(files) != meta["files_sha256"]:
        raise ValueError("the table of files was modified")

    def same(folder: str, what: str) -> None:
        now = _content(spark, out, (folder,))
        integrity.require_none(integrity.changed(files.filter(F.col("path").startswith(folder + "/")), now, "path", "sha256"), what)

    same("manifest", "the manifest was modified")
    folders = [r["f"] for r in rows.select(F.regexp_extract("image", r"^(.*)/[^/]+$", 1).alias("f")).distinct().collect()]
    held = None
    for f in folders:
        there = listing(spark, f).select(F.col("path").alias("image"))
        held = there if held is None else held.unionByName(there)
    integrity.require_none(rows.join(held.distinct(), "image", "left_anti").select("id"), "images are missing")
    full = rows.select("id", F.concat(F.lit(out + "/"), "prepared_label").alias("label"), "boxes").distinct()
    now, _ = with_boxes(full.select("id", "label", F.col("boxes").alias("want")), label_lines(spark, full), meta["names"], "exclude_invalid_images")
    integrity.require_none(now.filter(F.col("excluded") | ~F.col("boxes").eqNullSafe(F.col("want"))).select("id"), "labels were changed")
    same("labels", "label files were changed")
    same("lists", "split lists were changed")
    if hashlib.sha256(_get(spark, f"{out}/data.yaml").encode()).hexdigest() != meta["data_yaml_sha256"]:
        raise ValueError("data.yaml was changed")
    if rehash:
        integrity.require_none(rehashed(spark, rows), "image bytes were changed")
    return meta, rows


def subset(spark: SparkSession, source: str, keep: DataFrame, out: str, metadata: Mapping) -> dict:
    """Commit the images of a version, verified, whose id is in ``keep``, as a version of its own that names its source; a split that keeps none is left out."""
    meta, rows = load(spark, source)
    some = cut(rows.filter("copy = 1").drop("copy").join(keep.select("id").distinct(), "id", "left_semi"))
    there = tuple(s for s in meta["splits"] if not some.filter(F.col("split") == s).isEmpty())
    at = some.withColumns({"stem": _stem("label"), "excluded": F.lit(False), "label_issues": F.array().cast("array<struct<line:int,reason:string>>")})
    return commit(spark, at, out, {**metadata, "subset_of": meta["files_sha256"]}, splits=there, names=tuple(meta["names"]))


def backfill(spark: SparkSession, root: str, write: bool = False, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """split, label: the label files that images of a dataset (images/<split>/, labels/<split>/) lack. With ``write`` they are made, empty, by the tasks; else nothing is written."""
    top = qualified(spark, root).rstrip("/")
    at = lambda kind, suffixes: _files(spark, f"{top}/{kind}", suffixes).select(F.regexp_extract("path", rf"/{kind}/([^/]+)/[^/]+$", 1).alias("split"), "stem").filter(F.col("split").isin(*splits)).distinct()
    missing = cut(at("images", IMAGE_SUFFIXES).join(at("labels", ("txt",)), ["split", "stem"], "left_anti").select("split", F.concat_ws("/", F.lit("labels"), "split", F.concat("stem", F.lit(".txt"))).alias("label")))
    if write:
        missing.select("label", F.lit("").alias("text")).mapInArrow(_write_texts(top), "n long").agg(F.sum("n")).collect()
    return missing


def hashed(spark: SparkSession, images: DataFrame) -> DataFrame:
    """images with image_sha256, the digest of each file's bytes."""
    folders = [r["f"] for r in images.select(F.regexp_extract("image", r"^(.*)/[^/]+$", 1).alias("f")).distinct().collect()]
    now = spark.read.format("binaryFile").load(folders).select(F.col("path").alias("image"), F.sha2("content", 256).alias("image_sha256"))
    return images.drop("image_sha256").join(now, "image", "left").withColumn("image_sha256", F.coalesce("image_sha256", F.lit(hashlib.sha256(b"").hexdigest())))


def rehashed(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """id of images whose bytes have another digest than the manifest's; all of them where it has none."""
    want = rows.select("id", "image", F.col("image_sha256").alias("want")).distinct()
    return hashed(spark, want).filter(~F.coalesce(F.col("want") == F.col("image_sha256"), F.lit(False))).select("id")


def regression(meta: Mapping, rows: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """check, found, expected, ok of a version's manifest: how often backgrounds and other images of train stand in it, repeated rows elsewhere, and distinct (split, name, boxes) that a reference version has otherwise."""
    n = rows.groupBy("split", "id").agg(F.count("*").alias("n"), F.max(F.size("boxes")).alias("boxes"))
    most = lambda c: F.coalesce(F.max(F.when(c, F.col("n"))), F.lit(0))
    train = F.col("split") == "train"
    repeat = meta["neg_repeat"]
    got = n.agg(most(train & (F.col("boxes") == 0)).alias("train_background_times"), most(train & (F.col("boxes") > 0)).alias("train_object_times"), most(~train).alias("other_times"))
    long = got.unpivot([], got.columns, "check", "found").withColumn("expected", F.when(F.col("check") == "train_background_times", repeat).otherwise(1).cast("long"))
    ok = (F.col("found") == F.col("expected")) | (F.col("found") == 0)
    if reference is not None:
        one = lambda df: df.select("split", _name("image").alias("n"), F.to_json("boxes").alias("b")).distinct()
        far = integrity.bag_difference(one(rows), one(reference)).agg(F.count("*").alias("found"))
        long = long.unionByName(far.select(F.lit("content_differences").alias("check"), "found", F.lit(0).cast("long").alias("expected")))
    return long.withColumn("ok", ok)
