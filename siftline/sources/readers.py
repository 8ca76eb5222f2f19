"""Readers: split inventories, manifests, detector outputs, curves, run folders, logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .listing import listing, qualified
from .runs import curves, run_folder, run_keys  # noqa: F401

#: Detector output: a header and a list of images, boxes as positional lists (class, x, y, w, h[, confidence]).
PREDICTION_FILE = "schema int, dataset string, split string, names array<string>, checkpoint_sha256 string, manifest_sha256 string, training_dataset string, method string, seed int, tag string, training_recipe_sha256 string, images array<struct<id:string,`group`:string,truth:array<array<double>>,predictions:array<array<double>>>>"
#: Fixed-confidence audit rows: parallel arrays per image, candidates of missed boxes by index.
AUDIT_ROW = "image string, original_shape_hw array<int>, gt_classes array<int>, gt_xyxy array<array<double>>, pred_classes array<int>, pred_xyxy array<array<double>>, pred_conf array<double>, missed_gt array<int>, false_prediction_indices array<int>, missed_candidates map<string,struct<category:string,max_sameclass_iou:double,max_otherclass_iou:double>>"
MANIFEST = "id string, dataset string, split string, image string, label string, boxes array<array<double>>, `group` string, excluded boolean, label_issues array<struct<line:int,reason:string,label:string>>, prepared_image string, prepared_label string, source_id string, source_split string, image_sha256 string, decoded_sha256 string"
#: Content scan; unsigned 64-bit hashes come as decimals and are folded to signed longs.
SCAN = "source_id string, dataset string, split string, image string, sha256 string, size long, mtime_ns long, native_size array<int>, display_size array<int>, decoded_sha256 string, decode_error string, dhash decimal(20,0), phash decimal(20,0), gray_std double, gray32 string"
EXPOSURE = "epoch int, images int, post_augmentation_empty_images int, alpha double"
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "webp", "tif", "tiff")


def _box(v: Column, conf: bool) -> Column:
    parts = [v[0].cast("int").alias("cls"), *(v[i].alias(c) for i, c in enumerate("xywh", 1))]
    return F.struct(*parts, *([v[5].alias("conf")] if conf else []))


def predictions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(header, images): images with truth and predictions as arrays of structs."""
    raw = spark.read.schema(PREDICTION_FILE).option("multiLine", "true").json(path).withColumn("file", F.col("_metadata.file_path"))
    image = raw.select("file", "dataset", "split", F.explode("images").alias("i"))
    images = image.select("file", "dataset", "split", "i.id", F.col("i.group").alias("group"), F.transform("i.truth", lambda v: _box(v, False)).alias("truth"), F.transform("i.predictions", lambda v: _box(v, True)).alias("predictions"))
    return raw.drop("images"), images


def exploded(images: DataFrame, col: str, index: str) -> DataFrame:
    """A row per box of an array column."""
    return images.select(F.col("id").alias("image_id"), F.posexplode(col).alias(index, "b")).select("image_id", index, "b.*")


def audit_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT_ROW).json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest with boxes as structs."""
    return spark.read.schema(MANIFEST).json(path).withColumn("boxes", F.transform("boxes", lambda v: _box(v, False)))


def content_scan(spark: SparkSession, path: str) -> DataFrame:
    wide = spark.read.schema(SCAN).json(path)
    return wide.withColumns({c: F.conv(F.conv(F.col(c).cast("string"), 10, 16), 16, -10).cast("long") for c in ("dhash", "phash")})


def file_inventory(spark: SparkSession, path: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES) -> DataFrame:
    """path, length, modificationTime, suffix, stem, split of files below a folder, empty ones too; contents are not read."""
    at = listing(spark, path).select("path", "length", "modificationTime", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("suffix"), F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("stem"), split_of(F.col("path")).alias("split"))
    return at.filter(F.col("suffix").isin(*suffixes))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def split_of(path: Column) -> Column:
    """The split that a path names, in either layout (images/<split>/ or <split>/images/); valid and validation are val."""
    s = F.regexp_extract(path, r"/(?:images|labels)/(train|val|valid|validation|test)/[^/]*$|/(train|val|valid|validation|test)/(?:images|labels)/[^/]*$", 0)
    name = F.regexp_extract(s, r"/(train|validation|valid|val|test)/", 1)
    return F.when(name == "", None).when(name.isin("valid", "validation"), "val").otherwise(name)


def label_path(path: Column) -> Column:
    """Where an image's label lies: the last ``images`` folder becomes ``labels``, the suffix txt."""
    return F.regexp_replace(F.regexp_replace(path, r"^(.*)/images/", "$1/labels/"), r"\.[^./]+$", ".txt")


def split_list(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a split list file, in order; CRLF is fine, blank lines drop, entries that leave ./images/ fail."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "entry")).select("line", F.trim("entry").alias("entry")).filter("entry != ''")
    bad = ~F.col("entry").startswith("./images/") | F.col("entry").contains("..")
    return lines.withColumn("entry", F.when(bad, F.raise_error(F.concat(F.lit("not below ./images/: "), F.col("entry")))).otherwise(F.col("entry")))


def yaml_keys(spark: SparkSession, path: str) -> DataFrame:
    """key, value of the flat ``key: value`` lines of a YAML file, comments and quotes taken off."""
    at = spark.read.text(path).select(F.regexp_extract("value", r"^\s*([A-Za-z_][\w-]*):\s*(.*)$", 1).alias("key"), F.regexp_replace(F.regexp_extract("value", r"^\s*([A-Za-z_][\w-]*):\s*(.*)$", 2), r"\s+#.*$", "").alias("value"))
    return at.filter("key != ''").withColumn("value", F.regexp_replace(F.trim("value"), r"^['\"]|['\"]$", ""))


def exposure_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return (spark.readStream if stream else spark.read).schema(EXPOSURE).json(path)


def json_leaves(documents: DataFrame, document: str, *keep: str) -> DataFrame:
    """``keep`` columns, path, value of every number in JSON texts, at any depth: names joined by dots, places in lists as [0]; text, booleans and nulls drop, and texts that are no JSON.

    Each round takes one level apart, for all documents at once, until none has
    another: as many rounds as the deepest document has levels.
    """
    spark = documents.sparkSession
    level = documents.select(*keep, F.lit("").alias("path"), F.try_parse_json(document).alias("_v")).filter("_v is not null")
    done = []
    while True:
        level = cut(level.withColumn("_k", F.schema_of_variant("_v")))
        nested = F.col("_k").startswith("OBJECT") | F.col("_k").startswith("ARRAY")
        number = (F.col("_k") == "BIGINT") | (F.col("_k") == "DOUBLE") | (F.col("_k") == "FLOAT") | F.col("_k").startswith("DECIMAL")
        done.append(level.filter(number).select(*keep, "path", F.variant_get("_v", "$", "double").alias("value")))
        if level.filter(nested).isEmpty():
            break
        inner = level.filter(nested).lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()).select(F.col("pos").alias("_pos"), F.col("key").alias("_key"), F.col("value").alias("_inner")))
        name = F.when(F.col("_key").isNull(), F.concat("path", F.lit("["), F.col("_pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.when(F.col("path") == "", "").otherwise(F.concat("path", F.lit("."))), "_key"))
        level = inner.select(*keep, name.alias("path"), F.col("_inner").alias("_v"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def resolve_splits(spark: SparkSession, root: str, entries: Mapping[str, str | Sequence[str] | None]) -> DataFrame:
    """split, path of the images that entries (split: a folder, a list file ending in .txt, an image, or several of these) name, as a data.yaml does.

    Folders are searched with all below them; a list's relative lines start at
    its own folder; other suffixes than images' are left out. A relative path
    that leaves the root by .. is an error. An image named twice by a split is
    one row. None, or a folder without images, gives no rows.
    """
    top, parts = qualified(spark, root).rstrip("/"), []
    image = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*IMAGE_SUFFIXES)

    def below(path: str) -> str:
        if ".." in path.split("/"):
            raise ValueError(f"{path} leaves the root")
        return qualified(spark, path) if path.startswith("/") or "://" in path or path.startswith("file:") else f"{top}/{path.removeprefix('./')}".rstrip("/")

    for split, value in entries.items():
        for one in [value] if isinstance(value, str) else value or []:
            full = below(one)
            if full.endswith(".txt"):
                folder = full.rpartition("/")[0]
                entry = F.trim("entry")
                lines = spark.read.text(full).select(F.col("value").alias("entry")).filter(F.trim("entry") != "")
                out = F.concat(F.lit("/"), entry, F.lit("/")).contains("/../")
                relative = ~(entry.startswith("/") | entry.contains(":/"))
                path = F.when(out, F.raise_error(F.concat(F.lit("leaves the root: "), entry))).when(relative, F.concat(F.lit(folder + "/"), F.regexp_replace(entry, r"^\./", ""))).when(entry.startswith("/"), F.concat(F.lit(top.partition(":")[0] + ":"), entry)).otherwise(entry)
                found = lines.select(path.alias("path")).filter(image)
            elif full.rpartition(".")[2].lower() in IMAGE_SUFFIXES:
                found = spark.createDataFrame([(full,)], "path string")
            else:
                found = listing(spark, full).select("path").filter(image)
            parts.append(found.select(F.lit(split).alias("split"), "path"))
    out = spark.createDataFrame([], "split string, path string")
    for p in parts:
        out = out.unionByName(p)
    return out.distinct()
