"""Run folders: curves by each file's own header, settings, metadata, costs, and the table of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.reports import longest_match, scaled_cost

BASE_SIZE = 640


def run_folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]+$", 1)


def _whole(spark: SparkSession, path: str, name: str) -> DataFrame:
    """run, value: the whole text of every file of a name below a folder, by its folder."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(path, wholetext=True)
    return text.select(run_folder(F.col("_metadata.file_path")).alias("run"), "value")


def cells(run: Column, text: Column, df: DataFrame) -> DataFrame:
    """run, line, name, value of CSV texts, each by its own header; names and values are trimmed and lose their quotes."""
    clean = lambda c: F.regexp_replace(F.trim(c), r'^"|"$', "")
    lines = df.select(run.alias("run"), F.split(text, r"\r?\n").alias("_l"))
    head = F.transform(F.split(F.get("_l", F.lit(0)), ","), clean)
    each = lines.select("run", head.alias("_h"), F.posexplode("_l").alias("line", "_t")).filter("line > 0 and trim(_t) != ''")
    pairs = F.arrays_zip(F.col("_h").alias("name"), F.transform(F.split("_t", ","), clean).alias("value"))
    return each.select("run", "line", F.explode(pairs).alias("c")).select("run", "line", "c.name", "c.value").filter("name is not null")


def curves(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """run, epoch, metric, value from every results.csv below a folder: columns by each file's own header, whose name begins with ``prefix``; cells that are no number drop, and lines without an epoch."""
    return curves_of(cells(F.col("run"), F.col("value"), _whole(spark, path, "results.csv")), prefix)


def curves_of(at: DataFrame, prefix: str = "") -> DataFrame:
    value = F.col("value").try_cast("double")
    epoch = F.max(F.when(F.col("name") == "epoch", F.floor(value).cast("int"))).over(Window.partitionBy("run", "line"))
    long_ = at.select("run", epoch.alias("epoch"), F.col("name").alias("metric"), value.alias("value"))
    return long_.filter(F.col("epoch").isNotNull() & F.col("value").isNotNull() & (F.col("metric") != "epoch") & F.col("metric").startswith(prefix))


def bundled_curves(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """As curves, from JSON documents that hold CSV texts by file name."""
    doc = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("file", "text"))
    return curves_of(cells(run_folder(F.col("file")), F.col("text"), doc.filter(F.col("file").endswith("results.csv"))), prefix)


def best_rows(at: DataFrame, metric: str, time: str = "time") -> DataFrame:
    """run, best_epoch, best, last_epoch, last, epochs, seconds_per_epoch of long curves: the first of equal bests; the last row's time by the number of rows with the metric."""
    rows = at.filter(F.col("metric") == metric).select("run", "epoch", "value")
    spent = at.filter(F.col("metric") == time).groupBy("run").agg(F.max_by("value", "epoch").alias("_t"))
    top = F.max(F.struct("value", (-F.col("epoch")).alias("e"))).alias("b")
    got = rows.groupBy("run").agg(top, F.max(F.struct("epoch", "value")).alias("l"), F.count("*").alias("epochs")).join(spent, "run", "left")
    return got.select("run", (-F.col("b.e")).alias("best_epoch"), F.col("b.value").alias("best"), F.col("l.epoch").alias("last_epoch"), F.col("l.value").alias("last"), "epochs", F.try_divide("_t", "epochs").alias("seconds_per_epoch"))


def settings(spark: SparkSession, path: str) -> DataFrame:
    """run, imgsz, batch, seed, model, optimizer, amp of every args.yaml below a folder; null what a file doesn't say."""
    key = lambda k: F.nullif(F.regexp_replace(F.regexp_extract("value", rf"(?m)^\s*{k}:[ \t]*([^\r\n#]*)", 1), r"^\s*['\"]?|['\"]?\s*$", ""), F.lit(""))
    number = lambda k: key(k).try_cast("int").alias(k)
    return _whole(spark, path, "args.yaml").select("run", number("imgsz"), number("batch"), number("seed"), *(key(k).alias(k) for k in ("model", "optimizer", "amp")))


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """run, protocol, dataset, method, meta_seed, finished of every run.json below a folder; a file that is no JSON has nulls."""
    doc = F.from_json("value", "protocol string, protocol_version string, dataset string, method string, seed int, training_finished boolean")
    at = _whole(spark, path, "run.json").select("run", doc.alias("d"))
    return at.select("run", F.coalesce("d.protocol", "d.protocol_version").alias("protocol"), "d.dataset", "d.method", F.col("d.seed").alias("meta_seed"), F.col("d.training_finished").alias("finished"))


def costs(spark: SparkSession, path: str) -> DataFrame:
    """match (lower case), params, gflops of a complexity table; rows without a name part or a cost drop."""
    at = cells(F.lit("x"), F.col("value"), spark.read.text(path, wholetext=True)).groupBy("line").pivot("name", ["run_match", "params", "gflops"]).agg(F.first("value"))
    return at.select(F.lower(F.trim("run_match")).alias("match"), F.col("params").try_cast("long").alias("params"), F.col("gflops").try_cast("double").alias("gflops")).filter("match != '' and gflops is not null")


def run_status(best: DataFrame, meta: DataFrame, rows: int = 100) -> DataFrame:
    """Runs with whether they have all rows, and what their metadata say."""
    return best.withColumn("complete", F.col("epochs") >= rows).join(meta, "run", "left")


def run_table(runs: DataFrame, meta: DataFrame, cost: DataFrame, name: str = "name", base: int = BASE_SIZE) -> DataFrame:
    """run, name, best_epoch, best, last, n, imgsz, batch, gflops, gflops_source: runs with their settings where there are any (imgsz else the base size), and the cost of the longest name part in the table, scaled by area: meas at the base size, est at others, missing without a match."""
    at = runs.join(meta.select("run", "imgsz", "batch"), "run", "left").withColumn("imgsz", F.coalesce("imgsz", F.lit(base)))
    hit = longest_match(at.select(F.lower(name).alias("_name")), cost.select("match", F.col("gflops").alias("_g")), "_name").select("_name", "_g")
    full = at.withColumn("_name", F.lower(name)).join(hit, "_name", "left")
    source = F.when(F.col("_g").isNull(), "missing").when(F.col("imgsz") == base, "meas").otherwise("est")
    return full.select("run", name, "best_epoch", "best", "last", "n", "imgsz", "batch", scaled_cost(F.col("_g"), F.col("imgsz"), base).alias("gflops"), source.alias("gflops_source"))


def cumulative_steps(curves: DataFrame, images: int, by: str = "run") -> DataFrame:
    """curves with iterations (batches of an epoch, the last one short) and steps up to each epoch."""
    n = F.ceil(F.lit(images) / F.col("batch"))
    return curves.withColumn("iterations", n).withColumn("steps", n * F.col("epoch"))


def run_keys(run: Column, root: str = "", strip: str = "") -> Column:
    """config, seed of a run folder: the path below ``root`` (the last folder without one), seed from a last folder seedN or a suffix _seedN, module tags and ``strip`` taken out, doubled and outer separators tidied."""
    rel = F.regexp_replace(run, "^" + root.rstrip("/") + "/", "") if root else F.regexp_extract(run, r"([^/]+(?:/seed\d+)?)/?$", 1)
    seed = F.coalesce(F.nullif(F.regexp_extract(rel, r"(?:^|/)seed(\d+)$", 1), F.lit("")), F.nullif(F.regexp_extract(rel, r"_seed(\d+)$", 1), F.lit(""))).try_cast("int")
    name = F.regexp_replace(F.regexp_replace(rel, r"/seed\d+$", ""), r"_seed\d+$", "")
    name = F.regexp_replace(name, r"_module-[^/]*$", "")
    if strip:
        name = F.replace(name, F.lit(strip), F.lit(""))
    name = F.regexp_replace(F.replace(F.replace(name, F.lit("/_"), F.lit("/")), F.lit("_/"), F.lit("/")), "_{2,}", "_")
    name = F.regexp_replace(name, r"^[/_]+|[/_]+$", "")
    return F.struct(F.when(name == "", F.regexp_extract(run, r"([^/]+)/?$", 1)).otherwise(name).alias("config"), seed.alias("seed"))


def legacy_keys(name: Column, strip: str = "") -> Column:
    """config, seed of a single folder name <prefix><config>_seed<N>_module-<tag>: the seed at the end of the whole name only."""
    seed = F.nullif(F.regexp_extract(name, r"_seed(\d+)$", 1), F.lit("")).try_cast("int")
    out = F.regexp_replace(F.regexp_replace(name, r"_module-[^/]*$", ""), r"_seed(\d+)$", "")
    if strip:
        out = F.when(out.startswith(strip), F.substring(out, F.lit(len(strip) + 1), F.length(out))).otherwise(out)
    out = F.regexp_replace(out, "^_+|_+$", "")
    return F.struct(F.when(out == "", name).otherwise(out).alias("config"), seed.alias("seed"))
