"""Commands: prepare, audit, plan, train, check-model, evaluate, calibrate, reliability, benchmark, summarize.

Networks are not part of this library: evaluate takes detections that some
detector wrote, benchmark takes times that someone measured, train plans a run,
and check-model says what a plan needs.
"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.lineage import cut
from .operators import alarms, ap, dedup, guards, matching, reports
from .sources import images as image_files
from .sources import readers, versions
from .sources.protocol import read_protocol


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siftline", description=__doc__)
    p.add_argument("--config", default="configs/protocol.yaml")
    commands = p.add_subparsers(dest="command", required=True)

    def add(name: str, *needed: str, **others) -> None:
        c = commands.add_parser(name)
        for n in needed:
            c.add_argument(f"--{n}", required=True)
        for n, default in others.items():
            flag = "--" + n.replace("_", "-")
            if isinstance(default, bool):
                c.add_argument(flag, action="store_true")
            elif isinstance(default, list):
                c.add_argument(flag, nargs="+", default=default, required=not default)
            else:
                c.add_argument(flag, type=type(default), default=default)

    add("prepare", "dataset")
    add("audit", "output", datasets=["dfire", "fasdd"], hashes=False, radius=4)
    add("plan", "dataset", method="baseline", seed=0, tag="v1")
    add("train", "dataset", method="baseline", seed=0, tag="v1", execute=False)
    add("check-model", "output", method="baseline")
    add("evaluate", "predictions", "dataset", "split", "output")
    add("calibrate", "predictions", "output", max_fpr=0.01)
    add("reliability", "predictions", "calibration", "output", bootstrap=1000, seed=0)
    add("benchmark", "times", "output", warmup=50)
    add("summarize", "output", metrics=[])
    return p


def session() -> SparkSession:
    return SparkSession.builder.appName("siftline").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _write(document: dict, output: str) -> dict:
    """One small document, never over another."""
    path = Path(output)
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("x", encoding="utf-8") as f:
        json.dump(document, f, ensure_ascii=False, allow_nan=False, indent=2)
    return document


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def prepare(spark: SparkSession, config: dict, dataset: str) -> dict:
    """Commit the canonical version of a dataset: manifest, label files, split lists, excluded images apart."""
    entry, out = config["datasets"][dataset], f"{config['prepared_root']}/{dataset}"
    rows, _ = versions.labelled(spark, dataset, entry)
    made = versions.commit(spark, rows, out, {"dataset": dataset, "source": entry, "label_policy": entry.get("invalid_box_policy", "error")}, int(entry.get("neg_repeat", 1)))
    return {"prepared": out, "images": made["counts"], "excluded": sum(made["excluded"].values()), "portable_content_sha256": made["portable_content_sha256"]}


def audit(spark: SparkSession, config: dict, datasets: list[str], output: str, hashes: bool, radius: int) -> dict:
    """Counts of labels and splits, and with ``hashes`` exact and near duplicates across splits and datasets."""
    parts = {d: versions.labelled(spark, d, config["datasets"][d]) for d in datasets}
    at = cut(guards.union_in_order({d: f for d, (f, _) in parts.items()}))
    of = lambda c: F.coalesce(F.sum(F.when(~F.col("excluded"), F.size(F.filter("boxes", lambda b: b["cls"] == c)))), F.lit(0))
    outside = lambda b: (F.least(b["x"] - b["w"] / 2, b["y"] - b["h"] / 2) < -1e-5) | (F.greatest(b["x"] + b["w"] / 2, b["y"] + b["h"] / 2) > 1 + 1e-5)
    counts = at.groupBy("dataset", "split").agg(
        F.count("*").alias("images"), F.count_if((F.size("boxes") == 0) & ~F.col("excluded")).alias("background"), F.count_if("excluded").alias("excluded"), of(0).alias("fire_boxes"), of(1).alias("smoke_boxes"),
        F.coalesce(F.sum(F.when(~F.col("excluded"), F.size(F.filter("boxes", outside)))), F.lit(0)).alias("boundary_crossing_boxes"),
    )
    faults = at.select("dataset", "split", F.explode("label_issues").alias("i")).groupBy("dataset", "split", "i.reason").agg(F.count("*").alias("n"))
    result = {"counts": _rows(counts.orderBy("dataset", "split")), "label_issues": _rows(faults.orderBy("dataset", "split", "reason"))}
    if hashes:
        from .functions.pixels import dhash_left

        scans = [image_files.content_scan(spark, f"{config['datasets'][d]['root']}/images").withColumn("dataset", F.lit(d)) for d in datasets]
        scan = scans[0]
        for s in scans[1:]:
            scan = scan.unionByName(s)
        where = at.select(F.col("image").alias("path"), "dataset", "split")  # by path, whatever the layout
        scan = cut(scan.join(where, ["path", "dataset"]).select(F.col("path").alias("id"), "dataset", "split", "sha256", "gray", "decode_error"))
        rows = scan.filter("gray is not null").select("id", "dataset", "split", dhash_left("gray").alias("hash"))
        near = cut(dedup.cross_scope(dedup.near_pairs(rows, radius), rows, reference=""))
        near.write.mode("errorifexists").json(f"{output}/near_candidates")
        result |= {"exact_groups": dedup.exact_groups(scan, "sha256").count(), "near_pairs": near.count(), "scopes": _rows(dedup.scope_counts(rows, dedup.near_classes(rows, radius), reference=None)), "not_decoded": scan.filter("decode_error is not null").count()}
    return _write(result, f"{output}/audit.json")


def _scores(images: DataFrame) -> DataFrame:
    """image_id, cls, label, score, scene of detector output: two rows an image."""
    both = images.select(F.col("id").alias("image_id"), F.col("group").alias("scene"), "truth", "predictions", F.explode(F.array(F.lit(0), F.lit(1))).alias("cls"))
    own = lambda a: F.filter(a, lambda b: b["cls"] == F.col("cls"))
    score = F.coalesce(F.array_max(F.transform(own("predictions"), lambda b: b["conf"])), F.lit(0.0))
    return both.select("image_id", "cls", (F.size(own("truth")) > 0).cast("int").alias("label"), score.alias("score"), "scene")


def calibrate(spark: SparkSession, predictions: str, output: str, max_fpr: float) -> dict:
    """Temperatures and thresholds from the validation split of the training dataset."""
    if not 0 <= max_fpr < 1:
        raise ValueError("max-fpr lies between 0 and 1")
    header, images = readers.predictions(spark, predictions)
    head = header.first().asDict(recursive=True)
    guards.check_fit(head)
    scores = cut(_scores(images))
    if scores.groupBy("cls").agg(F.countDistinct("label").alias("n")).filter("n < 2").count():
        raise ValueError("each class needs images with it and without it")
    got = alarms.calibration_report(scores, scores, max_fpr).orderBy("cls")
    return _write({"fit_split": "val", "source_dataset": head["dataset"], "names": head["names"], "checkpoint_sha256": head["checkpoint_sha256"], "max_validation_fpr": max_fpr, "classes": _rows(got)}, output)


def reliability(spark: SparkSession, predictions: str, calibration: str, output: str, replicates: int, seed: int) -> dict:
    """Alarms, false boxes on backgrounds, calibration before and after, and intervals, on the test split."""
    if replicates < 1:
        raise ValueError("at least one replicate")
    header, images = readers.predictions(spark, predictions)
    head, fitted = header.first().asDict(recursive=True), json.loads(Path(calibration).read_text(encoding="utf-8"))
    guards.check_report(head, fitted)
    at = spark.createDataFrame([(c["cls"], float(c["temperature"]), float(c["threshold"])) for c in fitted["classes"]], "cls int, temperature double, threshold double")
    scores = cut(_scores(images))
    new = cut(scores.join(at, "cls").withColumn("score", alarms.scaled(F.col("score"), F.col("temperature"))).drop("temperature", "threshold"))
    found = readers.exploded(images, "predictions", "det_idx").join(at.select("cls", "temperature"), "cls").withColumn("conf", alarms.scaled(F.col("conf"), F.col("temperature")))
    listed = images.select(F.col("id").alias("image_id"))
    result = {
        "dataset": head["dataset"], "alarms": _rows(alarms.alarm_metrics(new, at).orderBy("cls")), "background": _rows(alarms.background_alarms(new, at))[0],
        "background_boxes": _rows(alarms.background_boxes(listed, readers.exploded(images, "truth", "box_idx"), found, at))[0],
        "calibration_before": _rows(alarms.ece_brier(scores).orderBy("cls")), "calibration_after": _rows(alarms.ece_brier(new).orderBy("cls")),
        "intervals": _rows(alarms.bootstrap_report(new, at, replicates, seed).orderBy("metric", "cls")), "replicates": replicates, "seed": seed,
    }
    return _write(result, output)


def evaluate(spark: SparkSession, predictions: str, dataset: str, split: str, output: str) -> dict:
    """AP by class and overlap of detections that are already there."""
    header, images = readers.predictions(spark, predictions)
    head = header.first().asDict(recursive=True)
    if (head["dataset"], head["split"]) != (dataset, split):
        raise ValueError(f"the detections are of {head['dataset']}/{head['split']}")
    boxes, found = cut(readers.exploded(images, "truth", "box_idx")), cut(readers.exploded(images, "predictions", "det_idx"))
    steps = [0.5 + 0.05 * k for k in range(10)]
    best = matching.two_pass_match(matching.overlaps(boxes, found)).select("image_id", "det_idx", "iou")
    each = found.join(best, ["image_id", "det_idx"], "left").select("*", F.explode(F.array(*map(F.lit, steps))).alias("t"))
    flags = each.select("cls", "t", "conf", "image_id", "det_idx", F.coalesce((F.col("iou") >= F.col("t")).cast("int"), F.lit(0)).alias("flag"))
    totals = boxes.groupBy("cls").agg(F.count("*").alias("n_gt")).select("*", F.explode(F.array(*map(F.lit, steps))).alias("t"))
    got = ap.average_precision(flags, totals, ["cls", "t"]).groupBy("cls").agg(F.max(F.when(F.col("t") == 0.5, F.col("ap"))).alias("AP50"), F.avg("ap").alias("AP50_95"))
    rows = _rows(got.orderBy("cls"))
    mean = lambda k: sum(r[k] or 0.0 for r in rows) / max(1, len(rows))
    keys = ("dataset", "split", "checkpoint_sha256", "manifest_sha256", "training_dataset", "method", "seed", "tag")
    return _write({**{k: head[k] for k in keys}, "metrics": {"mAP50": mean("AP50"), "mAP50_95": mean("AP50_95")}, "per_class": rows}, output)


def benchmark(spark: SparkSession, times: str, output: str, warmup: int) -> dict:
    """Summary of measured times, JSON lines with a column milliseconds, the first ones left out by their number n."""
    at = spark.read.schema("n long, milliseconds double").json(times).filter(F.col("n") >= warmup).withColumn("of", F.lit("forward"))
    rows = _rows(reports.latency_summary(at, ["of"], "milliseconds"))
    if not rows:
        raise ValueError("no times after the warm-up")
    return _write(rows[0], output)


def summarize(spark: SparkSession, metrics: list[str], output: str, seeds: list[int]) -> dict:
    """Mean and deviation over the registered seeds, by tag, datasets and method."""
    rows = [json.loads(Path(m).read_text(encoding="utf-8")) for m in metrics]
    groups: dict[tuple, list[dict]] = {}
    for r in rows:
        groups.setdefault(tuple(r.get(k) for k in ("tag", "training_dataset", "dataset", "method", "manifest_sha256")), []).append(r)
    for some in groups.values():
        guards.check_summary(some, seeds)
    flat = [(*map(str, key[:4]), r["seed"], k, float(v)) for key, some in groups.items() for r in some for k, v in r["metrics"].items()]
    df = spark.createDataFrame(flat, "tag string, source string, target string, method string, seed int, metric string, value double")
    got = df.groupBy("tag", "source", "target", "method", "metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    return _write({"groups": _rows(got.orderBy("tag", "source", "target", "method", "metric"))}, output)


def main(argv: list[str] | None = None) -> dict:
    a = parser().parse_args(argv)
    config = read_protocol(a.config)
    if a.command in ("plan", "train"):
        run = guards.check_run(config, a.dataset, a.method, a.seed, a.tag)
        if getattr(a, "execute", False):
            raise SystemExit("training is not part of this library")
        result = {"run": f"{config['results_root']}/{run}", "protocol": config["protocol"], "method": config["methods"][a.method], "config_sha256": guards.canonical_sha256(config)}
    elif a.command == "check-model":
        if a.method not in config["methods"]:
            raise ValueError(f"unknown method {a.method}")
        result = _write({"method": config["methods"][a.method], "checked": False, "why": "networks are not part of this library"}, a.output)
    elif a.command == "prepare":
        result = prepare(session(), config, a.dataset)
    elif a.command == "audit":
        result = audit(session(), config, a.datasets, a.output, a.hashes, a.radius)
    elif a.command == "evaluate":
        result = evaluate(session(), a.predictions, a.dataset, a.split, a.output)
    elif a.command == "calibrate":
        result = calibrate(session(), a.predictions, a.output, a.max_fpr)
    elif a.command == "reliability":
        result = reliability(session(), a.predictions, a.calibration, a.output, a.bootstrap, a.seed)
    elif a.command == "benchmark":
        result = benchmark(session(), a.times, a.output, a.warmup)
    else:
        result = summarize(session(), a.metrics, a.output, config["seeds"])
    print(json.dumps(result, indent=2, ensure_ascii=False, allow_nan=False))
    return result


if __name__ == "__main__":
    main()
