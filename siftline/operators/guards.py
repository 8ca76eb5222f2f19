"""Guards and registries: what a command refuses, content collisions, order checks, provenance."""

from __future__ import annotations

import hashlib
import json
import platform
import re
import sys
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The protocol version that readers know: any name, version 1.
PROTOCOL = re.compile(r"[a-z]+-v1")
_TAG = re.compile(r"[A-Za-z0-9_-]+")


def check_protocol(config: Mapping) -> Mapping:
    """The configuration, if it names a protocol of the known version."""
    if not PROTOCOL.fullmatch(str(config.get("protocol"))):
        raise ValueError(f"unknown protocol {config.get('protocol')!r}")
    return config


def check_run(config: Mapping, dataset: str, method: str, seed: int, tag: str) -> str:
    """The folder of a run, below the results folder, if dataset, method and seed are registered and the tag is a plain name."""
    if dataset not in config["datasets"] or method not in config["methods"]:
        raise ValueError(f"unknown dataset or method: {dataset}, {method}")
    if seed not in config["seeds"]:
        raise ValueError(f"seed {seed} is not one of {config['seeds']}")
    if not _TAG.fullmatch(tag):
        raise ValueError(f"a tag has letters, digits, - and _ only: {tag!r}")
    return f"{dataset}/{tag}/{method}/seed{seed}"


def check_fit(header: Mapping) -> None:
    """Thresholds and temperatures are fitted on the validation split of the training dataset only."""
    if header["split"] != "val":
        raise ValueError("fitting needs the val split")
    if header["training_dataset"] != header["dataset"]:
        raise ValueError("fitting on another dataset than the training one is no zero-shot protocol")


def check_report(header: Mapping, fitted: Mapping, fields: Sequence[str] = ("checkpoint_sha256", "names")) -> None:
    """A report is on the test split, with what was fitted for the same checkpoint and names; a missing field is a difference."""
    if header["split"] != "test":
        raise ValueError("a report needs the test split")
    for f in fields:
        if header.get(f) is None or header.get(f) != fitted.get(f):
            raise ValueError(f"the calibration does not match in {f}")


def check_summary(rows: Sequence[Mapping], seeds: Sequence[int]) -> None:
    """Test metrics of exactly the expected seeds, each with a checkpoint of its own and the same metrics."""
    if any(r["split"] != "test" for r in rows):
        raise ValueError("a summary takes test metrics only")
    if sorted(r["seed"] for r in rows) != sorted(seeds):
        raise ValueError(f"expected seeds {sorted(seeds)}, got {sorted(r['seed'] for r in rows)}")
    if len({r["checkpoint_sha256"] for r in rows}) != len(rows):
        raise ValueError("one checkpoint stands for several seeds")
    if len({tuple(sorted(r["metrics"])) for r in rows}) > 1:
        raise ValueError("the runs have different metrics")


def resolve_reference(name: str | None, configs: Sequence[str]) -> str | None:
    """The configuration of that name, else the only one that begins with it, else none."""
    if not name:
        return None
    if name in configs:
        return name
    begins = [c for c in configs if c.startswith(name)]
    return begins[0] if len(begins) == 1 else None


def canonical_sha256(document: object) -> str:
    """SHA-256 of a document as JSON with sorted keys and no spaces; NaN and infinities are refused."""
    return hashlib.sha256(json.dumps(document, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()).hexdigest()


def provenance(argv: Sequence[str] = (), sources: Mapping[str, bytes] | None = None) -> dict:
    """What made a result: time, versions, arguments, digests of source files."""
    import pyspark

    return {
        "created": datetime.now(timezone.utc).isoformat(timespec="seconds"), "python": platform.python_version(), "spark": pyspark.__version__,
        "argv": list(argv or sys.argv), "sources": {k: hashlib.sha256(v).hexdigest() for k, v in sorted((sources or {}).items())},
    }


def collisions(kept: DataFrame, reference: DataFrame, keys: Sequence[str] = ("byte_sha", "pixel_sha")) -> DataFrame:
    """source_id, fault of kept rows whose bytes or pixels a reference row (``reference_<key>``) or another kept row (``repeated_<key>``) has."""
    out = None
    for k in keys:
        some = kept.filter(F.col(k).isNotNull()).select("source_id", k)
        taken = some.join(reference.select(k), k, "left_semi").select("source_id", F.lit(f"reference_{k}").alias("fault"))
        twice = some.join(some.groupBy(k).count().filter("count > 1").select(k), k, "left_semi").select("source_id", F.lit(f"repeated_{k}").alias("fault"))
        both = taken.unionByName(twice)
        out = both if out is None else out.unionByName(both)
    return out


def order_faults(boxes: DataFrame, seen: DataFrame) -> DataFrame:
    """image_id, box_idx, fault of boxes by manifest against what a validator saw at the same place: missing, extra, or of another class."""
    a = boxes.select("image_id", "box_idx", F.col("cls").alias("_a"))
    b = seen.select("image_id", "box_idx", F.col("cls").alias("_b"))
    fault = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(F.col("_a") != F.col("_b"), "class")
    return a.join(b, ["image_id", "box_idx"], "full_outer").select("image_id", "box_idx", fault.alias("fault")).filter("fault is not null")


def join_by_name(manifest: DataFrame, scan: DataFrame, name: str = "name") -> DataFrame:
    """The manifest with the scan's columns by file name; a name that the scan has twice, or not at all, is an error at run time."""
    one = scan.groupBy(name).agg(F.count("*").alias("_n"), F.first(F.struct(*(c for c in scan.columns if c != name))).alias("_s"))
    n = F.coalesce("_n", F.lit(0))
    at = manifest.join(one, name, "left")
    ok = F.when(n == 1, F.col(name)).otherwise(F.raise_error(F.concat(F.lit("not once in the scan: "), F.col(name).cast("string"))))
    return at.withColumn(name, ok).select(*manifest.columns, "_s.*")


def union_in_order(datasets: Mapping[str, DataFrame]) -> DataFrame:
    """The rows of all datasets with dataset and dataset_pos, the place in which it was named; columns that one lacks are null."""
    parts = [df.withColumns({"dataset": F.lit(k), "dataset_pos": F.lit(i)}) for i, (k, df) in enumerate(datasets.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def append_exclusions(excluded: DataFrame, old: DataFrame, reason: str) -> DataFrame:
    """Exclusions with those of an older version under one reason; each side keeps the columns of its own."""
    return excluded.unionByName(old.withColumn("reason", F.lit(reason)), allowMissingColumns=True)


def backfill(images: DataFrame, labels: DataFrame) -> DataFrame:
    """split, images, labels, missing, orphans by (split, stem): a report of the empty labels that would be made; nothing is written."""
    i, l = images.select("split", "stem", F.lit(1).alias("_i")), labels.select("split", "stem", F.lit(1).alias("_l"))  # noqa: E741
    both = i.join(l, ["split", "stem"], "full_outer")
    return both.groupBy("split").agg(
        F.count("_i").alias("images"), F.count("_l").alias("labels"), F.count_if(F.col("_l").isNull()).alias("missing"), F.count_if(F.col("_i").isNull()).alias("orphans")
    )
