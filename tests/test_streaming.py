"""Streams that go on from their checkpoint: the index of fingerprints and the tail of logs."""

import json
import random
import time
from collections import Counter

import pytest

from siftline.operators import curves, dedup
from siftline.streaming import index, monitor, tail

ROWS = "id long, hash long, place string"


@pytest.fixture
def state(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old, parts = spark.conf.get(key), spark.conf.get("spark.sql.shuffle.partitions")
    index.with_state(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set(key, old)
    spark.conf.set("spark.sql.shuffle.partitions", parts)


def _ran(spark, links, out, checkpoint):
    """One run over all that is there, from the checkpoint on."""
    q = links.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    return spark.read.schema(index.LINKS).parquet(out).collect()


@pytest.mark.parametrize("place", [None, "place"])
def test_near_links(spark, tmp_path, state, place):
    """Three batches, the third after a restart, give the links of all rows at once: between classes, and copies counted."""
    random.seed(12)
    base = [random.getrandbits(63) for _ in range(8)] + [-1]
    hashes = [random.choice(base) ^ (sum(1 << random.randrange(63) for _ in range(random.randrange(4)))) for _ in range(90)]
    rows = [(i, None if i % 23 == 5 else h, random.choice(["a", "b"])) for i, h in enumerate(hashes)]
    spark.createDataFrame(rows[:1], ROWS).write.parquet(str(tmp_path / "in"))
    stream = lambda: index.near_links(spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), 3, place)
    got = _ran(spark, stream(), str(tmp_path / "out"), str(tmp_path / "check"))
    for low, high in ((1, 40), (40, 90)):
        spark.createDataFrame(rows[low:high], ROWS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = _ran(spark, stream(), str(tmp_path / "out"), str(tmp_path / "check"))
    first, members = {}, Counter()
    for i, h, p in rows:
        if h is not None:
            key = (h, p if place else "")
            first.setdefault(key, i)
            members[first[key]] += 1
    far = lambda x, y: ((x ^ y) & (2**64 - 1)).bit_count()
    want = {(min(i, j), max(i, j), far(x, y)) for (x, p), i in first.items() for (y, q), j in first.items() if i < j and far(x, y) <= 3 and (not place or p != q)}
    links = [(r["a"], r["b"], r["distance"]) for r in got if r["kind"] == "link"]
    assert len(links) == len(set(links)) and set(links) == want and want
    copies = Counter()
    for r in got:
        if r["kind"] == "copies":
            copies[r["a"]] += r["n"]
    assert copies == {i: n - 1 for i, n in members.items() if n > 1}
    if not place:  # and with the members, all near pairs of the union
        cls = {i: first[h, ""] for i, h, _ in rows if h is not None}
        pairs = {(min(a, b), max(a, b)) for a, b, _ in links}
        near = {(r["a"], r["b"]) for r in dedup.near_pairs(spark.createDataFrame(rows, ROWS), 3).collect()}
        assert near == {(i, j) for i in cls for j in cls if i < j and (cls[i] == cls[j] or (min(cls[i], cls[j]), max(cls[i], cls[j])) in pairs)}


def test_classes_are_forgotten(spark, tmp_path, state):
    def batch(*rows):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        links = index.near_links(spark.readStream.schema(ROWS).parquet(str(tmp_path / "in")), 2, keep=0.001)
        q = links.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).start()
        try:  # a stream with a time limit on state has no end of its own
            for _ in range(240):
                if any(p["numInputRows"] for p in q.recentProgress):
                    break
                time.sleep(0.5)
        finally:
            q.stop()
        return spark.read.schema(index.LINKS).parquet(str(tmp_path / "out")).collect()

    one = batch((1, 7, "a"), (2, 6, "a"))
    assert [(r["kind"], r["a"], r["b"]) for r in one] == [("link", 1, 2)]
    assert batch((3, 7, "a")) == one


def test_tail(spark, tmp_path):
    """Appended lines arrive once, a cut last line waits, a restart repeats nothing, a file that was replaced is read anew."""
    logs, out, check = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "check")
    (logs / "run").mkdir(parents=True)
    a, b = logs / "a.jsonl", logs / "run/b.jsonl"

    def seen(split_bytes=64 << 20):
        q = tail.lines(spark, str(logs), split_bytes=split_bytes).writeStream.format("json").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        assert q.awaitTermination(300)
        return Counter((r["path"].rpartition("/")[2], r["line"]) for r in spark.read.schema(tail.SCHEMA).json(out).collect())

    a.write_bytes(b"one\ntwo\r\nthr")
    (logs / "other.txt").write_bytes(b"no\n")
    assert seen() == Counter({("a.jsonl", "one"): 1, ("a.jsonl", "two"): 1})
    with a.open("ab") as f:
        f.write(b"ee\n\nfive")
    b.write_bytes("ü\n".encode() * 3)
    want = Counter({("a.jsonl", x): 1 for x in ("one", "two", "three", "")}) + Counter({("b.jsonl", "ü"): 3})
    assert seen() == want
    assert seen() == want
    many = [f"line {k} " + "x" * (k % 50) for k in range(2000)]
    with b.open("ab") as f:
        f.write("".join(x + "\n" for x in many).encode() + b"cut")
    want += Counter(("b.jsonl", x) for x in many)
    assert seen(split_bytes=1000) == want
    a.write_bytes(b"new\n")
    want += Counter({("a.jsonl", "new"): 1})
    assert seen() == want


def test_exposure_of_a_growing_log(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    log = tmp_path / "logs/exposure.jsonl"
    rows = [{"epoch": e, "images": 10, "post_augmentation_empty_images": e, "alpha": 0.5} for e in (1, 1, 2)]
    log.write_text("".join(json.dumps(r) + "\n" for r in rows) + "{broken\n" + json.dumps(rows[2])[:9])
    from siftline.sources.readers import EXPOSURE

    stream = tail.json_lines(spark, str(tmp_path / "logs"), EXPOSURE)
    q = stream.writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    got = monitor.exposure_by_epoch(spark.read.schema(EXPOSURE).json(str(tmp_path / "out"))).collect()
    assert {r["epoch"]: (r["images"], r["empty"]) for r in got} == {1: (20, 2), 2: (10, 2)}


def test_nearest_step_in_ranges(spark):
    """Against every pair: ties of distance and of step, null keys, steps that one side has many times, ranges without a right row."""
    random.seed(9)
    left = [(random.choice(["k", "l", "m", None]), i, random.choice([5, random.randrange(-50, 2000)])) for i in range(400)]
    right = [(random.choice(["k", "l"]), random.randrange(30), random.choice([7, 900, random.randrange(0, 1500)]), float(i)) for i in range(60)] + [(None, 1, 5, 0.0), ("z", 1, 5, 0.0)]
    x, y = spark.createDataFrame(left, "run string, i int, step long"), spark.createDataFrame(right, "run string, epoch int, step long, metric double")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = curves.nearest_step(x, y, ["run"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert got.columns == ["run", "i", "step", "near_epoch", "near_step", "near_metric", "gap"]
    want = {}
    for k, i, step in left:
        near = [(abs(r[2] - step), r[1], r[2], r[3]) for r in right if k is not None and r[0] == k]
        if near:
            gap, epoch, at, metric = min(near)
            want[i] = (k, step, epoch, at, metric, gap)
    assert {r["i"]: (r["run"], r["step"], r["near_epoch"], r["near_step"], r["near_metric"], r["gap"]) for r in got.collect()} == want
    assert curves.nearest_step(x, y.limit(0), ["run"]).count() == 0


def test_gaps_of_epochs(spark):
    c = spark.createDataFrame([("a", 2), ("a", 3), ("a", 3), ("a", 10**9), ("b", 1), ("c", 0), ("c", 3)], "run string, epoch int")
    assert sorted(map(tuple, curves.epoch_gaps(c).collect())) == [("a", 1, 1), ("a", 4, 10**9 - 1), ("c", 1, 2)]
    assert sorted(map(tuple, curves.missing_epochs(c.filter("run != 'a'")).collect())) == [("c", 1), ("c", 2)]
    assert curves.missing_epochs(c.limit(0)).count() == 0 and c.schema["epoch"].dataType == curves.epoch_gaps(c).schema["last"].dataType
