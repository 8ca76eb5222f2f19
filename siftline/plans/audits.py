"""Queries on scopes of duplicates, names, sources, run tables and guards, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import curves as C
from ..operators import dedup, guards, reports
from ..sources import runs as R
from ..sources.fixtures import BOXES, CONTENT, CURVES, GRAYS, IMAGES, MARKS_64, MARKS_DUCKDB, derive, in_64, read, with_tables
from .content import _NEAR, RADIUS, SCREENED
from .detection import _r
from .runs import _BEST

_DATASET = "case when id % 7 = 0 then 'reference' else 'target' end"


def pairs_by_scope(s: SparkSession, d: str) -> DataFrame:
    """Near pairs across splits and datasets by scope, and distinct images in any, over all 64 signs; one in twenty has a copy in test."""
    marks = derive(s, d, MARKS_64)
    copied = marks.filter("id % 20 = 7").select((F.col("id") + 1000000).alias("id"), F.lit("test").alias("split"), "hash")
    rows = marks.unionByName(copied).withColumn("dataset", F.expr(_DATASET))
    return dedup.scope_counts(rows, dedup.near_classes(rows, RADIUS))


SCOPE_SQL = in_64(with_tables("""
select 'pairs' as kind, least(x, y) || ' <-> ' || greatest(x, y) as scope, count(*) as n from across group by 1, 2
union all select 'images', place, count(distinct id) from (select a as id, x as place from across union all select b, y from across) group by 1, 2""",
    own=MARKS_DUCKDB, marks="select * from own union all select id + 1000000, 'test', hash from own where id % 20 = 7", near=_NEAR, placed=f"select id, split, {_DATASET} as dataset, {_DATASET} || '/' || split as place from marks",
    across="select a, b, p.place as x, q.place as y from near join placed p on p.id = a join placed q on q.id = b where p.place <> q.place and not (p.dataset = 'reference' and q.dataset = 'reference')"))


def near_dup_audit(s: SparkSession, d: str) -> DataFrame:
    """The screen's summary: candidates and low-texture ones, then pairs and images by scope."""
    images = derive(s, d, GRAYS)
    members, classes = dedup.gray_classes(images, "dataset", "split")
    found = dedup.cut(dedup.near_screen(images, grouped=(members, classes)))
    whole = found.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("review"), F.coalesce(F.sum(F.when(F.col("low_texture"), F.col("pairs"))), F.lit(0)).alias("low_texture")).unpivot([], ["review", "low_texture"], "scope", "n")
    links = found.filter("a != b").select(F.col("a").alias("p"), F.col("b").alias("q"))
    return whole.select(F.lit("candidates").alias("kind"), "scope", "n").unionByName(dedup.scope_counts(members, links, "rep"))


AUDIT_SQL = with_tables("""
select 'candidates' as kind, 'review' as scope, count(*) as n from found union all select 'candidates', 'low_texture', count(*) from found where least(va, vb) < 25
union all select 'pairs', least(x, y) || ' <-> ' || greatest(x, y), count(*) from found group by 2
union all select 'images', place, count(distinct id) from (select a as id, x as place from found union all select b, y from found) group by 2""", **SCREENED)  # fmt: skip


def added_matches(s: SparkSession, d: str) -> DataFrame:
    """Embeddings of val, and copies of some of train, against train: the first five exact and near matches of each, over all 64 signs."""
    marks = derive(s, d, MARKS_64).withColumn("sha", F.expr("md5(cast(hash as string))"))
    train = marks.filter("split = 'train'")
    added = marks.filter("split = 'val'").unionByName(train.filter("id % 20 = 7").withColumn("id", F.col("id") + 1000000))
    got = dedup.matches_in_reference(added, train, RADIUS)
    return got.select("id", F.posexplode("matches").alias("place", "m")).select("id", "place", "m.*")


ADDED_SQL = in_64(with_tables(f"""
select id, cast(place as int) as place, "with", distance, identical from (
  select *, row_number() over (partition by id order by kind, distance, "with") - 1 as place from (
    select a.id, 0 as kind, 0 as distance, r.w as "with", true as identical from added a join ref r on a.hash = r.hash
    union all select a.id, 1, cast(bit_count(xor(a.hash, r.hash)) as int), r.w, false from added a join ref r on bit_count(xor(a.hash, r.hash)) <= {RADIUS})) where place < 5""",
    marks=MARKS_DUCKDB, added="select id, hash from marks where split = 'val' union all select id + 1000000, hash from marks where split = 'train' and id % 20 = 7",
    ref="select hash, min(id) as w from marks where split = 'train' group by 1"))


def collision_gate(s: SparkSession, d: str) -> DataFrame:
    """Targets whose bytes or pixels a reference or another target has; of a selection's survivors there are none."""
    live = derive(s, d, CONTENT).filter("decode_error = 0")
    return guards.collisions(live.filter("dataset = 'target'"), live.filter("dataset = 'reference'")).groupBy("fault").agg(F.count("*").alias("n"))


COLLISION_SQL = with_tables(" union all ".join(f"""
select 'reference_{k}' as fault, count(*) as n from t where {k} in (select {k} from content where decode_error = 0 and dataset = 'reference') having count(*) > 0
union all select 'repeated_{k}', count(*) from t where {k} in (select {k} from t group by 1 having count(*) > 1) having count(*) > 0""" for k in ("byte_sha", "pixel_sha")),
    content=CONTENT, t="select * from content where decode_error = 0 and dataset = 'target'")


def stem_groups(s: SparkSession, d: str) -> DataFrame:
    """Letters and number of names: customers and regions by letters."""
    names = read(s, d, "customer").select(F.col("c_name").alias("stem")).union(read(s, d, "region").select("r_name"))
    return names.select(reports.stem_parts(F.col("stem")).alias("p")).groupBy("p.letters").agg(F.count("*").alias("n"), F.min("p.number").cast("long").alias("least"), F.max("p.number").cast("long").alias("most"))


STEM_SQL = """
select letters, count(*) as n, min(number) as least, max(number) as most from (
  select regexp_replace(stem, '[^\\p{L}]', '', 'g') as letters, coalesce(try_cast(nullif(regexp_replace(stem, '[^0-9]', '', 'g'), '') as bigint), -1) as number
  from (select c_name as stem from customer union all select r_name from region)) group by 1"""


def gap_change(s: SparkSession, d: str) -> DataFrame:
    """What the gap between two losses does over the last ten epochs that have both."""
    c = derive(s, d, CURVES).withColumn("gap", F.when(F.col("epoch") % 7 != 0, F.col("metric") - F.col("epoch") * 0.5))
    return _r(reports.gap_change(c), "first", "last", "change")


GAP_SQL = with_tables("""
select run, min(epoch) as first_epoch, round(arg_min(gap, epoch), 6) as first, max(epoch) as last_epoch, round(arg_max(gap, epoch), 6) as last, round(arg_max(gap, epoch) - arg_min(gap, epoch), 6) as change from (
  select run, epoch, metric - epoch * 0.5e0 as gap, row_number() over (partition by run order by epoch desc) as r, count(*) over (partition by run) as n from curves where epoch % 7 <> 0 and metric is not null)
where n >= 12 and r <= 10 group by 1""", curves=CURVES)


def resume_deltas(s: SparkSession, d: str) -> DataFrame:
    """Seeds 1 and 2, resumed at epochs 25 and 30, against seed 0 of their configuration."""
    c = derive(s, d, CURVES)
    resumed = c.filter("seed > 0").select("run", F.when(F.col("seed") == 1, 25).otherwise(30).alias("resumed_at")).distinct()
    return _r(reports.resume_deltas(c.filter("seed > 0"), c.filter("seed = 0"), resumed, ["config"]), "mean_before", "least_before", "most_before", "last_before", "lowest", "lowest_delta")


RESUME_SQL = with_tables("""
select run, round(avg(d) filter (where early), 6) as mean_before, round(min(d) filter (where early), 6) as least_before, round(max(d) filter (where early), 6) as most_before,
       round(max(d) filter (where epoch = resumed - 1), 6) as last_before, max(epoch) filter (where r = 1 and late) as lowest_epoch, round(max(metric) filter (where r = 1 and late), 6) as lowest, round(max(d) filter (where r = 1 and late), 6) as lowest_delta
from (select x.run, x.epoch, x.metric, x.resumed, 100 * (x.metric - b.metric) as d, x.epoch < x.resumed and x.epoch >= x.resumed - 10 as early, x.epoch >= x.resumed as late,
             row_number() over (partition by x.run, x.epoch >= x.resumed order by x.metric, x.epoch) as r
      from (select *, case seed when 1 then 25 else 30 end as resumed from curves where seed > 0) x left join (select * from curves where seed = 0) b on b.config = x.config and b.epoch = x.epoch) group by 1""", curves=CURVES)


def key_statistics(s: SparkSession, d: str) -> DataFrame:
    """Variance between three seeds of every key they share, without bins, counts and what never varies."""
    e = read(s, d, "events").withColumn("seed", (F.col("user_id") % 3).cast("int"))
    values = e.groupBy("seed", F.concat(F.lit("mean."), "event_type").alias("metric")).agg(F.avg("value").alias("value"))
    count = e.groupBy("seed").agg(F.count("*").cast("double").alias("value")).select("seed", F.lit("events_count").alias("metric"), "value")
    fixed = e.select("seed").distinct().select("seed", F.explode(F.array(F.lit("calibration.bins"), F.lit("version"))).alias("metric")).withColumn("value", F.lit(15.0))
    some = e.filter("seed < 2").groupBy("seed").agg(F.max("value").alias("value")).select("seed", F.lit("top").alias("metric"), "value")
    return _r(reports.seed_statistics(values.unionByName(count).unionByName(fixed).unionByName(some), 3), "mean", "sd", "mdd")


KEY_SQL = """
select metric, round(mean, 6) as mean, round(sd, 6) as sd, round(4.303e0 * sd / sqrt(3), 6) as mdd from (select metric, count(*) as n, avg(value) as mean, stddev_samp(value) as sd from (
  select user_id % 3 as seed, 'mean.' || event_type as metric, avg(value) as value from events group by 1, 2) group by 1) where n = 3 and sd > 0"""


def latency_summary(s: SparkSession, d: str) -> DataFrame:
    return _r(reports.latency_summary(read(s, d, "events"), ["event_type"], "value"), "mean", "sd", "median", "p95", "per_second")


LATENCY_SQL = """
select event_type, count(*) as n, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as sd, round(quantile_cont(value, 0.5), 6) as median,
       round(max(value) filter (where k = floor((n - 1) * 0.95e0)), 6) as p95, round(1000 / avg(value), 6) as per_second
from (select *, row_number() over (partition by event_type order by value) - 1 as k, count(*) over (partition by event_type) as n from events where value is not null) group by 1"""


def input_ratio(s: SparkSession, d: str) -> DataFrame:
    """Input over native pixels by split at three input sizes, and what that means."""
    at = derive(s, d, IMAGES)
    ratio = lambda n: at.groupBy("split").agg(G.input_ratio(n, F.col("width"), F.col("height")).alias("ratio")).select("split", F.lit(n).alias("input"), "ratio")
    got = ratio(640).unionByName(ratio(960)).unionByName(ratio(1280))
    return _r(got.withColumn("tag", reports.information_tag(F.col("ratio"))), "ratio")


RATIO_SQL = with_tables("""
select split, input, round(ratio, 6) as ratio, case when ratio < 0.9 then 'loses' when ratio <= 1.3 then 'native' else 'interpolates' end as tag from (
  select split, input, sum(pow(floor(m * (cast(input as double) / m)), 2)) / sum(width * height) as ratio
  from (select *, greatest(width, height) as m from images) cross join (values (640), (960), (1280)) t(input) group by 1, 2)""", images=IMAGES)


def run_table(s: SparkSession, d: str) -> DataFrame:
    """Runs with their best epoch, settings where there are any, cost by the longest name part that is known, scaled to the input, and whether it was measured."""
    c = derive(s, d, CURVES)
    runs = C.best_and_last(c).join(c.select("run", "config", "seed").distinct(), "run").withColumn("name", F.concat(F.lit("n"), F.col("config").cast("string"), F.lit("_seed"), F.col("seed").cast("string")))
    meta = c.select("run").distinct().filter("run % 4 != 0").select("run", F.when(F.col("run") % 4 == 1, 640).otherwise(800).alias("imgsz"), (F.col("run") % 3).cast("int").alias("batch"))
    cost = s.createDataFrame([("n1", 6.0), ("n12", 7.5), ("n3", 8.25), ("_seed2", 9.0)], "match string, gflops double")
    return _r(R.run_table(runs, meta, cost), "best", "last", "gflops")


RUN_TABLE_SQL = with_tables("""
select run, name, best_epoch, round(best, 6) as best, round(last, 6) as last, n, imgsz, batch, round(gflops * pow(imgsz / 640e0, 2), 6) as gflops, case when gflops is null then 'missing' when imgsz = 640 then 'meas' else 'est' end as gflops_source
from (select b.run, name, best_epoch, best, last, n, coalesce(case when b.run % 4 = 1 then 640 when b.run % 4 <> 0 then 800 end, 640) as imgsz, case when b.run % 4 <> 0 then cast(b.run % 3 as int) end as batch, gflops,
             row_number() over (partition by b.run order by length(match) desc nulls last, match) as r
      from (select *, 'n' || config || '_seed' || seed as name from best) b left join (values ('n1', 6e0), ('n12', 7.5e0), ('n3', 8.25e0), ('_seed2', 9e0)) t(match, gflops) on contains(name, match)) where r = 1""", curves=CURVES, best=_BEST)


def cumulative_steps(s: SparkSession, d: str) -> DataFrame:
    """Optimizer steps up to each epoch, from the images and the batch of a run."""
    c = derive(s, d, CURVES).withColumn("batch", (8 * (1 + F.col("run") % 3)).cast("int"))
    return R.cumulative_steps(c, 15485).select("run", "epoch", "iterations", "steps")


STEPS_SQL = with_tables("select run, epoch, ceil(15485 / (8 * (1 + run % 3)))::bigint as iterations, (epoch * ceil(15485 / (8 * (1 + run % 3))))::bigint as steps from curves", curves=CURVES)


def image_paths(s: SparkSession, d: str) -> DataFrame:
    """Each order's file, from two places where it may lie."""
    ids = read(s, d, "orders").select(F.col("o_orderkey").alias("id"))
    a, b = F.concat(F.lit("x/images/"), F.col("id").cast("string")), F.concat(F.lit("x/"), F.col("id").cast("string"))
    listing = ids.filter("id % 3 = 0").select(a.alias("path")).union(ids.filter("id % 2 = 0").select(b.alias("path")))
    got = reports.first_existing(ids, [a, b], listing)
    return got.groupBy(F.regexp_replace("path", "[0-9]+$", "").alias("place")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


PATHS_SQL = "select case when o_orderkey % 3 = 0 then 'x/images/' when o_orderkey % 2 = 0 then 'x/' end as place, count(*) as n, min(o_orderkey) as first_id from orders group by 1"


def manifest_join(s: SparkSession, d: str) -> DataFrame:
    """Boxes by manifest against boxes in the order of a validator: places that are missing or of another class."""
    boxes = derive(s, d, BOXES)
    seen = boxes.filter("box_idx % 11 != 4").withColumn("cls", F.when(F.col("image_id") % 13 == 0, 1 - F.col("cls")).otherwise(F.col("cls")))
    return guards.order_faults(boxes, seen).groupBy("fault").agg(F.count("*").alias("n"))


MANIFEST_SQL = with_tables("""
select fault, count(*) as n from (select case when box_idx % 11 = 4 then 'missing' when image_id % 13 = 0 then 'class' end as fault from boxes) where fault is not null group by 1""", boxes=BOXES)


def dataset_union(s: SparkSession, d: str) -> DataFrame:
    """Two datasets in the order they are named, and exclusions of an older version with columns of their own."""
    a = read(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("x").alias("reason"))
    b = read(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("details"))
    return guards.union_in_order({"suppliers": a, "customers": b}).groupBy("dataset", "dataset_pos").agg(F.count("*").alias("n"), F.count("reason").alias("reasons"), F.count("details").alias("details"), F.max("id").alias("last_id"))


UNION_SQL = """
select 'suppliers' as dataset, 0 as dataset_pos, count(*) as n, count(*) as reasons, 0::bigint as details, max(s_suppkey) as last_id from supplier
union all select 'customers', 1, count(*), 0, count(c_mktsegment), max(c_custkey) from customer"""


def runs_by_metric(s: SparkSession, d: str) -> DataFrame:
    """A report: the first five runs of each seed by best metric."""
    best = C.best_and_last(derive(s, d, CURVES)).withColumn("seed", (F.col("run") % 3).cast("int"))
    w = Window.partitionBy("seed").orderBy(F.desc("best"), "run")
    return _r(best.withColumn("place", F.row_number().over(w)).filter("place <= 5").select("seed", "place", "run", "best"), "best")


RUNS_SQL = with_tables("select seed, place, run, round(best, 6) as best from (select cast(run % 3 as int) as seed, run, best, row_number() over (partition by run % 3 order by best desc, run) as place from best) where place <= 5", curves=CURVES, best=_BEST)


def label_backfill(s: SparkSession, d: str) -> DataFrame:
    """By split: images, label files, images without a label (to be given an empty one), labels without an image."""
    images = derive(s, d, IMAGES).select("split", F.col("image_id").alias("stem"))
    labels = images.filter("stem % 6 != 1").unionByName(images.filter("stem % 50 = 0 and stem > 0").withColumn("stem", -F.col("stem")))
    return guards.backfill(images, labels)


BACKFILL_SQL = with_tables("""
select split, count(*) as images, (count(*) filter (where image_id % 6 <> 1) + count(*) filter (where image_id % 50 = 0 and image_id > 0))::bigint as labels,
       count(*) filter (where image_id % 6 = 1) as missing, count(*) filter (where image_id % 50 = 0 and image_id > 0) as orphans from images group by 1""", images=IMAGES)

QUERIES = {
    "pairs_by_scope": (pairs_by_scope, SCOPE_SQL), "near_dup_audit": (near_dup_audit, AUDIT_SQL), "added_matches": (added_matches, ADDED_SQL), "collision_gate": (collision_gate, COLLISION_SQL),
    "stem_groups": (stem_groups, STEM_SQL), "gap_change": (gap_change, GAP_SQL), "resume_deltas": (resume_deltas, RESUME_SQL), "key_statistics": (key_statistics, KEY_SQL),
    "latency_summary": (latency_summary, LATENCY_SQL), "input_ratio": (input_ratio, RATIO_SQL), "run_table": (run_table, RUN_TABLE_SQL), "cumulative_steps": (cumulative_steps, STEPS_SQL),
    "image_paths": (image_paths, PATHS_SQL), "manifest_join": (manifest_join, MANIFEST_SQL), "dataset_union": (dataset_union, UNION_SQL), "runs_by_metric": (runs_by_metric, RUNS_SQL),
    "label_backfill": (label_backfill, BACKFILL_SQL),
}
