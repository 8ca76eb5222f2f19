"""Queries that are whole reports, flattened documents and the online index, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import shared
from ..operators import alarms, reports, splits
from ..sources.fixtures import BOXES, CURVES, IMAGES, MARKS_64, MARKS_DUCKDB, PREDICTIONS, derive, in_64, read, with_tables
from ..sources.readers import json_leaves
from ..streaming import index
from .audits import RUN_TABLE_SQL, run_table
from .content import _NEAR, RADIUS
from .detection import _SIZED, _r, _sized

INPUTS = (320, 640, 1280)
_COPIES = "select * from own union all select id + 1000000, 'test', hash from own where id % 20 = 7"


def _marks(s: SparkSession, d: str) -> DataFrame:
    """Fingerprints over all 64 signs; one in twenty has a copy in test."""
    own = derive(s, d, MARKS_64)
    return own.unionByName(own.filter("id % 20 = 7").select((F.col("id") + 1000000).alias("id"), F.lit("test").alias("split"), "hash"))


def split_integrity_report(s: SparkSession, d: str) -> DataFrame:
    """One table of what can be wrong with splits: resolutions, copies, near copies, leaks, frames, sizes, each with its level."""
    images = derive(s, d, IMAGES)
    frames = images.select(F.col("image_id").alias("id"), "split", (F.col("scene") % 50).alias("prefix"), (F.col("image_id") % 5000).alias("number"))
    marks = _marks(s, d).withColumn("sha", F.expr("md5(cast(hash as string))"))
    return _r(splits.split_report(images, _sized(s, d, INPUTS), marks, frames, RADIUS, INPUTS), "value")


SPLIT_REPORT_SQL = in_64(with_tables("""
, sizes as (select width, height, count(*) as n from images group by 1, 2),
top as (select greatest(width, height) as side, n from sizes order by n desc, width, height limit 1),
sym as (select a, b from near union select b, a from near),
total as (select split, count(*) as total from marks group by 1),
leak as (select x.split as a, y.split as b, coalesce(m, 0) / x.total as rate from total x cross join total y
  left join (select p.split as sa, q.split as sb, count(distinct a) as m from sym join marks p on p.id = a join marks q on q.id = b group by 1, 2) on sa = x.split and sb = y.split),
groups as (select count(*) as n, count(distinct split) as k, min(split) as s from marks group by hash having count(*) > 1),
frames as (select image_id as id, split, scene % 50 as prefix, image_id % 5000 as number from images),
size as (select split, input, cls, count(*) as n, avg(case when px < 16 then 1e0 else 0e0 end) as b8, avg(case when px < 8 then 1e0 else 0e0 end) as b4 from sized group by 1, 2, 3),
rows_ as (
  select 'resolution' as section, 'distinct' as key, count(*)::double as value, null as level from sizes union all select 'resolution', 'images', sum(n), null from sizes
  union all select 'resolution', 'longest', max(greatest(width, height)), null from sizes union all select 'resolution', 'share', (select n from top) / sum(n), null from sizes
  union all select 'resolution', 'median_side', quantile_cont(greatest(width, height)::double, 0.5), null from images
  union all select 'upsampling', i::varchar, i / side::double, case when i / side::double > 1.5 then 'warn' when i / side::double > 1.02 then 'info' end from top cross join (values (320), (640), (1280)) t(i)
  union all select 'exact', 'groups', count(*), null from groups union all select 'exact', 'pairs', coalesce(sum(n * (n - 1) / 2), 0), null from groups
  union all select 'exact', 'within_train', coalesce(sum(n - 1), 0), case when coalesce(sum(n - 1), 0) > 0 then 'warn' else 'info' end from groups where k = 1 and s = 'train'
  union all select 'near', 'pairs', count(*), null from near
  union all select 'leak', a || '->' || b, rate, case when rate >= 0.1 then 'error' when rate >= 0.03 then 'warn' else 'info' end from leak where a <> b
  union all select 'within', a, rate, null from leak where a = b
  union all select 'duplicate_in_train', m.split, count(*) filter (where exists (select 1 from sym e join marks t on t.id = e.b and t.split = 'train' where e.a = m.id)), null from marks m where m.split <> 'train' group by 2
  union all select 'frames', 'pairs', count(*), case when count(*) > 0 then 'warn' else 'info' end from frames a join frames b on a.prefix = b.prefix and a.id < b.id and a.split <> b.split and abs(a.number - b.number) <= 3
  union all select 'size', concat_ws(' ', split, input, cls, 'n'), n, null from size
  union all select 'size', concat_ws(' ', split, input, cls, 'below_8'), b8, case when split = 'val' then case when b8 >= 0.15 then 'info' else 'warn' end end from size
  union all select 'size', concat_ws(' ', split, input, cls, 'below_4'), b4, null from size)
select section, key, round(value, 6) as value, level from rows_""", own=MARKS_DUCKDB, marks=_COPIES, near=_NEAR, images=IMAGES, boxes=BOXES, sized=_SIZED).replace(")\n\n, sizes", "),\nsizes"))  # fmt: skip

WINDOWS = [("early", 1, 10), ("middle", 11, 30), ("late", 25, 49)]


def curve_report(s: SparkSession, d: str) -> DataFrame:
    """Each run in one row: best and last epoch, slope at the end, means of windows, epochs that are missing (those under 20 are taken out)."""
    got = splits.curve_report(derive(s, d, CURVES).filter("metric >= 20").select("run", "epoch", "metric"), WINDOWS, 40)
    return _r(got, "best", "last", "slope", "early", "middle", "late")


CURVE_REPORT_SQL = with_tables("""
select run, max(epoch) filter (where b = 1) as best_epoch, round(max(metric) filter (where b = 1), 6) as best, max(epoch) as last_epoch, round(max(metric) filter (where l = 1), 6) as last, count(*) as n,
       round(case when count(*) filter (where l <= 10) >= 3 then regr_slope(metric, epoch) filter (where l <= 10) end, 6) as slope, round(avg(metric) filter (where epoch between 1 and 10), 6) as early,
       round(avg(metric) filter (where epoch between 11 and 30), 6) as middle, round(avg(metric) filter (where epoch between 25 and 49), 6) as late, (max(epoch) - count(*))::bigint as missing, count(*) >= 40 as complete
from (select *, row_number() over (partition by run order by metric desc, epoch) as b, row_number() over (partition by run order by epoch desc) as l from curves where metric >= 20) group by 1""", curves=CURVES)


def run_report(s: SparkSession, d: str) -> DataFrame:
    """Runs with settings and cost, and the frontier of each batch size: the best that no cheaper run reaches."""
    runs = run_table(s, d)
    return splits.run_report(runs.withColumn("family", F.coalesce("batch", F.lit(-1))), "gflops", "best", ["family"])


RUN_REPORT_SQL = f"""
with t as ({RUN_TABLE_SQL})
select *, coalesce(batch, -1) as family, gflops is not null and coalesce(best > max(best) over (partition by coalesce(batch, -1), gflops is null order by gflops, best desc, run rows between unbounded preceding and 1 preceding),
  row_number() over (partition by coalesce(batch, -1), gflops is null order by gflops, best desc, run) = 1) as frontier from t"""


def json_key_statistics(s: SparkSession, d: str) -> DataFrame:
    """Numbers of nested documents, one for each of three seeds, by their flattened names; their deviation between seeds."""
    c = read(s, d, "customer").withColumn("seed", (F.col("c_custkey") % 3).cast("int"))
    one = c.groupBy("seed", "c_mktsegment").agg(F.count("*").alias("n"), F.max("c_custkey").alias("most"), F.min("c_nationkey").alias("least"))
    keys = F.struct(F.col("n").alias("n"), F.struct(F.struct(F.col("most").alias("most"), F.lit("text").alias("name")).alias("keys"), F.array(F.col("least"), F.lit(None).cast(one.schema["least"].dataType)).alias("of")).alias("inner"))
    doc = one.groupBy("seed").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("c_mktsegment", keys))).alias("segments"), F.array(F.array(F.sum("n"))).alias("sum"), F.lit(True).alias("flag"))).alias("doc"))
    values = json_leaves(doc, "doc", "seed").select("seed", F.col("path").alias("metric"), "value")
    got = values.groupBy("metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    return _r(got, "mean", "sd")


JSON_SQL = """
with c as (select c_custkey % 3 as seed, c_mktsegment as g, count(*) as n, max(c_custkey) as most, min(c_nationkey) as least from customer group by 1, 2),
v as (select seed, 'segments.' || g || '.n' as metric, n::double as value from c union all select seed, 'segments.' || g || '.inner.keys.most', most from c
      union all select seed, 'segments.' || g || '.inner.of[0]', least from c union all select seed, 'sum[0][0]', sum(n) from c group by 1)
select metric, count(*) as n, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as sd from v group by 1"""


def online_near_links(s: SparkSession, d: str) -> DataFrame:
    """Fingerprints as a stream of three batches, each asked for near ones among all that came before and then added: links between classes, and how many copies a class has."""
    marks = _marks(s, d).select("id", "hash", F.col("split").alias("place"))
    at = f"{shared(s).rstrip('/')}/siftline-online-{uuid.uuid4().hex[:12]}"
    most = marks.agg(F.max("id")).first()[0] or 0
    provider, key = s.conf.get("spark.sql.streaming.stateStore.providerClass"), "spark.sql.streaming.stateStore.providerClass"
    index.with_state(s)
    try:
        for k in range(3):
            marks.filter((F.col("id") * 3 >= k * (most + 1)) & (F.col("id") * 3 < (k + 1) * (most + 1))).write.mode("append").parquet(f"{at}/in")
            rows = s.readStream.schema(marks.schema).parquet(f"{at}/in")
            out = index.near_links(rows, RADIUS).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/check").trigger(availableNow=True).start()
            out.awaitTermination()
    finally:
        s.conf.set(key, provider)
    got = s.read.schema(index.LINKS).parquet(f"{at}/out")
    many = got.filter("kind = 'copies'").groupBy("kind", "a").agg(F.sum("n").alias("n")).select("kind", "a", F.lit(None).cast("long").alias("b"), F.lit(0).alias("distance"), "n")
    return got.filter("kind = 'link'").unionByName(many)


ONLINE_SQL = in_64(with_tables(f"""
, cls as (select hash, min(id) as a, count(*) as n from marks group by 1)
select 'link' as kind, least(x.a, y.a) as a, greatest(x.a, y.a) as b, bit_count(xor(x.hash, y.hash))::int as distance, 1::bigint as n from cls x join cls y on x.a < y.a where bit_count(xor(x.hash, y.hash)) <= {RADIUS}
union all select 'copies', a, null, 0, n - 1 from cls where n > 1""", own=MARKS_DUCKDB, marks=_COPIES).replace(")\n\n, cls", "),\ncls"))

EPOCHS = [1, 5, 10, 20, 30, 40]


def ladder_report(s: SparkSession, d: str) -> DataFrame:
    """Seeds 1 and 2 of each configuration, whose epochs have more steps, against seed 0 at the same epoch and at the closest step."""
    c = derive(s, d, CURVES).select("config", F.col("seed").alias("rung"), "epoch", (F.col("epoch") * (7 + 4 * F.col("seed"))).alias("step"), "metric")
    return _r(splits.ladder_report(c, 0, EPOCHS, ["config"]), "base", "other", "delta")


LADDER_SQL = with_tables("""
, c as (select config, seed as rung, epoch, epoch * (7 + 4 * seed) as step, metric from curves),
l as (select b.config, r.rung, b.epoch, b.step, b.metric as base from c b join (select distinct config, rung from c where rung <> 0) r on r.config = b.config where b.rung = 0 and b.epoch in (1, 5, 10, 20, 30, 40)),
m as (select l.*, 'epoch' as kind, c.metric as other from l left join c on c.config = l.config and c.rung = l.rung and c.epoch = l.epoch
  union all select config, rung, epoch, step, base, 'step', other from (
    select l.*, c.metric as other, row_number() over (partition by l.config, l.rung, l.epoch order by abs(c.step - l.step), c.epoch) as r from l join c on c.config = l.config and c.rung = l.rung) where r = 1)
select config, rung, kind, epoch, step, round(base, 6) as base, round(other, 6) as other, round(100 * (other - base), 6) as delta from m""", curves=CURVES).replace(")\n\n, c as", "),\nc as")


def version_counts(s: SparkSession, d: str) -> DataFrame:
    """Images of each split by the classes in them, and boxes by class."""
    box = F.collect_list(F.struct("cls", "x", "y", "w", "h")).alias("boxes")
    boxes = derive(s, d, BOXES).groupBy("image_id").agg(box)
    at = derive(s, d, IMAGES).join(boxes, "image_id", "left").withColumn("boxes", F.coalesce("boxes", F.array().cast(boxes.schema["boxes"].dataType)))
    return splits.version_counts(at)


VERSION_SQL = with_tables("""
select split, count(*) as images, count(*) filter (where a = 0 and b = 0) as background, count(*) filter (where a > 0 and b = 0) as first_only, count(*) filter (where a = 0 and b > 0) as second_only,
       count(*) filter (where a > 0 and b > 0) as both, sum(a)::bigint as first_boxes, sum(b)::bigint as second_boxes
from (select i.image_id, any_value(split) as split, count(*) filter (where cls = 0) as a, count(*) filter (where cls = 1) as b from images i left join boxes b on b.image_id = i.image_id group by 1) group by 1""", images=IMAGES, boxes=BOXES)



def background_penalty(s: SparkSession, d: str) -> DataFrame:
    """Two highest logits of each class on images without boxes."""
    return _r(alarms.background_penalty(derive(s, d, IMAGES), derive(s, d, BOXES), derive(s, d, PREDICTIONS), 2), "penalty")


PENALTY_SQL = with_tables("""
select cls, count(*) as n, round(avg(-ln(1 - greatest(1e-6, least(1 - 1e-6, conf)))), 6) as penalty from (
  select p.*, row_number() over (partition by image_id, cls order by conf desc, det_idx) as k from predictions p where image_id in (select image_id from images) and image_id not in (select image_id from boxes)) where k <= 2 group by 1""",
    images=IMAGES, boxes=BOXES, predictions=PREDICTIONS)

_LAYERS = """
select p_brand as family, cast(8 * (1 + p_partkey % 16) as bigint) as cin, cast(case when p_partkey % 4 = 0 then 8 * (1 + p_partkey % 16) else 16 * (1 + p_size % 8) end as bigint) as cout, cast(1 + 2 * (p_size % 3) as bigint) as kernel,
       cast(20 * (1 + p_partkey % 8) as bigint) as side, cast(case when p_partkey % 4 = 0 then 8 * (1 + p_partkey % 16) else 1 end as bigint) as groups, p_size % 2 = 0 as bias, cast(1 + p_partkey % 2 as bigint) as copies from {part}
"""


def layer_budget(s: SparkSession, d: str) -> DataFrame:
    """Parameters and multiplications of layers, one for each part, by brand."""
    return reports.layer_budget(derive(s, d, _LAYERS), ["family"])


LAYER_SQL = with_tables("""
select family, sum(copies * (cin * cout * kernel * kernel // groups + case when bias then cout else 0 end))::bigint as parameters, sum(copies * (cin * cout * kernel * kernel // groups) * side * side)::bigint as macs from layers group by 1""", layers=_LAYERS)

QUERIES = {
    "background_penalty": (background_penalty, PENALTY_SQL), "layer_budget": (layer_budget, LAYER_SQL),
    "ladder_report": (ladder_report, LADDER_SQL), "version_counts": (version_counts, VERSION_SQL),
    "split_integrity_report": (split_integrity_report, SPLIT_REPORT_SQL), "curve_report": (curve_report, CURVE_REPORT_SQL), "run_report": (run_report, RUN_REPORT_SQL),
    "json_key_statistics": (json_key_statistics, JSON_SQL), "online_near_links": (online_near_links, ONLINE_SQL),
}
