"""Queries on boxes and detections, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.stats import linear_quantiles, quantiles
from ..operators import ap, association, matching
from ..sources.fixtures import BOXES, IMAGES, PREDICTIONS, derive, with_tables

SIZES = (320, 640, 1280)
EDGES = (8.0, 16.0, 32.0)


def _r(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def scene_category(s: SparkSession, d: str) -> DataFrame:
    got = derive(s, d, BOXES).groupBy("image_id").agg(F.collect_set("cls").alias("c"))
    at = derive(s, d, IMAGES).join(got, "image_id", "left")
    return at.groupBy("split", G.scene_category(F.coalesce("c", F.array().cast("array<int>"))).alias("category")).agg(F.count("*").alias("n"))


SCENE_SQL = with_tables("""
select split, case when f and m then 'both' when f then 'fire_only' when m then 'smoke_only' else 'none' end as category, count(*) as n from (
  select i.image_id, i.split, coalesce(bool_or(b.cls = 0), false) as f, coalesce(bool_or(b.cls = 1), false) as m from images i left join boxes b on i.image_id = b.image_id group by 1, 2)
group by 1, 2""", images=IMAGES, boxes=BOXES)  # fmt: skip


def _sized(s: SparkSession, d: str, sizes=SIZES) -> DataFrame:
    """Boxes with their long side in pixels of each square input."""
    at = derive(s, d, BOXES).join(derive(s, d, IMAGES), "image_id").withColumn("input", F.explode(F.array(*map(F.lit, sizes))))
    long_ = F.greatest(F.col("w") * F.col("width"), F.col("h") * F.col("height"))
    return at.withColumn("px", F.round(long_ * G.letterbox_scale(F.col("input"), F.col("width"), F.col("height")), 6))


_SIZED = """
select b.*, i.split, i.width, i.height, s.input, round(greatest(b.w * i.width, b.h * i.height) * (cast(s.input as double) / greatest(i.width, i.height)), 6) as px
from boxes b join images i on b.image_id = i.image_id cross join (values (320), (640), (1280)) s(input)
"""


def size_band_distribution(s: SparkSession, d: str) -> DataFrame:
    got = _sized(s, d).groupBy("split", "input", "cls").agg(F.count("*").alias("n"), *(F.sum((G.band(F.col("px"), EDGES) == k).cast("long")).alias(f"band{k}") for k in range(4)))
    return got.withColumn("tiny_share", F.round(F.col("band0") / F.col("n"), 6))


SIZE_BAND_SQL = with_tables("""
select split, input, cls, count(*) as n, count(*) filter (where px < 8) as band0, count(*) filter (where px >= 8 and px < 16) as band1,
       count(*) filter (where px >= 16 and px < 32) as band2, count(*) filter (where px >= 32) as band3, round(count(*) filter (where px < 8) / count(*), 6) as tiny_share
from sized group by 1, 2, 3""", images=IMAGES, boxes=BOXES, sized=_SIZED)


def resolvability(s: SparkSession, d: str) -> DataFrame:
    at = _sized(s, d, (640,)).withColumn("stride", F.explode(F.array(F.lit(4), F.lit(8), F.lit(16), F.lit(32))))
    cells = F.col("px") / F.col("stride")
    tag = F.when(cells < 1, "below_one").when(cells < 2, "below_two").otherwise("resolved")
    got = at.groupBy("split", "cls", "stride", tag.alias("tag")).agg(F.count("*").alias("n"))
    return got


RESOLVABILITY_SQL = with_tables("""
select split, cls, stride, case when px / stride < 1 then 'below_one' when px / stride < 2 then 'below_two' else 'resolved' end as tag, count(*) as n
from sized cross join (values (4), (8), (16), (32)) t(stride) where input = 640 group by 1, 2, 3, 4""", images=IMAGES, boxes=BOXES, sized=_SIZED)


def resolution_census(s: SparkSession, d: str) -> DataFrame:
    """Native resolutions by split and over all, in one pass; direction of the resize to 640."""
    at = derive(s, d, IMAGES).withColumn("bucket", G.long_side_bucket(F.greatest("width", "height"))).withColumn("direction", G.resize_direction(G.letterbox_scale(640, F.col("width"), F.col("height"))))
    return at.groupingSets([[F.col("split"), F.col("bucket"), F.col("direction")], [F.col("bucket"), F.col("direction")]], F.col("split"), F.col("bucket"), F.col("direction")).agg(F.count("*").alias("n"), F.sum(F.col("width") * F.col("height")).cast("long").alias("pixels"))


RESOLUTION_SQL = with_tables("""
select split, bucket, direction, count(*) as n, sum(px)::bigint as pixels from (
  select split, width * height as px, case when m <= 480 then '<=480' when m <= 720 then '481-720' when m <= 1080 then '721-1080' when m <= 1440 then '1081-1440' when m <= 1920 then '1441-1920' else '>1920' end as bucket,
         case when 640e0 / m > 1.02 then 'up' when 640e0 / m < 0.98 then 'down' else 'equal' end as direction from (select *, greatest(width, height) as m from images))
group by grouping sets ((split, bucket, direction), (bucket, direction))""", images=IMAGES)


def coco_area_shares(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    at = derive(s, d, BOXES).join(derive(s, d, IMAGES), "image_id")
    got = at.groupBy("split", "cls", G.coco_area(F.col("w") * F.col("width"), F.col("h") * F.col("height")).alias("bucket")).agg(F.count("*").alias("n"))
    share = lambda *by: F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*by)), 6)
    return got.withColumn("class_share", share("split", "cls")).withColumn("split_share", share("split"))


COCO_SQL = with_tables("""
select *, round(n / sum(n) over (partition by split, cls), 6) as class_share, round(n / sum(n) over (partition by split), 6) as split_share from (
  select split, cls, case when a < 1024 then 'small' when a < 9216 then 'medium' else 'large' end as bucket, count(*) as n
  from (select i.split, b.cls, (b.w * i.width) * (b.h * i.height) as a from boxes b join images i on b.image_id = i.image_id) group by 1, 2, 3)""", images=IMAGES, boxes=BOXES)


def iou_join(s: SparkSession, d: str) -> DataFrame:
    p = matching.overlaps(derive(s, d, BOXES), derive(s, d, PREDICTIONS))
    return p.filter("iou >= 0.1").select("image_id", "box_idx", "det_idx", F.round("iou", 6).alias("iou"))


_PAIRS = """
select b.image_id, b.box_idx, p.det_idx, b.cls as g_cls, p.cls as d_cls, p.conf, case when u > 0 then i / u else 0 end as iou from (
  select *, aw * ah + bw * bh - i as u from (
    select b.image_id as bi, b.box_idx as bb, p.det_idx as pd, b.w as aw, b.h as ah, p.w as bw, p.h as bh,
      greatest(0e0, least(b.x + b.w / 2, p.x + p.w / 2) - greatest(b.x - b.w / 2, p.x - p.w / 2)) * greatest(0e0, least(b.y + b.h / 2, p.y + p.h / 2) - greatest(b.y - b.h / 2, p.y - p.h / 2)) as i
    from boxes b join predictions p on b.image_id = p.image_id)) o
join boxes b on b.image_id = bi and b.box_idx = bb join predictions p on p.image_id = bi and p.det_idx = pd
"""
_T = dict(boxes=BOXES, predictions=PREDICTIONS, pairs=_PAIRS)
IOU_SQL = with_tables("select image_id, box_idx, det_idx, round(iou, 6) as iou from pairs where g_cls = d_cls and iou >= 0.1", **_T)


def two_pass_match(s: SparkSession, d: str) -> DataFrame:
    m = matching.two_pass_match(matching.overlaps(derive(s, d, BOXES), derive(s, d, PREDICTIONS)))
    return m.select("image_id", "box_idx", "det_idx", F.round("iou", 6).alias("iou"))


_MATCH = """
select * from (select *, row_number() over (partition by image_id, box_idx order by det_idx) as r2 from (
  select *, row_number() over (partition by image_id, det_idx order by iou desc, box_idx) as r1 from pairs where g_cls = d_cls and iou >= 0.5) where r1 = 1) where r2 = 1
"""
TWO_PASS_SQL = with_tables("select image_id, box_idx, det_idx, round(iou, 6) as iou from matched", **_T, matched=_MATCH)


def tp_by_iou(s: SparkSession, d: str) -> DataFrame:
    """Ground truth and true positives at four overlaps, by class and over all."""
    p = matching.overlaps(derive(s, d, BOXES), derive(s, d, PREDICTIONS))
    m = matching.two_pass_match(p).select("image_id", "box_idx", "iou")
    at = derive(s, d, BOXES).join(m, ["image_id", "box_idx"], "left")
    at = at.withColumn("cls", F.col("cls").cast("string"))
    return at.groupingSets([[F.col("cls")], []], F.col("cls")).agg(F.count("*").alias("n_gt"), *(F.count_if(F.col("iou") >= t).alias(f"tp{round(100 * t)}") for t in (0.5, 0.75, 0.9, 0.95))).withColumn("cls", F.coalesce("cls", F.lit("all")))


TP_SQL = with_tables("""
select coalesce(cast(b.cls as varchar), 'all') as cls, count(*) as n_gt, count(*) filter (where iou >= 0.5) as tp50, count(*) filter (where iou >= 0.75) as tp75, count(*) filter (where iou >= 0.9) as tp90, count(*) filter (where iou >= 0.95) as tp95
from boxes b left join matched m on b.image_id = m.image_id and b.box_idx = m.box_idx group by grouping sets ((b.cls), ())""", **_T, matched=_MATCH)


def fp_fn_reason(s: SparkSession, d: str) -> DataFrame:
    return matching.miss_reasons(derive(s, d, BOXES), derive(s, d, PREDICTIONS)).groupBy("cls", "reason").agg(F.count("*").alias("n"))


REASON_SQL = with_tables("""
select cls, case when same >= 0.5 then 'competing_sameclass_candidate' when other >= 0.5 then 'wrongclass_overlap' when same >= 0.1 then 'weak_localization_candidate' else 'no_close_sameclass_candidate' end as reason, count(*) as n
from (select b.image_id, b.box_idx, b.cls, max(case when g_cls = d_cls then iou end) as same, max(case when g_cls <> d_cls then iou end) as other
      from boxes b left join (select * from pairs where conf >= 0.25) p on b.image_id = p.image_id and b.box_idx = p.box_idx group by 1, 2, 3) x
where not exists (select 1 from matched m where m.image_id = x.image_id and m.box_idx = x.box_idx) group by 1, 2""", **_T, matched=_MATCH.replace("from pairs where", "from pairs where conf >= 0.25 and"))


def coverage_by_iou(s: SparkSession, d: str) -> DataFrame:
    best = matching.best_overlaps(derive(s, d, BOXES), derive(s, d, PREDICTIONS))
    return best.groupBy("cls").agg(F.count("*").alias("n_gt"), *(F.count_if(F.col("best") >= t).alias(f"at{round(100 * t)}") for t in (0.1, 0.5, 0.75)))


COVERAGE_SQL = with_tables("""
select cls, count(*) as n_gt, count(*) filter (where best >= 0.1) as at10, count(*) filter (where best >= 0.5) as at50, count(*) filter (where best >= 0.75) as at75
from (select b.image_id, b.box_idx, b.cls, max(iou) as best from boxes b left join (select * from pairs where g_cls = d_cls) p on b.image_id = p.image_id and b.box_idx = p.box_idx group by 1, 2, 3) group by 1""", **_T)


def greedy_match(s: SparkSession, d: str) -> DataFrame:
    got = matching.greedy_flags(derive(s, d, BOXES), derive(s, d, PREDICTIONS), [0.5, 0.75])
    return got.select("image_id", "cls", "threshold", "det_idx", "flag")


def _greedy_sql(steps: str) -> dict[str, str]:
    """Texts of a fold over an image's detections, a step of the recursion for each: what is used so far, and the place of the box that the last one took."""
    return {
        "det": "select *, row_number() over (partition by image_id, cls order by conf desc, det_idx) as k from predictions",
        "ov": "select d.image_id, d.cls, d.k, coalesce(list(p.iou order by p.box_idx) filter (where p.box_idx is not null), []) as m from det d left join (select * from pairs where g_cls = d_cls) p on p.image_id = d.image_id and p.det_idx = d.det_idx group by 1, 2, 3",
        "fold": f"""
select * from (with recursive g(image_id, cls, t, k, used, place) as (
  select image_id, cls, t, 0::bigint, []::bigint[], 0::bigint from (select distinct image_id, cls from det) cross join (values {steps}) x(t)
  union all
  select image_id, cls, t, k, case when hit then list_append(used, list_position(free, best)) else used end, case when hit then list_position(free, best) else 0 end from (
    select *, coalesce(best >= t and best >= 0, false) as hit from (
      select *, list_max(free) as best from (
        select g.image_id, g.cls, g.t, o.k, g.used, list_transform(o.m, lambda v, i: case when list_contains(g.used, i) then -1e0 else v end) as free
        from g join ov o on o.image_id = g.image_id and o.cls = g.cls and o.k = g.k + 1)))
) select image_id, cls, t, k, place from g where k > 0)""",
    }


GREEDY_SQL = with_tables("select f.image_id, f.cls, t as threshold, det_idx, cast(place > 0 as int) as flag from fold f join det d on d.image_id = f.image_id and d.cls = f.cls and d.k = f.k", **_T, **_greedy_sql("(0.5e0), (0.75e0)"))


def average_precision(s: SparkSession, d: str) -> DataFrame:
    """AP at 0.5 and 0.75 on the two-pass match."""
    boxes, found = derive(s, d, BOXES), derive(s, d, PREDICTIONS)
    hit = matching.two_pass_match(matching.overlaps(boxes, found)).select("image_id", "det_idx", "iou")
    each = found.join(hit, ["image_id", "det_idx"], "left").withColumn("t", F.explode(F.array(F.lit(0.5), F.lit(0.75))))
    flags = each.select("cls", "t", "conf", "image_id", "det_idx", F.coalesce((F.col("iou") >= F.col("t")).cast("int"), F.lit(0)).alias("flag"))
    totals = boxes.groupBy("cls").agg(F.count("*").alias("n_gt")).withColumn("t", F.explode(F.array(F.lit(0.5), F.lit(0.75))))
    return _r(ap.average_precision(flags, totals, ["cls", "t"]), "ap")


AP_SQL = with_tables("""
, flags as (select p.cls, t, p.conf, p.image_id, p.det_idx, case when m.iou >= t then 1 else 0 end as flag
  from predictions p left join matched m on p.image_id = m.image_id and p.det_idx = m.det_idx cross join (values (0.5e0), (0.75e0)) x(t)),
run as (select *, sum(flag) over w / row_number() over w as prec from flags window w as (partition by cls, t order by conf desc, image_id, det_idx rows unbounded preceding)),
env as (select *, max(prec) over (partition by cls, t order by conf desc, image_id, det_idx rows between current row and unbounded following) as e from run)
select g.cls, e.t, g.n_gt, round(sum(case when flag = 1 then e else 0 end) / g.n_gt, 6) as ap from (select cls, count(*) as n_gt from boxes group by 1) g join env e on e.cls = g.cls group by 1, 2, 3""".replace("\n, flags", ", flags", 1), **_T, matched=_MATCH).replace(")\n,", "),\n", 1)  # fmt: skip


def stratified_ap(s: SparkSession, d: str) -> DataFrame:
    sized = _sized(s, d, (640,)).select("image_id", "box_idx", "cls", "x", "y", "w", "h", F.col("px").alias("size"))
    bands = {"all": (0.0, float("inf")), "tiny": (0.0, 32.0), "small": (32.0, 128.0), "large": (128.0, float("inf"))}
    return _r(ap.stratified_ap(sized, derive(s, d, PREDICTIONS), bands, [0.5 + 0.05 * i for i in range(10)]), "ap50", "ap75", "ap")


_BANDS = "select * from (values ('all', 0e0, 'inf'::double), ('tiny', 0e0, 32e0), ('small', 32e0, 128e0), ('large', 128e0, 'inf'::double)) b(band, low, high)"
_STEPS = ", ".join(f"({0.5 + 0.05 * i!r}::double)" for i in range(10))
STRATIFIED_SQL = with_tables("""
, size as (select image_id, cls, list(px order by box_idx) as px from sized where input = 640 group by 1, 2),
flags as (select band, f.cls, f.t, conf, f.image_id, det_idx, case when place = 0 then 0 when px[place] >= low and px[place] < high then 1 else -1 end as flag
  from fold f join det d on d.image_id = f.image_id and d.cls = f.cls and d.k = f.k left join size s on s.image_id = f.image_id and s.cls = f.cls cross join band_),
run as (select *, sum(flag) over w / row_number() over w as prec, row_number() over w as n from flags where flag >= 0 window w as (partition by band, cls, t order by conf desc, image_id, det_idx rows unbounded preceding)),
env as (select band, cls, t, sum(case when flag = 1 then e else 0 end) as s from (select *, max(prec) over (partition by band, cls, t order by n desc rows unbounded preceding) as e from run) group by 1, 2, 3),
gt as (select band, cls, count(*) filter (where px >= low and px < high) as n_gt from sized cross join band_ where input = 640 group by 1, 2),
each as (select g.band, g.cls, n_gt, x.t, case when n_gt > 0 then coalesce(s, 0) / n_gt end as ap from gt g cross join (values """ + _STEPS + """) x(t) left join env e on e.band = g.band and e.cls = g.cls and e.t = x.t)
select band, cls, n_gt, round(max(ap) filter (where t = 0.5), 6) as ap50, round(max(ap) filter (where round(t, 2) = 0.75), 6) as ap75, round(case when n_gt > 0 then sum(ap) / 10 end, 6) as ap
from each group by band, cls, n_gt""", images=IMAGES, **_T, sized=_SIZED, **_greedy_sql(_STEPS),
    band_=_BANDS).replace(")\n\n, size", "),\nsize")


def score_iou_association(s: SparkSession, d: str) -> DataFrame:
    m = matching.two_pass_match(matching.overlaps(derive(s, d, BOXES), derive(s, d, PREDICTIONS)), 0.1)
    return _r(association.correlations(m.withColumn("q", F.round("iou", 6)), "conf", "q", ["g_cls"]), "pearson", "spearman")


ASSOCIATION_SQL = with_tables("""
select g_cls, count(*) as n, round(corr(conf, q), 6) as pearson, round(corr(rx, ry), 6) as spearman from (
  select *, rank() over (partition by g_cls order by conf) + (count(*) over (partition by g_cls, conf) - 1) / 2 as rx, rank() over (partition by g_cls order by q) + (count(*) over (partition by g_cls, q) - 1) / 2 as ry
  from (select *, round(iou, 6) as q from matched)) group by 1""", **_T, matched=_MATCH.replace("iou >= 0.5", "iou >= 0.1"))


def geometry_summary(s: SparkSession, d: str) -> DataFrame:
    at = _sized(s, d, (640,)).withColumn("short", F.round(F.least(F.col("w") * F.col("width"), F.col("h") * F.col("height")), 6))
    px = linear_quantiles(at, ["split", "cls"], "px", {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    counts = at.groupBy("split", "cls").agg(F.count_if(F.col("short") < 8).alias("short8"), F.count("*").alias("n"))
    return _r(px.join(counts, ["split", "cls"]), "p05", "p50", "p95")


GEOMETRY_SQL = with_tables("""
select split, cls, round(quantile_cont(px, 0.05), 6) as p05, round(quantile_cont(px, 0.5), 6) as p50, round(quantile_cont(px, 0.95), 6) as p95,
       count(*) filter (where round(least(w * width, h * height), 6) < 8) as short8, count(*) as n from sized where input = 640 group by 1, 2""", images=IMAGES, boxes=BOXES, sized=_SIZED)


def quantile_conventions(s: SparkSession, d: str) -> DataFrame:
    return _r(quantiles(_sized(s, d, (640,)), ["split", "cls"], "px", 0.9), "linear", "nearest", "floor_n", "upper_median", "floor_n1")


QUANTILE_SQL = with_tables("""
select split, cls, round(quantile_cont(px, 0.9), 6) as linear, max(px) filter (where k = round_even((n - 1) * 0.9e0, 0)) as nearest, max(px) filter (where k = least(n - 1, floor(n * 0.9e0))) as floor_n,
       max(px) filter (where k = floor(n / 2)) as upper_median, max(px) filter (where k = floor((n - 1) * 0.9e0)) as floor_n1
from (select *, row_number() over (partition by split, cls order by px) - 1 as k, count(*) over (partition by split, cls) as n from sized where input = 640) group by 1, 2""", images=IMAGES, boxes=BOXES, sized=_SIZED)

QUERIES = {
    "scene_category": (scene_category, SCENE_SQL), "size_band_distribution": (size_band_distribution, SIZE_BAND_SQL), "resolvability": (resolvability, RESOLVABILITY_SQL),
    "resolution_census": (resolution_census, RESOLUTION_SQL), "coco_area_shares": (coco_area_shares, COCO_SQL), "iou_join": (iou_join, IOU_SQL), "two_pass_match": (two_pass_match, TWO_PASS_SQL),
    "tp_by_iou": (tp_by_iou, TP_SQL), "fp_fn_reason": (fp_fn_reason, REASON_SQL), "coverage_by_iou": (coverage_by_iou, COVERAGE_SQL), "greedy_match": (greedy_match, GREEDY_SQL),
    "average_precision": (average_precision, AP_SQL), "stratified_ap": (stratified_ap, STRATIFIED_SQL), "score_iou_association": (score_iou_association, ASSOCIATION_SQL),
    "geometry_summary": (geometry_summary, GEOMETRY_SQL), "quantile_conventions": (quantile_conventions, QUANTILE_SQL),
}
