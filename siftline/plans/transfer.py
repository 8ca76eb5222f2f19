"""Queries on calibration, transfer, effects and strata, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import alarms as A
from ..operators import ap, matching, reports
from ..sources.fixtures import BOXES, IMAGES, PREDICTIONS, SCORES, derive, with_tables
from .alarms import _P, _Q, _TH, BUDGET, _scores, calibrated_report
from .detection import _BANDS, _MATCH, _SIZED, _STEPS, _T, _greedy_sql, _r, _sized
from .reports import _C, _categorised, _matched

_FIT = f"""
select cls, t from (select *, row_number() over (partition by cls order by round(nll, 12), k) as r from (
  select cls, k, t, avg(-case when label = 1 then ln(p) else ln(1 - p) end) as nll from (
    select cls, label, k, t, greatest(1e-12, least(1 - 1e-12, {_P})) as p from (select cls, label, {_Q} as q from scores where split = 'val')
    cross join (select cast(i as int) as k, pow(10e0, -1e0 + 2 * i / 400e0) as t from range(401) r(i))) group by 1, 2, 3)) where r = 1
"""
_SCALED = f"select image_id, s.cls, label, split, {_P.replace('q / (1 - q)', '(' + _Q + ') / (1 - ' + _Q + ')')} as score from scores s join fit on s.cls = fit.cls"
_THRESHOLD = """
select cls, threshold from (select *, row_number() over (partition by cls order by recall desc, fpr, threshold desc) as r from (
  select cls, score as threshold, tp / pos as recall, fp / neg as fpr from (
    select cls, score, sum(p) over w as tp, sum(n) over w as fp, sum(p) over (partition by cls) as pos, sum(n) over (partition by cls) as neg
    from (select cls, score, sum(label) as p, sum(1 - label) as n from {rows} group by 1, 2) window w as (partition by cls order by score desc rows unbounded preceding))
  union all select distinct cls, 1.0000000000000002e0, 0e0, 0e0 from {rows}) where fpr <= {budget}) where r = 1
"""
_ECE = """
select cls, sum(n * abs(p - y)) / sum(n) as ece, sum(sq) / sum(n) as brier from (
  select cls, least(floor(score * 15), 14) as b, count(*) as n, avg(score) as p, avg(label) as y, sum(pow(score - label, 2)) as sq from {rows} where split = 'test' group by 1, 2) group by 1
"""


def calibration_before_after(s: SparkSession, d: str) -> DataFrame:
    """Fitted on val, reported on test: calibration errors before and after scaling, alarms after."""
    got = A.calibration_report(_scores(s, d, "val"), _scores(s, d, "test"), BUDGET)
    return _r(got, "temperature", "threshold", "ece_before", "brier_before", "ece_after", "brier_after", "recall", "fpr")


BEFORE_AFTER_SQL = with_tables("""
select f.cls, round(t, 6) as temperature, round(threshold, 6) as threshold, round(b.ece, 6) as ece_before, round(b.brier, 6) as brier_before, round(a.ece, 6) as ece_after, round(a.brier, 6) as brier_after,
       round(m.recall, 6) as recall, round(m.fpr, 6) as fpr
from fit f join cal c on f.cls = c.cls join before_ b on b.cls = f.cls join after_ a on a.cls = f.cls
join (select s.cls, avg(case when label = 1 then cast(score >= threshold as int) end) as recall, avg(case when label = 0 then cast(score >= threshold as int) end) as fpr
      from scaled s join cal on cal.cls = s.cls where split = 'test' group by 1) m on m.cls = f.cls""",
    scores=SCORES, fit=_FIT, scaled=_SCALED, cal=_THRESHOLD.replace("{rows}", "(select * from scaled where split = 'val')").replace("{budget}", str(BUDGET)), before_=_ECE.replace("{rows}", "scores"), after_=_ECE.replace("{rows}", "scaled"))


def _image_rows(s: SparkSession, d: str) -> DataFrame:
    return A.image_scores(derive(s, d, IMAGES), derive(s, d, BOXES), derive(s, d, PREDICTIONS))


_ROWS = """
select i.image_id, i.split, i.width, i.height, c.cls, coalesce(m, 0e0) as score, case when exists (select 1 from boxes b where b.image_id = i.image_id and b.cls = c.cls) then 1 else 0 end as label
from images i cross join (values (0), (1)) c(cls) left join (select image_id, cls, max(conf) as m from predictions group by 1, 2) p on p.image_id = i.image_id and p.cls = c.cls
"""
_LIMITS = _THRESHOLD.replace("{rows}", "(select * from scored where split = 'val')").replace("{budget}", str(BUDGET))
_D = dict(images=IMAGES, boxes=BOXES, predictions=PREDICTIONS, scored=_ROWS, limits=_LIMITS)


def _limits(s: SparkSession, d: str) -> DataFrame:
    return A.threshold_under_budget(_image_rows(s, d).filter("split = 'val'"), BUDGET)


def background_boxes(s: SparkSession, d: str) -> DataFrame:
    """False boxes an image without boxes has at thresholds of val."""
    test = derive(s, d, IMAGES).filter("split = 'test'")
    return _r(A.background_boxes(test, derive(s, d, BOXES), derive(s, d, PREDICTIONS), _limits(s, d)), "per_image")


BACKGROUND_BOXES_SQL = with_tables("""
select count(*) as n_background, coalesce(sum(k), 0)::bigint as false_boxes, round(coalesce(sum(k), 0) / count(*), 6) as per_image from images i
left join (select image_id, count(*) as k from predictions p join limits l on p.cls = l.cls where conf >= threshold group by 1) x on x.image_id = i.image_id
where split = 'test' and not exists (select 1 from boxes b where b.image_id = i.image_id)""", **_D)


def _alarming(s: SparkSession, d: str) -> DataFrame:
    at = _image_rows(s, d).filter("split = 'test'").join(_limits(s, d).select("cls", "threshold"), "cls")
    hit = (F.col("score") >= F.col("threshold")).cast("int")
    return at.groupBy("image_id").agg(F.max("label").alias("any"), F.max(hit).alias("alarm"))


def alarm_by_resolution(s: SparkSession, d: str) -> DataFrame:
    """Alarms on test images without boxes, by range of their long side."""
    size = derive(s, d, IMAGES).select("image_id", G.long_side_bucket(F.greatest("width", "height"), G.CENSUS).alias("bucket"))
    return _r(reports.alarm_by(_alarming(s, d).join(size, "image_id"), ["bucket"]), "rate")


ALARM_RESOLUTION_SQL = with_tables("""
select case when m <= 416 then '<=416' when m <= 640 then '417-640' when m <= 960 then '641-960' when m <= 1280 then '961-1280' when m <= 1920 then '1281-1920' else '>1920' end as bucket,
       count(*) as n, sum(alarm)::bigint as alarms, round(sum(alarm) / count(*), 6) as rate
from (select image_id, max(greatest(width, height)) as m, max(label) as l, max(cast(score >= threshold as int)) as alarm from scored s join limits t on s.cls = t.cls where split = 'test' group by 1) where l = 0 group by 1""", **_D)

_NAME = "concat('dir/', case when image_id % 4 = 0 then 'fire_' when image_id % 4 = 1 then 'bothFireAndSmoke_' when image_id % 4 = 2 then 'x9_' else '' end, image_id, '.jpg')"


def recall_by_name(s: SparkSession, d: str) -> DataFrame:
    """Image-level recall by the category that file names tell."""
    at = _image_rows(s, d).filter("split = 'test'").join(_limits(s, d).select("cls", "threshold"), "cls")
    named = at.withColumn("category", reports.name_category(F.expr(_NAME))).withColumn("hit", (F.col("score") >= F.col("threshold")).cast("double"))
    return _r(named.filter("label = 1").groupBy("category", "cls").agg(F.count("*").alias("n"), F.avg("hit").alias("recall")), "recall")


RECALL_NAME_SQL = with_tables("""
select case when image_id % 4 = 0 then 'fire' when image_id % 4 = 1 then 'bothFireAndSmoke' else '(other)' end as category, s.cls, count(*) as n, round(avg(cast(score >= threshold as int)), 6) as recall
from scored s join limits t on s.cls = t.cls where split = 'test' and label = 1 group by 1, 2""", **_D)


def zero_shot_transfer(s: SparkSession, d: str) -> DataFrame:
    """Thresholds of the source's val, on it and on the target's test, side by side."""
    val = _scores(s, d, "val")
    return _r(A.transfer(val, _scores(s, d, "test"), A.threshold_under_budget(val, BUDGET)), "source_recall", "source_fpr", "target_recall", "target_fpr")


def _rates(split: str, name: str) -> str:
    return f"round(avg(case when split = '{split}' and label = 1 then cast(score >= threshold as int) end), 6) as {name}_recall, round(avg(case when split = '{split}' and label = 0 then cast(score >= threshold as int) end), 6) as {name}_fpr"


TRANSFER_SQL = with_tables(f"select s.cls, {_rates('val', 'source')}, {_rates('test', 'target')} from scores s join th on s.cls = th.cls group by 1", scores=SCORES, th=_TH)


def module_effects(s: SparkSession, d: str) -> DataFrame:
    """Configurations (four) and seeds (three) at shared thresholds: nine endpoints against each configuration's parent."""
    rows = _scores(s, d, "test").withColumns({"config": (F.floor(F.col("image_id") / 2) % 4).cast("int"), "seed": (F.floor(F.col("image_id") / 8) % 3).cast("int")})
    values = A.endpoints(rows, A.threshold_under_budget(_scores(s, d, "val"), BUDGET), ["config", "seed"])
    parents = s.createDataFrame([(1, 0), (2, 0), (3, 2)], "config int, parent int")
    return _r(A.effects_by_endpoint(values, parents), "effect", "sd", "mdd")


EFFECTS_SQL = with_tables("""
select a.config, parent, a.endpoint, count(*) as n, round(avg(a.value - b.value), 6) as effect, round(stddev_samp(a.value - b.value), 6) as sd,
       round(case when count(*) > 1 and stddev_samp(a.value - b.value) > 0 then case count(*) when 2 then 12.706e0 else 4.303e0 end * stddev_samp(a.value - b.value) / sqrt(count(*)) end, 6) as mdd
from vals a join (values (1, 0), (2, 0), (3, 2)) p(config, parent) on a.config = p.config join vals b on b.config = p.parent and b.seed = a.seed and b.endpoint = a.endpoint group by 1, 2, 3""",
    scores=SCORES, th=_TH, rows_="select s.*, cast(floor(image_id / 2) % 4 as int) as config, cast(floor(image_id / 8) % 3 as int) as seed, cast(score >= threshold as int) as hit from scores s join th on s.cls = th.cls where split = 'test'",
    vals="""
select * from (
  select config, seed, 'recall_' || cls as endpoint, avg(case when label = 1 then hit end) as value from rows_ group by config, seed, cls
  union all select config, seed, 'fpr_' || cls, avg(case when label = 0 then hit end) from rows_ group by config, seed, cls
  union all select config, seed, 'ece_' || cls, sum(n * abs(p - y)) / sum(n) from (select config, seed, cls, least(floor(score * 15), 14) as b, count(*) as n, avg(score) as p, avg(label) as y from rows_ group by 1, 2, 3, 4) group by config, seed, cls
  union all select config, seed, 'brier_' || cls, avg(pow(score - label, 2)) from rows_ group by config, seed, cls
  union all select config, seed, 'background_alarm', avg(alarm) from (select config, seed, image_id, max(label) as l, max(hit) as alarm from rows_ group by 1, 2, 3) where l = 0 group by 1, 2) where value is not null""")  # fmt: skip

BANDS = {"all": (0.0, float("inf")), "tiny": (0.0, 32.0), "small": (32.0, 128.0), "large": (128.0, float("inf"))}


def cross_domain_strata(s: SparkSession, d: str) -> DataFrame:
    """Stratified AP in two domains (val, test), the share of each band's boxes, and the difference."""
    where = derive(s, d, IMAGES).filter("split != 'train'").select("image_id", F.col("split").alias("domain"))
    boxes = _sized(s, d, (640,)).select("image_id", "box_idx", "cls", "x", "y", "w", "h", F.col("px").alias("size")).join(where, "image_id")
    got = ap.stratified_ap(boxes, derive(s, d, PREDICTIONS).join(where, "image_id"), BANDS, [0.5 + 0.05 * i for i in range(10)], by=("domain",))
    pick = lambda d_, c: F.max(F.when(F.col("domain") == d_, F.col(c)))
    wide = got.groupBy("band", "cls").agg(*(pick(n, c).alias(f"{n}_{a}") for n in ("val", "test") for c, a in (("n_gt", "n"), ("ap", "ap"))))
    whole = wide.filter("band = 'all'").select("cls", F.col("val_n").alias("_v"), F.col("test_n").alias("_t"))
    at = wide.join(whole, "cls").withColumn("val_share", F.try_divide("val_n", "_v")).withColumn("test_share", F.try_divide("test_n", "_t")).drop("_v", "_t")
    return _r(at.withColumn("delta", F.col("test_ap") - F.col("val_ap")), "val_ap", "test_ap", "val_share", "test_share", "delta")


CROSS_SQL = with_tables("""
, domain as (select image_id, split as domain from images where split <> 'train'),
size as (select image_id, cls, list(px order by box_idx) as px from sized where input = 640 group by 1, 2),
flags as (select domain, band, f.cls, f.t, conf, f.image_id, det_idx, case when place = 0 then 0 when px[place] >= low and px[place] < high then 1 else -1 end as flag
  from fold f join domain o on o.image_id = f.image_id join det d on d.image_id = f.image_id and d.cls = f.cls and d.k = f.k left join size s on s.image_id = f.image_id and s.cls = f.cls cross join band_),
run as (select *, sum(flag) over w / row_number() over w as prec, row_number() over w as n from flags where flag >= 0 window w as (partition by domain, band, cls, t order by conf desc, image_id, det_idx rows unbounded preceding)),
env as (select domain, band, cls, t, sum(case when flag = 1 then e else 0 end) as s from (select *, max(prec) over (partition by domain, band, cls, t order by n desc rows unbounded preceding) as e from run) group by 1, 2, 3, 4),
gt as (select domain, band, cls, count(*) filter (where px >= low and px < high) as n_gt from sized join domain using (image_id) cross join band_ where input = 640 group by 1, 2, 3),
each as (select g.domain, g.band, g.cls, any_value(n_gt) as n_gt, sum(coalesce(s, 0)) / nullif(any_value(n_gt), 0) / 10 as ap from gt g left join env e on e.domain = g.domain and e.band = g.band and e.cls = g.cls group by 1, 2, 3),
wide as (select band, cls, max(n_gt) filter (where domain = 'val') as val_n, max(case when n_gt > 0 then ap end) filter (where domain = 'val') as val_ap,
                max(n_gt) filter (where domain = 'test') as test_n, max(case when n_gt > 0 then ap end) filter (where domain = 'test') as test_ap from each group by 1, 2)
select w.band, w.cls, w.val_n, round(w.val_ap, 6) as val_ap, w.test_n, round(w.test_ap, 6) as test_ap, round(w.val_n / nullif(a.val_n, 0), 6) as val_share, round(w.test_n / nullif(a.test_n, 0), 6) as test_share, round(w.test_ap - w.val_ap, 6) as delta
from wide w join wide a on a.cls = w.cls and a.band = 'all'""", images=IMAGES, **_T, sized=_SIZED, **_greedy_sql(_STEPS), band_=_BANDS).replace(")\n\n, domain", "),\ndomain")  # fmt: skip


def tp_by_band(s: SparkSession, d: str) -> DataFrame:
    """Boxes and true positives at two overlaps, by class and size band."""
    at = _categorised(s, d).join(_matched(s, d).select("image_id", "box_idx", "iou"), ["image_id", "box_idx"], "left")
    return at.groupBy("cls", "band").agg(F.count("*").alias("n_gt"), F.count_if(F.col("iou") >= 0.5).alias("tp50"), F.count_if(F.col("iou") >= 0.75).alias("tp75"))


TP_BAND_SQL = with_tables("""
select cls, band, count(*) as n_gt, count(*) filter (where iou >= 0.5) as tp50, count(*) filter (where iou >= 0.75) as tp75
from categorised c left join matched m on m.image_id = c.image_id and m.box_idx = c.box_idx group by 1, 2""", **_C)


def ranking_conflicts(s: SparkSession, d: str) -> DataFrame:
    return reports.ranking_conflicts(derive(s, d, BOXES), derive(s, d, PREDICTIONS).filter("conf >= 0.25"))


CONFLICT_SQL = with_tables("""
, same as (select q.*, p.x as px, p.y as py, p.w as pw, p.h as ph, b.x, b.y, b.w, b.h from pairs q join predictions p on p.image_id = q.image_id and p.det_idx = q.det_idx
  join boxes b on b.image_id = q.image_id and b.box_idx = q.box_idx where g_cls = d_cls and q.conf >= 0.25)
select g.cls, n_gt, coalesce(with_good, 0) as with_good, coalesce(conflicts, 0) as conflicts, coalesce(multi, 0) as multi from (select cls, count(*) as n_gt from boxes group by 1) g
left join (select g_cls, count(*) filter (where best >= 0.75) as with_good, count(*) filter (where best >= 0.75 and first < 0.75) as conflicts from (
  select image_id, box_idx, g_cls, max(iou) as best, (array_agg(iou order by conf desc, det_idx) filter (where iou >= 0.1))[1] as first from same group by 1, 2, 3) group by 1) a on a.g_cls = g.cls
left join (select d_cls, count(*) filter (where k >= 2) as multi from (select image_id, det_idx, d_cls, count(*) filter (where
  greatest(0e0, least(x + w / 2, px + pw / 2) - greatest(x - w / 2, px - pw / 2)) * greatest(0e0, least(y + h / 2, py + ph / 2) - greatest(y - h / 2, py - ph / 2)) / (w * h) >= 0.8) as k from same group by 1, 2, 3) group by 1) b on b.d_cls = g.cls""", **_T).replace(")\n\n, same", "),\nsame")


def edge_errors(s: SparkSession, d: str) -> DataFrame:
    return _r(reports.edge_errors(_matched(s, d)), "iou", "left", "top", "right", "bottom")


def _median(axis: str, side: str, sign: str, name: str) -> str:
    return f"round(quantile_cont(abs((p.{axis} {sign} p.{side} / 2 - b.{axis} - ({sign}1) * b.{side} / 2) / b.{side}), 0.5), 6) as {name}"


EDGE_SQL = with_tables(f"""
select g_cls, count(*) as n, round(quantile_cont(m.iou, 0.5), 6) as iou, {_median('x', 'w', '-', '"left"')}, {_median('y', 'h', '-', 'top')}, {_median('x', 'w', '+', '"right"')}, {_median('y', 'h', '+', 'bottom')}
from matched m join boxes b on b.image_id = m.image_id and b.box_idx = m.box_idx join predictions p on p.image_id = m.image_id and p.det_idx = m.det_idx group by 1""", **_T, matched=_MATCH)


def ap_by_iou_seeds(s: SparkSession, d: str) -> DataFrame:
    """AP of each class at four overlaps, the mean of two seeds (images by parity)."""
    steps = (0.5, 0.75, 0.9, 0.95)
    seed = (F.col("image_id") % 2).cast("int").alias("seed")
    boxes, found = derive(s, d, BOXES), derive(s, d, PREDICTIONS)
    hit = matching.two_pass_match(matching.overlaps(boxes, found)).select("image_id", "det_idx", "iou")
    each = found.join(hit, ["image_id", "det_idx"], "left").select("cls", seed, "conf", "image_id", "det_idx", "iou")
    totals = boxes.groupBy("cls", seed).agg(F.count("*").alias("n_gt"))
    got = ap.average_precision_at(ap.cut(each), totals, ["cls", "seed"], steps)
    return _r(got.groupBy("cls", "t").agg(F.count("ap").alias("seeds"), F.avg("ap").alias("ap")), "ap")


AP_SEEDS_SQL = with_tables("""
, flags as (select p.cls, p.image_id % 2 as seed, t, p.conf, p.image_id, p.det_idx, case when m.iou >= t then 1 else 0 end as flag
  from predictions p left join matched m on p.image_id = m.image_id and p.det_idx = m.det_idx cross join (values (0.5e0), (0.75e0), (0.9e0), (0.95e0)) x(t)),
run as (select *, sum(flag) over w / row_number() over w as prec, row_number() over w as k from flags window w as (partition by cls, seed, t order by conf desc, image_id, det_idx rows unbounded preceding)),
env as (select *, max(prec) over (partition by cls, seed, t order by k desc rows unbounded preceding) as e from run)
select cls, t, count(*) as seeds, round(avg(ap), 6) as ap from (select g.cls, g.seed, e.t, sum(case when flag = 1 then e else 0 end) / any_value(n_gt) as ap
  from (select cls, image_id % 2 as seed, count(*) as n_gt from boxes group by 1, 2) g join env e on e.cls = g.cls and e.seed = g.seed group by 1, 2, 3) group by 1, 2""", **_T, matched=_MATCH).replace(")\n\n, flags", "),\nflags")

CALIBRATED_SQL = with_tables("""
select f.cls, round(t, 6) as temperature, round(a.ece, 6) as ece, round(a.brier, 6) as brier, a.n::bigint as n, round(m.recall, 6) as recall, round(m.fpr, 6) as fpr
from fit f join after_ a on a.cls = f.cls
join (select s.cls, avg(case when label = 1 then cast(score >= threshold as int) end) as recall, avg(case when label = 0 then cast(score >= threshold as int) end) as fpr
      from scaled s join cal on cal.cls = s.cls where split = 'test' group by 1) m on m.cls = f.cls""",
    scores=SCORES, fit=_FIT, scaled=_SCALED, cal=_THRESHOLD.replace("{rows}", "(select * from scaled where split = 'val')").replace("{budget}", str(BUDGET)),
    after_=_ECE.replace("{rows}", "scaled").replace("as brier from", "as brier, sum(n) as n from"))

QUERIES = {
    "calibrated_report": (calibrated_report, CALIBRATED_SQL),
    "calibration_before_after": (calibration_before_after, BEFORE_AFTER_SQL), "background_boxes": (background_boxes, BACKGROUND_BOXES_SQL),
    "alarm_by_resolution": (alarm_by_resolution, ALARM_RESOLUTION_SQL), "recall_by_name": (recall_by_name, RECALL_NAME_SQL),
    "zero_shot_transfer": (zero_shot_transfer, TRANSFER_SQL), "module_effects": (module_effects, EFFECTS_SQL), "cross_domain_strata": (cross_domain_strata, CROSS_SQL),
    "tp_by_band": (tp_by_band, TP_BAND_SQL), "ranking_conflicts": (ranking_conflicts, CONFLICT_SQL), "edge_errors": (edge_errors, EDGE_SQL), "ap_by_iou_seeds": (ap_by_iou_seeds, AP_SEEDS_SQL),
}
