"""Queries on image-level alarms, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alarms as A
from ..sources.fixtures import BOXES, IMAGES, PREDICTIONS, SCORES, derive, with_tables
from .detection import _r

BUDGET = 0.1
FACTORS = [0.5, 0.75, 1.0, 1.25, 1.5]


def _scores(s: SparkSession, d: str, split: str | None = None) -> DataFrame:
    got = derive(s, d, SCORES)
    return got.filter(F.col("split") == split) if split else got


def image_scores(s: SparkSession, d: str) -> DataFrame:
    got = A.image_scores(derive(s, d, IMAGES), derive(s, d, BOXES), derive(s, d, PREDICTIONS))
    return got.groupBy("split", "cls").agg(F.count("*").alias("n"), F.sum("label").alias("positives"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.max("score"), 6).alias("top_score"))


IMAGE_SCORES_SQL = with_tables("""
select split, c.cls, count(*) as n, sum(case when exists (select 1 from boxes b where b.image_id = i.image_id and b.cls = c.cls) then 1 else 0 end)::bigint as positives,
       round(avg(coalesce(m, 0)), 6) as mean_score, round(max(coalesce(m, 0)), 6) as top_score
from images i cross join (values (0), (1)) c(cls) left join (select image_id, cls, max(conf) as m from predictions group by 1, 2) p on p.image_id = i.image_id and p.cls = c.cls group by 1, 2""", images=IMAGES, boxes=BOXES, predictions=PREDICTIONS)

#: Threshold by class under a budget, from a table ``rows`` of (cls, score, label).
_THRESHOLD = """
select cls, threshold, recall, fpr from (select *, row_number() over (partition by cls order by recall desc, fpr, threshold desc) as r from (
  select cls, score as threshold, tp / pos as recall, fp / neg as fpr from (
    select cls, score, sum(p) over w as tp, sum(n) over w as fp, sum(p) over (partition by cls) as pos, sum(n) over (partition by cls) as neg
    from (select cls, score, sum(label) as p, sum(1 - label) as n from {rows} group by 1, 2) window w as (partition by cls order by score desc rows unbounded preceding))
  union all select distinct cls, 1.0000000000000002e0, 0e0, 0e0 from {rows}) where fpr <= {budget}) where r = 1
"""
_TH = _THRESHOLD.replace("{rows}", "(select * from scores where split = ''val'')".replace("''", "'")).replace("{budget}", str(BUDGET))


def alarm_threshold(s: SparkSession, d: str) -> DataFrame:
    return _r(A.threshold_under_budget(_scores(s, d, "val"), BUDGET), "threshold", "recall", "fpr")


THRESHOLD_SQL = with_tables("select cls, round(threshold, 6) as threshold, round(recall, 6) as recall, round(fpr, 6) as fpr from th", scores=SCORES, th=_TH)


def alarm_metrics(s: SparkSession, d: str) -> DataFrame:
    th = A.threshold_under_budget(_scores(s, d, "val"), BUDGET)
    return _r(A.alarm_metrics(_scores(s, d, "test"), th), "recall", "fpr")


METRICS_SQL = with_tables("""
select s.cls, round(avg(case when label = 1 then cast(score >= threshold as int) end), 6) as recall, round(avg(case when label = 0 then cast(score >= threshold as int) end), 6) as fpr, count(*) as n
from scores s join th on s.cls = th.cls where split = 'test' group by 1""", scores=SCORES, th=_TH)


def background_alarms(s: SparkSession, d: str) -> DataFrame:
    return _r(A.background_alarms(_scores(s, d, "test"), A.threshold_under_budget(_scores(s, d, "val"), BUDGET)), "alarm_fraction")


BACKGROUND_SQL = with_tables("""
select count(*) as n_background, round(avg(alarm), 6) as alarm_fraction from (
  select image_id, max(label) as l, max(cast(score >= threshold as int)) as alarm from scores s join th on s.cls = th.cls where split = 'test' group by 1) where l = 0""", scores=SCORES, th=_TH)


def calibration_ece_brier(s: SparkSession, d: str) -> DataFrame:
    return _r(A.ece_brier(_scores(s, d)), "ece", "brier")


ECE_SQL = with_tables("""
select cls, round(sum(n * abs(p - y)) / sum(n), 6) as ece, round(sum(sq) / sum(n), 6) as brier, sum(n)::bigint as n from (
  select cls, least(floor(score * 15), 14) as b, count(*) as n, avg(score) as p, avg(label) as y, sum(pow(score - label, 2)) as sq from scores group by 1, 2) group by 1""", scores=SCORES)


def temperature_fit(s: SparkSession, d: str) -> DataFrame:
    return _r(A.fit_temperature(_scores(s, d, "val")), "temperature", "nll")


_Q = "greatest(1e-6, least(1 - 1e-6, score))"
_P = "1 / (1 + exp(-greatest(-60e0, least(60e0, ln(q / (1 - q)) / t))))"
TEMPERATURE_SQL = with_tables(f"""
select cls, k, round(t, 6) as temperature, round(nll, 6) as nll from (select *, row_number() over (partition by cls order by round(nll, 12), k) as r from (
  select cls, k, t, avg(-case when label = 1 then ln(p) else ln(1 - p) end) as nll from (
    select cls, label, k, t, greatest(1e-12, least(1 - 1e-12, {_P})) as p from (select cls, label, {_Q} as q from scores where split = 'val')
    cross join (select cast(i as int) as k, pow(10e0, -1e0 + 2 * i / 400e0) as t from range(401) r(i))) group by 1, 2, 3)) where r = 1""", scores=SCORES)


def calibrated_report(s: SparkSession, d: str) -> DataFrame:
    """Fit temperature and threshold on val, report on test."""
    c = A.calibrate(_scores(s, d, "val"), BUDGET)
    new = _scores(s, d, "test").join(c.select("cls", "temperature"), "cls").withColumn("score", A.scaled(F.col("score"), F.col("temperature")))
    return _r(A.ece_brier(new).join(A.alarm_metrics(new, c).drop("n"), "cls").join(c.select("cls", "temperature"), "cls"), "ece", "brier", "recall", "fpr", "temperature")


def operating_sweep(s: SparkSession, d: str) -> DataFrame:
    return _r(A.operating_sweep(_scores(s, d, "test"), A.threshold_under_budget(_scores(s, d, "val"), BUDGET), FACTORS), "recall", "fpr")


_SWEEP = """
select f as factor, s.cls, round(avg(case when label = 1 then cast(score >= threshold * f as int) end), 6) as recall, round(avg(case when label = 0 then cast(score >= threshold * f as int) end), 6) as fpr
from scores s join th on s.cls = th.cls cross join (values (0.5e0), (0.75e0), (1e0), (1.25e0), (1.5e0)) x(f) where split = 'test' group by 1, 2
"""
SWEEP_SQL = with_tables("select * from sweep", scores=SCORES, th=_TH, sweep=_SWEEP)


def matched_operating_point(s: SparkSession, d: str) -> DataFrame:
    return A.matched_point(operating_sweep(s, d), 0.05)


MATCHED_SQL = with_tables("select cls, factor, recall, fpr from (select *, row_number() over (partition by cls order by round(abs(fpr - 0.05e0), 9), factor) as r from sweep) where r = 1", scores=SCORES, th=_TH, sweep=_SWEEP)


# Multipliers of a sweep, the grid on which a background alarm rate is met, and the rates.
SWEEP = [0.25, 0.4, 0.6, 0.8, 1.0, 1.3, 1.7, 2.2, 3.0, 4.0, 6.0]
GRID = [0.05 + i * ((12 - 0.05) / 239) for i in range(239)] + [12.0]
TARGETS = [0.02, 0.05, 0.1]


def _background(s: SparkSession, d: str, factors: list[float]) -> DataFrame:
    return A.background_sweep(_scores(s, d, "test"), A.threshold_under_budget(_scores(s, d, "val"), BUDGET), factors)


def background_sweep(s: SparkSession, d: str) -> DataFrame:
    return _r(_background(s, d, SWEEP), "recall_0", "recall_1", "recall_any", "alarm")


def background_matched(s: SparkSession, d: str) -> DataFrame:
    """Recall at the same share of alarms on backgrounds, over both classes."""
    return _r(A.background_matched(_background(s, d, GRID), TARGETS), "factor", "recall_0", "recall_1", "recall_any", "alarm")


def _sweep_sql(factors: list[float], body: str) -> str:
    hits = "select f as factor, image_id, s.cls, label, score >= threshold * f as hit from scores s join th on s.cls = th.cls cross join (values " + ", ".join(f"({x!r}::double)" for x in factors) + ") x(f) where split = 'test'"
    return with_tables(body, scores=SCORES, th=_TH, hits=hits, swept="""
select factor, avg(cast(hit as int)) filter (where cls = 0 and label = 1) as recall_0, avg(cast(hit as int)) filter (where cls = 1 and label = 1) as recall_1,
       any_value(r) as recall_any, any_value(a) as alarm from (
  select h.*, r, a from hits h join (select factor, avg(found) filter (where there = 1) as r, avg(alarm) filter (where there = 0) as a from (
    select factor, image_id, max(label) as there, max(cast(hit as int)) as alarm, max(case when label = 1 then cast(hit as int) else 0 end) as found from hits group by 1, 2) group by 1) i using (factor)) group by 1""")  # fmt: skip


BACKGROUND_SWEEP_SQL = _sweep_sql(SWEEP, "select factor, round(recall_0, 6) as recall_0, round(recall_1, 6) as recall_1, round(recall_any, 6) as recall_any, round(alarm, 6) as alarm from swept")
BACKGROUND_MATCHED_SQL = _sweep_sql(GRID, """
select target, round(factor, 6) as factor, round(recall_0, 6) as recall_0, round(recall_1, 6) as recall_1, round(recall_any, 6) as recall_any, round(alarm, 6) as alarm
from (select *, row_number() over (partition by target order by abs(alarm - target) nulls first, factor) as r from swept cross join (values (0.02e0), (0.05e0), (0.1e0)) t(target)) where r = 1""")


def _seeded(s: SparkSession, d: str) -> DataFrame:
    return _scores(s, d).withColumn("seed", (F.col("image_id") % 3).cast("int"))


def fixed_vs_reselected(s: SparkSession, d: str) -> DataFrame:
    """Recall by seed with its own threshold, seed 0's, and the mean of all."""
    rows = _seeded(s, d)
    own = A.threshold_under_budget(rows.filter("split = 'val'"), BUDGET, ("seed", "cls"), one_label=True).select("seed", "cls", "threshold")
    first = own.filter("seed = 0").select("cls", "threshold")
    mean = own.groupBy("cls").agg(F.avg("threshold").alias("threshold"))
    seeds = own.select("seed", "cls")
    every = own.withColumn("policy", F.lit("own")).unionByName(seeds.join(first, "cls").withColumn("policy", F.lit("frozen"))).unionByName(seeds.join(mean, "cls").withColumn("policy", F.lit("mean")))
    hit = (F.col("score") >= F.col("threshold")).cast("double")
    got = rows.filter("split = 'test'").join(every, ["seed", "cls"]).groupBy("policy", "seed", "cls").agg(F.avg(F.when(F.col("label") == 1, hit)).alias("recall"), F.avg(F.when(F.col("label") == 0, hit)).alias("fpr"))
    return _r(got, "recall", "fpr")


FIXED_SQL = with_tables("""
select policy, s.seed, s.cls, round(avg(case when label = 1 then cast(score >= threshold as int) end), 6) as recall, round(avg(case when label = 0 then cast(score >= threshold as int) end), 6) as fpr
from rows s join (select 'own' as policy, * from own union all select 'frozen', a.seed, a.cls, b.threshold from own a join own b on a.cls = b.cls and b.seed = 0
                  union all select 'mean', a.seed, a.cls, m.t from own a join (select cls, avg(threshold) as t from own group by 1) m on a.cls = m.cls) p on s.seed = p.seed and s.cls = p.cls
where split = 'test' group by 1, 2, 3""", scores=SCORES, rows="select *, cast(image_id % 3 as int) as seed from scores", own="""
select seed, cls, threshold from (select *, row_number() over (partition by seed, cls order by recall desc, fpr, threshold desc) as r from (
  select seed, cls, score as threshold, tp / pos as recall, fp / neg as fpr from (
    select seed, cls, score, sum(p) over w as tp, sum(n) over w as fp, sum(p) over (partition by seed, cls) as pos, sum(n) over (partition by seed, cls) as neg
    from (select seed, cls, score, sum(label) as p, sum(1 - label) as n from rows where split = 'val' group by 1, 2, 3) window w as (partition by seed, cls order by score desc rows unbounded preceding)) where pos > 0 and neg > 0
  union all select distinct seed, cls, 1.0000000000000002e0, 0e0, 0e0 from rows where split = 'val') where fpr <= 0.1) where r = 1""")  # fmt: skip


def bootstrap_ci(s: SparkSession, d: str) -> DataFrame:
    return _r(A.bootstrap(_scores(s, d, "test"), A.threshold_under_budget(_scores(s, d, "val"), BUDGET), 200), "low", "high")


BOOTSTRAP_SQL = with_tables("""
, unit as (select *, row_number() over (partition by cls order by scene) - 1 as u, count(*) over (partition by cls) as n from (
    select s.cls, scene, sum(label) as pos, sum(cast(score >= threshold as int) * label) as tp from scores s join th on s.cls = th.cls where split = 'test' group by 1, 2)),
draws as (select a.cls, r, cast(concat('0x', substr(md5(concat_ws(':', 0, r, a.u)), 1, 12)) as bigint) % a.n as u from unit a cross join range(200) x(r)),
each as (select d.cls, d.r, sum(tp) / sum(pos) as recall from draws d join unit u on d.cls = u.cls and d.u = u.u group by 1, 2 having sum(pos) > 0)
select cls, count(*) as n_replicates, round(quantile_cont(recall, 0.025), 6) as low, round(quantile_cont(recall, 0.975), 6) as high from each group by 1""", scores=SCORES, th=_TH).replace(")\n\n, unit", "),\nunit")


def bootstrap_report(s: SparkSession, d: str) -> DataFrame:
    """All three intervals of 1000 replicates."""
    return _r(A.bootstrap_report(_scores(s, d, "test"), A.threshold_under_budget(_scores(s, d, "val"), BUDGET)), "low", "high")


BOOTSTRAP_REPORT_SQL = with_tables("""
, hits as (select s.*, cast(score >= threshold as int) as hit from scores s join th on s.cls = th.cls where split = 'test'),
sums as (select scene, 'recall' as metric, cls, sum(label) as of_, sum(hit * label) as is_ from hits group by 1, 3
  union all select scene, 'background_alarm_fraction', null, sum(1 - there), sum((1 - there) * alarm) from (select scene, image_id, max(label) as there, max(hit) as alarm from hits group by 1, 2) group by 1),
unit as (select scene, row_number() over (order by scene) - 1 as u, count(*) over () as n from (select distinct scene from hits)),
draws as (select r, cast(concat('0x', substr(md5(concat_ws(':', 0, r, u)), 1, 12)) as bigint) % n as u from unit cross join range(1000) x(r)),
each as (select metric, cls, r, sum(is_) / sum(of_) as v from draws d join unit x on x.u = d.u join sums s on s.scene = x.scene group by 1, 2, 3 having sum(of_) > 0)
select metric, cls, count(*) as n_replicates, round(quantile_cont(v, 0.025), 6) as low, round(quantile_cont(v, 0.975), 6) as high from each group by 1, 2""", scores=SCORES, th=_TH).replace(")\n\n, hits", "),\nhits")


def false_alarm_attribution(s: SparkSession, d: str) -> DataFrame:
    """Test images without any class: which classes alarm on them."""
    at = _scores(s, d, "test").join(A.threshold_under_budget(_scores(s, d, "val"), BUDGET).select("cls", "threshold"), "cls")
    on = lambda c: F.max(F.when((F.col("cls") == c) & (F.col("score") >= F.col("threshold")), 1).otherwise(0))
    image = at.groupBy("image_id", "scene").agg(F.max("label").alias("any"), on(0).alias("a"), on(1).alias("b")).filter("any = 0")
    kind = F.when((F.col("a") == 1) & (F.col("b") == 1), "both").when(F.col("a") == 1, "first_only").when(F.col("b") == 1, "second_only").otherwise("none")
    return image.groupBy("scene", kind.alias("kind")).agg(F.count("*").alias("n"))


ATTRIBUTION_SQL = with_tables("""
select scene, case when a = 1 and b = 1 then 'both' when a = 1 then 'first_only' when b = 1 then 'second_only' else 'none' end as kind, count(*) as n from (
  select image_id, scene, max(label) as l, max(case when s.cls = 0 and score >= threshold then 1 else 0 end) as a, max(case when s.cls = 1 and score >= threshold then 1 else 0 end) as b
  from scores s join th on s.cls = th.cls where split = 'test' group by 1, 2) where l = 0 group by 1, 2""", scores=SCORES, th=_TH)


def hardest_negatives(s: SparkSession, d: str) -> DataFrame:
    """A top-12 report: the highest scores of negatives by class."""
    from pyspark.sql import Window

    w = Window.partitionBy("cls").orderBy(F.desc("score"), "image_id")
    return _r(_scores(s, d).filter("label = 0").withColumn("rank", F.row_number().over(w)).filter("rank <= 12").select("cls", "rank", "image_id", "score"), "score")


HARDEST_SQL = with_tables("select cls, rank, image_id, round(score, 6) as score from (select *, row_number() over (partition by cls order by score desc, image_id) as rank from scores where label = 0) where rank <= 12", scores=SCORES)

QUERIES = {
    "image_scores": (image_scores, IMAGE_SCORES_SQL), "alarm_threshold": (alarm_threshold, THRESHOLD_SQL), "alarm_metrics": (alarm_metrics, METRICS_SQL), "background_alarms": (background_alarms, BACKGROUND_SQL),
    "calibration_ece_brier": (calibration_ece_brier, ECE_SQL), "temperature_fit": (temperature_fit, TEMPERATURE_SQL), "operating_sweep": (operating_sweep, SWEEP_SQL),
    "matched_operating_point": (matched_operating_point, MATCHED_SQL), "fixed_vs_reselected": (fixed_vs_reselected, FIXED_SQL), "bootstrap_ci": (bootstrap_ci, BOOTSTRAP_SQL),
    "background_sweep": (background_sweep, BACKGROUND_SWEEP_SQL), "background_matched": (background_matched, BACKGROUND_MATCHED_SQL), "bootstrap_report": (bootstrap_report, BOOTSTRAP_REPORT_SQL),
    "false_alarm_attribution": (false_alarm_attribution, ATTRIBUTION_SQL), "hardest_negatives": (hardest_negatives, HARDEST_SQL),
}
