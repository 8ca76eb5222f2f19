"""Queries on learning curves and seeds, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import required_n as _required_n
from ..functions.stats import T_CRITICAL, t_critical
from ..operators import curves as C
from ..operators import power as P
from ..sources.fixtures import CURVES, derive, with_tables
from .detection import _r


def _curves(s: SparkSession, d: str) -> DataFrame:
    return derive(s, d, CURVES)


_BEST = """
select run, config, seed, max(epoch) filter (where b = 1) as best_epoch, max(metric) filter (where b = 1) as best, max(epoch) filter (where l = 1) as last_epoch, max(metric) filter (where l = 1) as last, count(*) as n
from (select *, row_number() over (partition by run order by metric desc, epoch) as b, row_number() over (partition by run order by epoch desc) as l from curves) group by 1, 2, 3
"""
_TAIL = "select *, greatest(3, cast(round_even(n * 0.2e0, 0) as int)) as k from (select *, row_number() over (partition by run order by epoch desc) as r, count(*) over (partition by run) as n, max(metric) over (partition by run) as top from curves)"
_T = "(case " + " ".join(f"when n = {i + 2} then {v}e0" for i, v in enumerate((12.706, 4.303, 3.182, 2.776))) + " end)"


def best_last_epoch(s: SparkSession, d: str) -> DataFrame:
    return _r(C.best_and_last(_curves(s, d)), "best", "last")


BEST_SQL = with_tables("select run, best_epoch, round(best, 6) as best, last_epoch, round(last, 6) as last, n from best", curves=CURVES, best=_BEST)


def plateau_stats(s: SparkSession, d: str) -> DataFrame:
    return _r(C.plateau(_curves(s, d)), "mean", "sd", "slope", "drift", "gap")


_PLATEAU = """
select run, k, avg(metric) as mean, stddev_samp(metric) as sd, regr_slope(metric, epoch) as slope, max(metric) filter (where r = 1) - max(metric) filter (where r = least(k, n)) as drift, max(top) - avg(metric) as gap from tail where r <= k group by 1, 2
"""
PLATEAU_SQL = with_tables("select run, k, round(mean, 6) as mean, round(sd, 6) as sd, round(slope, 6) as slope, round(drift, 6) as drift, round(gap, 6) as gap from plateau", curves=CURVES, tail=_TAIL, plateau=_PLATEAU)


def tail_slope(s: SparkSession, d: str) -> DataFrame:
    return _r(C.tail_slope(_curves(s, d)), "slope")


SLOPE_SQL = with_tables("select run, round(case when count(*) >= 3 then regr_slope(metric, epoch) end, 6) as slope from tail where r <= 10 group by 1", curves=CURVES, tail=_TAIL)


def window_means(s: SparkSession, d: str) -> DataFrame:
    return _r(C.window_means(_curves(s, d), [("early", 1, 10), ("middle", 11, 30), ("late", 25, 49)]), "mean")


WINDOW_SQL = with_tables("select run, w as window, round(avg(metric), 6) as mean, count(*) as n from curves join (values ('early', 1, 10), ('middle', 11, 30), ('late', 25, 49)) x(w, a, z) on epoch between a and z group by 1, 2", curves=CURVES)


def missing_epochs(s: SparkSession, d: str) -> DataFrame:
    """Curves with the epochs whose metric is under 20 taken out."""
    return C.missing_epochs(_curves(s, d).filter("metric >= 20"))


MISSING_SQL = with_tables("select c.run, c.epoch from curves c join (select run, max(epoch) as m from curves where metric >= 20 group by 1) x on c.run = x.run and c.epoch <= m where metric < 20 or metric is null", curves=CURVES)


def same_epoch_join(s: SparkSession, d: str) -> DataFrame:
    return C.same_epoch(_curves(s, d).withColumn("seed", F.col("seed").cast("string")), "0", "1", ["config"]).withColumnsRenamed({"a": "seed0", "b": "seed1"})


SAME_SQL = with_tables("select coalesce(x.config, y.config) as config, coalesce(x.epoch, y.epoch) as epoch, x.metric as seed0, y.metric as seed1 from (select * from curves where seed = 0) x full join (select * from curves where seed = 1) y on x.config = y.config and x.epoch = y.epoch", curves=CURVES)


def nearest_step_join(s: SparkSession, d: str) -> DataFrame:
    """Seed 0's epochs of 7 steps against seed 1's of 11, by closest cumulative step."""
    c = _curves(s, d)
    left = c.filter("seed = 0").select("config", "epoch", (F.col("epoch") * 7).alias("step"))
    right = c.filter("seed = 1").select("config", "epoch", (F.col("epoch") * 11).alias("step"), "metric")
    return C.nearest_step(left, right, ["config"])


NEAREST_SQL = with_tables("""
select config, epoch, step, near_epoch, near_step, near_metric, gap from (
  select x.config, x.epoch, x.epoch * 7 as step, y.epoch as near_epoch, y.epoch * 11 as near_step, y.metric as near_metric, abs(y.epoch * 11 - x.epoch * 7) as gap,
         row_number() over (partition by x.config, x.epoch order by abs(y.epoch * 11 - x.epoch * 7), y.epoch) as r
  from (select * from curves where seed = 0) x join (select * from curves where seed = 1) y on x.config = y.config) where r = 1""", curves=CURVES)


def pareto_frontier(s: SparkSession, d: str) -> DataFrame:
    runs = C.best_and_last(_curves(s, d)).select("run", (F.col("run") % 5).alias("family"), "best_epoch", "best")
    return _r(C.pareto(runs, "best_epoch", "best", ["family"], "run"), "best")


PARETO_SQL = with_tables("""
select run, family, best_epoch, round(best, 6) as best from (select *, max(best) over (partition by family order by best_epoch, best desc, run rows between unbounded preceding and 1 preceding) as before
  from (select run, run % 5 as family, best_epoch, best from best)) where before is null or best > before""", curves=CURVES, best=_BEST)


def running_best(s: SparkSession, d: str) -> DataFrame:
    return C.running_best(_curves(s, d)).select("run", "epoch", F.round("metric", 6).alias("metric"))


RUNNING_SQL = with_tables("select run, epoch, round(metric, 6) as metric from (select *, min(metric) over (partition by run order by epoch rows between unbounded preceding and 1 preceding) as m from curves) where m is null or metric < m", curves=CURVES)


def _runs(s: SparkSession, d: str) -> DataFrame:
    c = _curves(s, d)
    keys = c.select("run", "config", "seed").distinct()
    return C.best_and_last(c).join(C.plateau(c), "run").join(keys, "run").select("run", "config", "seed", "best", "sd")


_RUNS = "select b.run, config, seed, best, sd from best b join plateau p on b.run = p.run"
_F = dict(curves=CURVES, best=_BEST, tail=_TAIL, plateau=_PLATEAU, runs=_RUNS)


def variance_decomposition(s: SparkSession, d: str) -> DataFrame:
    return _r(P.variance_decomposition(_runs(s, d)), "between", "plateau_sd", "ratio", "se", "mdd")


VARIANCE_SQL = with_tables(f"""
select config, n, round(between_, 6) as between, round(p, 6) as plateau_sd, round(p / nullif(between_, 0), 6) as ratio, round(between_ / sqrt(n), 6) as se, round({_T} * between_ / sqrt(n), 6) as mdd
from (select config, count(best) as n, stddev_samp(best) as between_, avg(sd) as p from runs group by 1)""", **_F)


def paired_effects(s: SparkSession, d: str) -> DataFrame:
    r = _runs(s, d)
    first = r.agg(F.min("config").alias("c")).first()["c"]
    return _r(P.paired_effects(r, first if first is not None else 0), "mean", "mdd")


PAIRED_SQL = with_tables(f"""
select config, n, round(mean, 6) as mean, round(case when n > 1 then {_T} * sd / sqrt(n) end, 6) as mdd, abs(mean) > case when n > 1 then {_T} * sd / sqrt(n) end as significant from (
  select r.config, count(*) as n, avg(r.best - f.best) as mean, stddev_samp(r.best - f.best) as sd from runs r join runs f on f.seed = r.seed and f.config = (select min(config) from runs) where r.config <> f.config group by 1)""", **_F)


def seed_summary(s: SparkSession, d: str) -> DataFrame:
    return _r(P.seed_summary(_runs(s, d), ["config"]), "mean", "sd")


SUMMARY_SQL = with_tables("select config, count(*) as n, round(avg(best), 6) as mean, round(stddev_samp(best), 6) as sd from runs group by 1 having count(*) = 3 and count(distinct seed) = 3", **_F)


def required_n(s: SparkSession, d: str) -> DataFrame:
    """Runs needed to show a tenth, a half and the whole of each configuration's deviation."""
    v = P.variance_decomposition(_runs(s, d)).filter("between > 0")
    t = v.select("config", F.col("between").alias("sigma"), F.explode(F.array(F.lit(0.1), F.lit(0.5), F.lit(1.0))).alias("share")).withColumn("target", F.round(F.col("sigma") * F.col("share"), 9))
    return _required_n(s, t).select("config", "share", "n")


_FACTORS = "select n, (case when n <= 31 then [" + ", ".join(f"{t}e0" for t in T_CRITICAL) + "][n - 1] else 1.959964e0 + (1.959964e0 ** 3 + 1.959964e0) / 4 / (n - 1) + (5 * 1.959964e0 ** 5 + 16 * 1.959964e0 ** 3 + 3 * 1.959964e0) / 96 / ((n - 1) * (n - 1)) end) / sqrt(n) as factor from range(2, 5001) r(n)"
REQUIRED_SQL = with_tables("""
select config, share, cast(min(n) as int) as n from (select config, share, sigma, round(sigma * share, 9) as target from (select config, stddev_samp(best) as sigma from runs group by 1 having stddev_samp(best) > 0) cross join (values (0.1e0), (0.5e0), (1e0)) s(share))
left join factors on factor * sigma <= target group by 1, 2""", **_F, factors=_FACTORS)


def interval_95(s: SparkSession, d: str) -> DataFrame:
    low, high = P.interval("n", "mean", "sd")
    return _r(P.seed_summary(_runs(s, d), ["config"]).select("config", low.alias("low"), high.alias("high"), t_critical(F.col("n") - 1).alias("t")), "low", "high")


INTERVAL_SQL = with_tables(f"select config, round(mean - {_T} * sd / sqrt(n), 6) as low, round(mean + {_T} * sd / sqrt(n), 6) as high, {_T} as t from (select config, count(*) as n, avg(best) as mean, stddev_samp(best) as sd from runs group by 1 having count(*) = 3 and count(distinct seed) = 3)", **_F)

QUERIES = {
    "best_last_epoch": (best_last_epoch, BEST_SQL), "plateau_stats": (plateau_stats, PLATEAU_SQL), "tail_slope": (tail_slope, SLOPE_SQL), "window_means": (window_means, WINDOW_SQL), "missing_epochs": (missing_epochs, MISSING_SQL),
    "same_epoch_join": (same_epoch_join, SAME_SQL), "nearest_step_join": (nearest_step_join, NEAREST_SQL), "pareto_frontier": (pareto_frontier, PARETO_SQL), "running_best": (running_best, RUNNING_SQL),
    "variance_decomposition": (variance_decomposition, VARIANCE_SQL), "paired_effects": (paired_effects, PAIRED_SQL), "seed_summary": (seed_summary, SUMMARY_SQL), "required_n": (required_n, REQUIRED_SQL), "interval_95": (interval_95, INTERVAL_SQL),
}
