"""Detection-shaped tables derived from the star schema, as SQL that Spark and DuckDB both read.

``{orders}`` and the like stand for a table; Spark puts a DataFrame there, the
checking engine a view of that name. Columns are plain arithmetic on keys, so
both engines get the same rows to the bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.lineage import written

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: One image per order; one in five loses its boxes and is background, with false detections only.
IMAGES = """
select o_orderkey as image_id, case when o_orderkey % 10 = 0 then 'test' when o_orderkey % 10 = 1 then 'val' else 'train' end as split,
       cast(320 + (o_orderkey * 37) % 1701 as int) as width, cast(240 + (o_orderkey * 53) % 1201 as int) as height, o_custkey as scene
from {orders}
"""
_LINES = """
select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) as line
from {lineitem}
"""
#: Ground truth: even lines. Sizes run from a few pixels to half the image.
BOXES = f"""
select l_orderkey as image_id, cast(line as int) as box_idx, case when l_returnflag = 'R' then 0 else 1 end as cls,
       0.25 + cast((l_partkey * 13 + line * 7) % 50 as double) / 100 as x, 0.25 + cast((l_suppkey * 11 + line * 3) % 50 as double) / 100 as y,
       0.008 + cast((l_suppkey * 7 + l_partkey) % 40 as double) / 100 as w, 0.008 + cast((l_partkey * 3 + l_suppkey) % 40 as double) / 100 as h
from ({_LINES}) lines where line % 2 = 0 and l_orderkey % 5 <> 3
"""
#: Detections: most ground truth moved a little (some in the other class), and odd lines as false ones.
PREDICTIONS = f"""
select image_id, cast(row_number() over (partition by image_id order by conf desc, line) as int) as det_idx, cls, x, y, w, h, conf from (
  select l_orderkey as image_id, line, case when (l_returnflag = 'R') = (l_suppkey % 11 <> 0) then 0 else 1 end as cls,
         0.25 + cast((l_partkey * 13 + line * 7) % 50 as double) / 100 + cast(l_partkey % 5 - 2 as double) / 200 as x,
         0.25 + cast((l_suppkey * 11 + line * 3) % 50 as double) / 100 + cast(l_suppkey % 5 - 2 as double) / 200 as y,
         0.008 + cast((l_suppkey * 7 + l_partkey) % 40 as double) / 100 as w, 0.008 + cast((l_partkey * 3 + l_suppkey) % 40 as double) / 100 as h,
         0.1 + cast((l_partkey * 31 + l_suppkey * 17 + line * 5) % 8999 as double) / 10000 as conf
  from ({_LINES}) lines where line % 2 = 0 and l_orderkey % 5 <> 3 and (l_partkey + l_suppkey) % 6 <> 0
  union all
  select l_orderkey, line, case when l_returnflag = 'N' then 0 else 1 end,
         0.25 + cast((l_partkey * 17 + line) % 50 as double) / 100, 0.25 + cast((l_suppkey * 5 + line) % 50 as double) / 100,
         0.01 + cast(l_partkey % 30 as double) / 100, 0.01 + cast(l_suppkey % 30 as double) / 100,
         0.001 + cast((l_partkey * 29 + l_suppkey * 13 + line * 3) % 4999 as double) / 10000
  from ({_LINES}) lines where line % 2 = 1
) found
"""
#: Image scores: two classes (quality, toxic) for every labelled document.
SCORES = """
select image_id, cls, label, scene, split, 0.7 * cast((n_chars * 7919 + image_id * 104729 + cls * 31) % 10007 as double) / 10007 + 0.29 * label as score from (
  select d.doc_id as image_id, c.cls, case when c.cls = 0 then l.quality else l.toxic end as label, d.source as scene,
         case when d.doc_id % 2 = 0 then 'val' else 'test' end as split, d.n_chars
  from {documents} d join {labels} l on d.doc_id = l.doc_id cross join (select 0 as cls union all select 1 as cls) c
) s
"""
#: Learning curves: a run per user, three seeds to a config, an epoch per event.
CURVES = """
select user_id as run, user_id - user_id % 3 as config, cast(user_id % 3 as int) as seed,
       cast(row_number() over (partition by user_id order by ts, event_id) as int) as epoch, value as metric from {events}
"""
#: Content scan: two identities (bytes, pixels) and a split for every document; one dataset in seven is the reference.
CONTENT = """
select doc_id as source_id, case when doc_id % 7 = 0 then 'reference' else 'target' end as dataset,
       case when doc_id % 10 = 0 then 'test' when doc_id % 10 = 1 then 'val' else 'train' end as split,
       md5(text) as byte_sha, md5(replace(text, ' ', '')) as pixel_sha, case when doc_id % 97 = 5 then 1 else 0 end as decode_error from {documents}
"""
#: 60-bit fingerprints: signs of embedding values; the two engines spell the fold in their own way.
_MARKS = "select vec_id as id, case when vec_id % 10 < 2 then 'val' else 'train' end as split, {fold} as hash from {{embeddings}}"
MARKS = _MARKS.format(fold="aggregate(slice(embedding, 1, 60), 0L, (a, v) -> a * 2 + case when v > 0 then 1L else 0L end)")
MARKS_DUCKDB = _MARKS.format(fold="list_reduce(list_prepend(0::bigint, list_transform(embedding[1:60], lambda v: case when v > 0 then 1::bigint else 0::bigint end)), lambda a, v: a * 2 + v)")

#: The same over all 64 signs, the first one the sign bit of a long.
MARKS_64 = _MARKS.format(fold="aggregate(embedding, 0L, (a, v) -> shiftleft(a, 1) | case when v > 0 then 1L else 0L end)")
MARKS_64_DUCKDB = _MARKS.format(fold="list_reduce(list_prepend(0::bigint, list_transform(embedding[2:64], lambda v: case when v > 0 then 1::bigint else 0::bigint end)), lambda a, v: a * 2 + v) + case when embedding[1] > 0 then -9223372036854775808 else 0 end")
#: A second family of fingerprints, independent of the first: whether a value rises to the next, over 63 steps.
STEPS = _MARKS.format(fold="aggregate(sequence(1, 63), 0L, (a, i) -> a * 2 + case when element_at(embedding, i + 1) > element_at(embedding, i) then 1L else 0L end)")
STEPS_DUCKDB = _MARKS.format(fold="list_reduce(list_prepend(0::bigint, list_transform(range(1, 64), lambda i: case when embedding[i + 1] > embedding[i] then 1::bigint else 0::bigint end)), lambda a, v: a * 2 + v)")
#: Gray images of 32 x 32: a cell of 4 x 4 for each embedding value. Three in eight have a copy: brighter, with one corner changed, or noisy.
GRAYS = """
select 4 * vec_id + k as id, case when vec_id % 7 = 0 then 'reference' else 'target' end as dataset, case when (vec_id + k) % 10 < 2 then 'val' else 'train' end as split,
       transform(sequence(0, 1023), i -> cast(greatest(0, least(255, floor(128 + 300 * embedding[8 * (i div 128) + i % 32 div 4] + case
         when k = 1 then 20 when k = 2 and i < 256 and i % 32 < 8 then 60 when k = 3 then (i * 31 + vec_id) % 13 * 3 - 18 else 0 end))) as int)) as gray
from (select vec_id, embedding, explode(array(0, 1, 2, 3)) as k from {embeddings} where size(embedding) = 64) e where k = 0 or vec_id % 8 = k
"""
GRAYS_DUCKDB = """
select 4 * vec_id + k as id, case when vec_id % 7 = 0 then 'reference' else 'target' end as dataset, case when (vec_id + k) % 10 < 2 then 'val' else 'train' end as split,
       list_transform(range(1024), lambda i: greatest(0, least(255, floor(128 + 300 * embedding[8 * (i // 128) + i % 32 // 4 + 1] + case
         when k = 1 then 20 when k = 2 and i < 256 and i % 32 < 8 then 60 when k = 3 then (i * 31 + vec_id) % 13 * 3 - 18 else 0 end)))::double) as gray
from (select vec_id, embedding, unnest([0, 1, 2, 3]) as k from {embeddings} where len(embedding) = 64) e where k = 0 or vec_id % 8 = k
"""


def in_64(sql: str) -> str:
    """A DuckDB query over the marks, over the marks of all 64 signs."""
    tables = {t: t for t in _TABLES}
    return sql.replace(MARKS_DUCKDB.format(**tables), MARKS_64_DUCKDB.format(**tables))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The table that a text above describes."""
    return spark.sql(text, **{t: read(spark, sf_dir, t) for t in _TABLES if "{" + t + "}" in text})


def boxes_and_predictions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """BOXES and PREDICTIONS, from lines that are numbered and written once for both."""
    lines = written(derive(spark, sf_dir, f"select l_orderkey, l_partkey, l_suppkey, l_returnflag, line from ({_LINES}) lines"))
    boxes, found = (spark.sql(text.replace(f"({_LINES})", "{lines}"), lines=lines) for text in (BOXES, PREDICTIONS))
    return boxes, found


def with_tables(body: str, **texts: str) -> str:
    """A DuckDB query: ``body`` over the named texts as common tables."""
    names = {t: t for t in _TABLES}
    return "with " + ",\n".join(f"{k} as materialized ({v.format(**names)})" for k, v in texts.items()) + "\n" + body
