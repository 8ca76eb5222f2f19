"""Queries on duplicates, splits and samples, with their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import inventory_digest
from ..operators import dedup, integrity, sampling
from ..sources import versions
from ..sources.fixtures import BOXES, CONTENT, GRAYS, GRAYS_DUCKDB, IMAGES, MARKS, MARKS_64, MARKS_DUCKDB, STEPS, STEPS_DUCKDB, derive, in_64, read, with_tables
from ..sources.labels import NAMES, parse_labels
from .detection import _r

RADIUS = 14


def exact_duplicates(s: SparkSession, d: str) -> DataFrame:
    return dedup.exact_groups(derive(s, d, CONTENT), "byte_sha")


EXACT_SQL = with_tables("""
select byte_sha, count(*) as n, (count(*) * (count(*) - 1) / 2)::bigint as pairs, count(distinct split) as n_splits,
       case when bool_and(split = 'train') then count(*) - 1 else 0 end as within_train from content group by 1 having count(*) > 1""", content=CONTENT)

_NEAR = f"""
select a.id as a, b.id as b, cast(bit_count(xor(a.hash, b.hash)) as int) as distance from marks a join marks b on a.id < b.id where bit_count(xor(a.hash, b.hash)) <= {RADIUS}
"""


def _pairs(s: SparkSession, d: str, marks: str = MARKS) -> DataFrame:
    return dedup.near_pairs(derive(s, d, marks), RADIUS)


def near_dup_banded(s: SparkSession, d: str, marks: str = MARKS) -> DataFrame:
    return _pairs(s, d, marks)


NEAR_SQL = with_tables("select * from near", marks=MARKS_DUCKDB, near=_NEAR)


def two_hash_candidates(s: SparkSession, d: str, marks: str = MARKS) -> DataFrame:
    """Candidates of two hash families as one edge list: signs of embedding values, and of the steps from one value to the next. Equal in either family is distance 0."""
    return dedup.candidate_union(_pairs(s, d, marks), _pairs(s, d, STEPS))


TWO_HASH_SQL = with_tables("select a, b, min(distance) as distance, bool_or(distance = 0) as identical from (select * from near union all select * from near2) group by 1, 2", marks=MARKS_DUCKDB, near=_NEAR, steps=STEPS_DUCKDB, near2=_NEAR.replace("marks", "steps"))


#: Products of an image with the low cosines, with the means of an 8 x 9 grid, and with windows of 8 x 8 at a stride of 4.
_COSINES = """
select list(w order by u, v) as w from (select u, v, list_transform(range(1024), lambda i: 0.0625e0 * case when u = 0 then sqrt(0.5e0) else 1 end * case when v = 0 then sqrt(0.5e0) else 1 end
  * cos(pi() * (2 * (i // 32) + 1) * u / 64) * cos(pi() * (2 * (i % 32) + 1) * v / 64)) as w from range(8) a(u), range(8) b(v))"""
_MEANS = """
select list(w order by r, j) as w from (select r, j, list_transform(range(1024), lambda i: case when i // 128 = r then greatest(0, least((j + 1) * 32, (i % 32 + 1) * 9) - greatest(j * 32, i % 32 * 9))::double else 0e0 end) as w from range(8) a(r), range(9) b(j))"""
_WINDOWS = """
select list(w order by r, j) as w from (select r, j, list_transform(range(1024), lambda i: case when i // 32 between 4 * r and 4 * r + 7 and i % 32 between 4 * j and 4 * j + 7 then 1e0 else 0e0 end) as w from range(7) a(r), range(7) b(j))"""
_GRID = "list_aggregate(list_transform(range(64), lambda k: case when s[k // 8 * 9 + k % 8 + {a}] > s[k // 8 * 9 + k % 8 + {b}] then '1' else '0' end), 'string_agg', '')::bit"
_HASHED = dict(
    grays=GRAYS_DUCKDB, cosines=_COSINES, means=_MEANS,
    low="select g.*, min(id) over (partition by gray) as rep, list_transform(c.w, lambda w: list_inner_product(gray, w)) as f, list_transform(m.w, lambda w: list_inner_product(gray, w)) as s, list_avg(gray) as mean, list_inner_product(gray, gray) / 1024 as square from grays g, cosines c, means m",
    hashed="select id, rep, dataset, dataset || '/' || split as place, gray, mean, square - mean * mean as var, list_aggregate(list_transform(f, lambda x: case when x > list_median(f[2:]) then '1' else '0' end), 'string_agg', '')::bit as phash, " + _GRID.format(a=1, b=2) + " as falls, " + _GRID.format(a=2, b=1) + " as rises from low",
)
SCREENED = _HASHED | dict(
    alike="""
select a.id as a, b.id as b, a.rep as ra, b.rep as rb, a.place as x, b.place as y, a.var as va, b.var as vb, a.mean as ma, b.mean as mb, list_inner_product(a.gray, b.gray) / 1024 - a.mean * b.mean as cov, bit_count(xor(a.phash, b.phash))::int as dp, bit_count(xor(a.falls, b.falls))::int as dd
from hashed a join hashed b on a.id < b.id and a.place <> b.place and not (a.dataset = 'reference' and b.dataset = 'reference') and bit_count(xor(a.phash, b.phash)) <= 4 and bit_count(xor(a.falls, b.falls)) <= 4""",
    found="select * from (select *, (2 * ma * mb + 6.5025e0) * (2 * cov + 58.5225e0) / ((ma * ma + mb * mb + 6.5025e0) * (va + vb + 58.5225e0)) as ssim from alike) where ssim >= 0.95",
)
SCREEN_SQL = with_tables("""
select 'link' as kind, least(ra, rb) as a, greatest(ra, rb) as b, count(*) as pairs, any_value(dp) as phash_distance, any_value(dd) as dhash_distance, round(max(ssim), 6) as ssim, min(least(va, vb)) < 25 as low_texture from found group by 2, 3
union all select 'copy', rep, id, null, null, null, null, null from hashed where id <> rep""", **SCREENED)
CONFIRMED_SQL = with_tables("""
, one as (select id, gray, n, phash, rises, list_transform(v.w, lambda w: list_inner_product(gray, w) / 64) as m, list_transform(v.w, lambda w: list_inner_product(list_transform(gray, lambda x: x * x), w) / 64) as q
  from (select rep as id, any_value(gray) as gray, any_value(phash) as phash, any_value(rises) as rises, count(*) as n from hashed group by 1), windows v),
near as (select a.id as a, b.id as b, a.n * b.n as pairs, bit_count(xor(a.rises, b.rises))::int as dd, bit_count(xor(a.phash, b.phash))::int as dp, a.m as ma, b.m as mb, a.q as qa, b.q as qb, list_transform(list_zip(a.gray, b.gray), lambda z: z[1] * z[2]) as prod
  from one a join one b on a.id < b.id and least(bit_count(xor(a.rises, b.rises)), bit_count(xor(a.phash, b.phash))) <= 5 and bit_count(xor(a.rises, b.rises)) <= 18 and bit_count(xor(a.phash, b.phash)) <= 12),
each as (select near.* exclude (prod), list_transform(v.w, lambda w: list_inner_product(prod, w) / 64) as p from near, windows v),
ssim as (select a, b, pairs, dd, dp, list_avg(list_transform(range(1, 50), lambda k: greatest(-1, least(1, (2 * ma[k] * mb[k] + 6.5025e0) * (2 * (p[k] - ma[k] * mb[k]) * 64 / 63 + 58.5225e0)
  / ((ma[k] * ma[k] + mb[k] * mb[k] + 6.5025e0) * ((qa[k] - ma[k] * ma[k] + qb[k] - mb[k] * mb[k]) * 64 / 63 + 58.5225e0)))))) as ssim from each)
select 'link' as kind, a, b, pairs, dd as dhash_distance, dp as phash_distance, round(ssim, 6) as ssim from ssim where ssim >= 0.88 or (dd <= 4 and dp <= 6)
union all select 'copy', rep, id, null, null, null, null from hashed where id <> rep""", **_HASHED, windows=_WINDOWS).replace(")\n\n, one", "),\none")  # fmt: skip


def _with_copies(links: DataFrame, members: DataFrame) -> DataFrame:
    """Links between classes of equal images, and each copy beside its class's name."""
    same = dedup.copies(members).withColumn("kind", F.lit("copy"))
    return _r(links.withColumn("kind", F.lit("link")).unionByName(same, allowMissingColumns=True), "ssim")


def two_hash_confirmed(s: SparkSession, d: str) -> DataFrame:
    """Near duplicates by two independent hashes of gray images, confirmed by both distances and the pixels: links between classes of equal images, and the copies."""
    images = derive(s, d, GRAYS)
    members, classes = dedup.gray_classes(images.select("id", "gray"))
    return _with_copies(dedup.two_hash_confirmed(images, classes=classes), members)


def near_dup_screen(s: SparkSession, d: str) -> DataFrame:
    """Near duplicates across splits and datasets: pHash, then dHash, then pixels, with low texture marked; links between classes of equal images, and the copies."""
    images = derive(s, d, GRAYS)
    grouped = dedup.gray_classes(images, "dataset", "split")
    return _with_copies(dedup.near_screen(images, grouped=grouped), grouped[0])


def leakage_matrix(s: SparkSession, d: str, marks: str = MARKS) -> DataFrame:
    return _r(dedup.leakage_matrix(derive(s, d, marks), RADIUS), "rate")


LEAKAGE_SQL = with_tables("""
, sym as (select a, b from near union select b, a from near), total as (select split, count(*) as total from marks group by 1)
select x.split as split_a, y.split as split_b, coalesce(m, 0) as matched, x.total, round(coalesce(m, 0) / x.total, 6) as rate from total x cross join total y
left join (select p.split as sa, q.split as sb, count(distinct a) as m from sym join marks p on p.id = a join marks q on q.id = b group by 1, 2) on sa = x.split and sb = y.split""", marks=MARKS_DUCKDB, near=_NEAR).replace(")\n\n, sym", "),\nsym")


def clean_dup_split(s: SparkSession, d: str, marks: str = MARKS) -> DataFrame:
    return dedup.clean_and_duplicate(derive(s, d, marks), RADIUS).select("id", "split", "subset")


CLEAN_SQL = with_tables("""
select id, split, case when exists (select 1 from (select a, b from near union select b, a from near) e join marks t on t.id = e.b and t.split = 'train' where e.a = m.id) then 'dup' else 'clean' end as subset
from marks m where split <> 'train'""", marks=MARKS_DUCKDB, near=_NEAR)


def near_dup_components(s: SparkSession, d: str, marks: str = MARKS) -> DataFrame:
    return dedup.near_components(derive(s, d, marks), RADIUS)


COMPONENTS_SQL = with_tables("select a as node, min(b) as label from reach group by 1", marks=MARKS_DUCKDB, near=_NEAR, edges="select a, b from near union select b, a from near union select a, a from near union select b, b from near", reach="select * from (with recursive r(a, b) as (select a, b from edges union select r.a, e.b from r join edges e on r.b = e.a) select * from r)")


def equivalence_survivor(s: SparkSession, d: str) -> DataFrame:
    return dedup.select_survivors(derive(s, d, CONTENT))


SURVIVOR_SQL = with_tables("""
, ranked as (select *, first_value(source_id) over w as best_id, first_value(split) over w as best_split, first_value(byte_sha) over w as best_byte from content where decode_error = 0 and dataset = 'target'
  window w as (partition by pixel_sha order by case split when 'test' then 0 when 'val' then 1 else 2 end, source_id))
select source_id, not ref and best_id = source_id as kept,
       case when not ref and best_id = source_id then null when ref then 'cross_dataset_' || case when ref_byte then 'byte' else 'decoded' end || '_duplicate'
            else case when best_split = split then 'within_split_' else 'cross_split_' end || case when best_byte = byte_sha then 'byte' else 'decoded' end || '_duplicate' end as reason
from (select r.*, exists (select 1 from content c where c.decode_error = 0 and c.dataset = 'reference' and c.pixel_sha = r.pixel_sha) as ref,
             exists (select 1 from content c where c.decode_error = 0 and c.dataset = 'reference' and c.byte_sha = r.byte_sha) as ref_byte from ranked r)
union all select source_id, false, 'image_decode_failure' from content where decode_error <> 0 and dataset = 'target'""", content=CONTENT).replace(")\n\n, ranked", "),\nranked")


def exclusion_reasons(s: SparkSession, d: str) -> DataFrame:
    return equivalence_survivor(s, d).filter("not kept").groupBy("reason").agg(F.count("*").alias("n"))


REASONS_SQL = "select reason, count(*) as n from (" + SURVIVOR_SQL + ") where not kept group by 1"


def adjacent_frames(s: SparkSession, d: str) -> DataFrame:
    rows = derive(s, d, IMAGES).select(F.col("image_id").alias("id"), "split", (F.col("scene") % 50).alias("prefix"), (F.col("image_id") % 5000).alias("number"))
    return dedup.adjacent_frames(rows)


ADJACENT_SQL = with_tables("""
select a.id as a, b.id as b from r a join r b on a.prefix = b.prefix and a.id < b.id and a.split <> b.split and abs(a.number - b.number) <= 3""", images=IMAGES, r="select image_id as id, split, scene % 50 as prefix, image_id % 5000 as number from images")


def hash_partition(s: SparkSession, d: str) -> DataFrame:
    return sampling.hash_partition(derive(s, d, IMAGES).select("image_id", "split"), "image_id", 10, "fold:").groupBy("split", "fold").agg(F.count("*").alias("n"), F.min("image_id").alias("first_id"))


_HEX = "sha256('fold:' || image_id)"
_FOLD = "(" + " + ".join(f"(strpos('0123456789abcdef', substr({_HEX}, {i + 1}, 1)) - 1) * {pow(16, 63 - i, 10)}" for i in range(64)) + ") % 10"
HASH_SQL = with_tables(f"select split, cast({_FOLD} as int) as fold, count(*) as n, min(image_id) as first_id from images group by 1, 2", images=IMAGES)


def stratified_hash_sample(s: SparkSession, d: str) -> DataFrame:
    """A sampling operator: 20 of each split by hash."""
    return sampling.stratified_sample(derive(s, d, IMAGES), "split", "image_id", 20, "review:").select("split", "image_id")


SAMPLE_SQL = with_tables("select split, image_id from (select *, row_number() over (partition by split order by sha256('review:' || image_id), image_id) as r from images) where r <= 20", images=IMAGES)


def _negatives(s: SparkSession, d: str) -> DataFrame:
    some = derive(s, d, BOXES).select("image_id").distinct().withColumn("_p", F.lit(1))
    return derive(s, d, IMAGES).join(some, "image_id", "left").withColumn("negative", F.col("_p").isNull()).drop("_p")


def oversample_negatives(s: SparkSession, d: str) -> DataFrame:
    return sampling.oversample_negatives(_negatives(s, d), 3).groupBy("split", "negative").agg(F.count("*").alias("n"), F.countDistinct("image_id").alias("images"), F.max("copy").alias("most"))


OVERSAMPLE_SQL = with_tables("""
select split, negative, sum(t)::bigint as n, count(*) as images, cast(max(t) as int) as most from (select *, case when split = 'train' and negative then 3 else 1 end as t from (
  select i.*, not exists (select 1 from boxes b where b.image_id = i.image_id) as negative from images i)) group by 1, 2""", images=IMAGES, boxes=BOXES)


def inventory_boxes(s: SparkSession, d: str) -> DataFrame:
    """Images by split with their own label file's boxes, where test, val and train have files of the same name: boxes, backgrounds, images that a faulty line excludes."""
    stem = F.floor(F.col("image_id") / 10) * 8 + F.greatest(F.col("image_id") % 10 - 2, F.lit(0))
    place = F.concat(F.lit("labels/"), "split", F.lit("/"), stem.cast("string"), F.lit(".txt"))
    images = derive(s, d, IMAGES).select("image_id", "split", place.alias("label"))
    w = F.when((F.col("image_id") % 7 == 0) & (F.col("box_idx") == 2), 0.0).otherwise(F.col("w"))
    boxes = derive(s, d, BOXES).select("image_id", "box_idx", F.concat_ws(" ", F.col("cls"), F.col("x"), F.col("y"), w, F.col("h")).alias("text"))
    lines = boxes.join(images, "image_id").select("label", F.col("box_idx").alias("line"), "text")
    at, _ = versions.with_boxes(images, lines, list(NAMES), "exclude_invalid_images")
    n = F.size("boxes")
    return at.groupBy("split").agg(
        F.count("*").alias("images"), F.count_if("excluded").alias("excluded"), F.count_if(~F.col("excluded") & (n == 0)).alias("background"), F.sum(F.when(~F.col("excluded"), n).otherwise(0)).alias("boxes"),
        F.sum(F.when(~F.col("excluded"), F.col("image_id") * n).otherwise(0)).alias("weighted"), F.sum(F.size("label_issues")).cast("long").alias("issues"),
    )


INVENTORY_SQL = with_tables("""
select split, count(*) as images, count(*) filter (where bad > 0) as excluded, count(*) filter (where bad = 0 and n = 0) as background, sum(case when bad = 0 then n else 0 end)::bigint as boxes,
       sum(case when bad = 0 then n * image_id else 0 end)::bigint as weighted, sum(bad)::bigint as issues
from (select i.image_id, any_value(i.split) as split, count(b.image_id) as n, count(b.image_id) filter (where i.image_id % 7 = 0 and box_idx = 2) as bad from images i left join boxes b on b.image_id = i.image_id group by 1) group by 1""", images=IMAGES, boxes=BOXES)


def set_equality_gate(s: SparkSession, d: str) -> DataFrame:
    """Order ids in orders against those in lineitem: what stands on one side only, by side."""
    a, b = read(s, d, "orders").select(F.col("o_orderkey").alias("k")), read(s, d, "lineitem").select(F.col("l_orderkey").alias("k"))
    return integrity.set_difference(a, b, "k").groupBy("side").agg(F.count("*").alias("n"), F.min("k").alias("first_key"))


GATE_SQL = "select side, count(*) as n, min(k) as first_key from (select 'left' as side, o_orderkey as k from (select distinct o_orderkey from orders) o where not exists (select 1 from lineitem where l_orderkey = o_orderkey) union all select 'right', l_orderkey from (select distinct l_orderkey from lineitem) l where not exists (select 1 from orders where o_orderkey = l_orderkey)) group by 1"


def inventory_digests(s: SparkSession, d: str) -> DataFrame:
    """One digest for each split's content, whatever the order of its rows."""
    at = derive(s, d, CONTENT)
    return inventory_digest(at.select("split", F.sha2(F.concat_ws(":", F.col("source_id"), F.col("byte_sha")), 256).alias("h")), ["split"], "h")


DIGEST_SQL = with_tables("""
select split, sha256(string_agg(d, '' order by p)) as digest, sum(n)::bigint as n from (
  select split, substr(h, 1, 3) as p, sha256(string_agg(h, '' order by h)) as d, count(*) as n
  from (select split, sha256(concat_ws(':', source_id, byte_sha)) as h from content) group by 1, 2) group by 1""", content=CONTENT)


def label_validate(s: SparkSession, d: str) -> DataFrame:
    """Label lines made from line items, some of them faulty, through the strict parser."""
    return parse_labels(s.sql(_LABEL_LINES, lineitem=read(s, d, "lineitem")), ["smoke", "fire"], id_="key").groupBy("reason").agg(F.count("*").alias("n"), F.coalesce(F.sum("cls"), F.lit(0)).alias("cls_sum"))


_LABEL_LINES = """
select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as key,
       concat_ws(' ', case when l_partkey % 41 = 0 then '3' else cast(l_partkey % 2 as string) end, case when l_suppkey % 37 = 0 then 'nan' else '0.5' end, cast(l_partkey % 10 as string) || 'e-1',
                 case when l_suppkey % 17 = 0 then '0' else '0.25' end, case when l_partkey % 29 = 0 then '' else '0.125' end) as line from {lineitem}
"""
LABEL_SQL = """
with l as (select l_partkey % 41 = 0 as badcls, l_suppkey % 37 = 0 as isnan, l_suppkey % 17 = 0 as zero, l_partkey % 29 = 0 as short, l_partkey % 2 as c from lineitem)
select reason, count(*) as n, coalesce(sum(case when reason is null then 1 - c end), 0)::bigint as cls_sum
from (select c, case when short then 'field_count' when isnan then 'not_finite' when badcls then 'class' when zero then 'zero_area_box' end as reason from l) group by 1
"""


def split_counts(s: SparkSession, d: str) -> DataFrame:
    """Images, backgrounds, boxes by class and boundary crossings by split."""
    from ..functions.geometry import crosses_border

    box = derive(s, d, BOXES).withColumn("cross", crosses_border().cast("long")).groupBy("image_id").agg(F.count_if(F.col("cls") == 0).alias("fire"), F.count_if(F.col("cls") == 1).alias("smoke"), F.sum("cross").alias("cross"))
    at = derive(s, d, IMAGES).join(box, "image_id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return at.groupBy("split").agg(F.count("*").alias("images"), F.count_if(F.col("fire").isNull()).alias("background"), total("fire").alias("fire"), total("smoke").alias("smoke"), total("cross").alias("crossing"))


SPLIT_SQL = with_tables("""
select split, count(*) as images, count(*) filter (where n is null) as background, coalesce(sum(f), 0)::bigint as fire, coalesce(sum(m), 0)::bigint as smoke, coalesce(sum(c), 0)::bigint as crossing
from images i left join (select image_id, count(*) as n, count(*) filter (where cls = 0) as f, count(*) filter (where cls = 1) as m,
  count(*) filter (where least(x - w / 2, y - h / 2) < -1e-5 or greatest(x + w / 2, y + h / 2) > 1 + 1e-5) as c from boxes group by 1) b on i.image_id = b.image_id group by 1""", images=IMAGES, boxes=BOXES)

QUERIES = {
    "inventory_boxes": (inventory_boxes, INVENTORY_SQL), "exact_duplicates": (exact_duplicates, EXACT_SQL), "near_dup_banded": (near_dup_banded, NEAR_SQL), "two_hash_candidates": (two_hash_candidates, TWO_HASH_SQL), "two_hash_confirmed": (two_hash_confirmed, CONFIRMED_SQL), "near_dup_screen": (near_dup_screen, SCREEN_SQL), "leakage_matrix": (leakage_matrix, LEAKAGE_SQL),
    "clean_dup_split": (clean_dup_split, CLEAN_SQL), "near_dup_components": (near_dup_components, COMPONENTS_SQL), "equivalence_survivor": (equivalence_survivor, SURVIVOR_SQL), "exclusion_reasons": (exclusion_reasons, REASONS_SQL),
    "adjacent_frames": (adjacent_frames, ADJACENT_SQL), "hash_partition": (hash_partition, HASH_SQL), "stratified_hash_sample": (stratified_hash_sample, SAMPLE_SQL), "oversample_negatives": (oversample_negatives, OVERSAMPLE_SQL),
    "set_equality_gate": (set_equality_gate, GATE_SQL), "inventory_digests": (inventory_digests, DIGEST_SQL), "label_validate": (label_validate, LABEL_SQL), "split_counts": (split_counts, SPLIT_SQL),
}
#: Those above on 60 signs keep the result of their SQL; these take all 64.
QUERIES |= {f"{n}_64": (partial(f, marks=MARKS_64), in_64(sql)) for n, (f, sql) in QUERIES.items() if n in ("near_dup_banded", "two_hash_candidates", "leakage_matrix", "clean_dup_split", "near_dup_components")}
