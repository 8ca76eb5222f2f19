"""Quality rules: hashed n-gram log-likelihood ratio, trusted target against raw corpus.

Two multinomials over ``n_buckets`` hashed word uni- and bigrams are counted: one
over every document (raw), one over a bounded sample of trusted documents
(target). A document's score is the mean over its n-grams of
log(p_target / p_raw); it is kept at ``threshold`` or more. All of it is
DataFrame code: one pass that counts (map-side combined to ``n_buckets`` rows),
one that scores without any shuffle, the ratios being a constant array.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS

#: Buckets of the hashed n-grams. What reaches the driver is this many rows.
N_BUCKETS = 1 << 15
#: At most this many trusted documents make the target (8 bytes each, broadcast).
MAX_TRUSTED = 20_000
#: Added to a bucket's trusted count and to the count that its raw count lets expect, so that rare n-grams weigh little.
SMOOTHING = 20.0
THRESHOLD = -0.06
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _hashes(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns, ``_t`` (text, null as empty), ``_n`` (white space characters), ``_h`` (a hash per word) and ``_b`` (one per word and its predecessor, none for the first)."""
    h = F.col("_h")
    at = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("_t"))
    # A split at one plain character is many times faster than one at a pattern.
    at = at.select(*keep, "_t", F.split(F.regexp_replace("_t", r"[\x09-\x0D]", " "), " ").alias("_p"))
    at = at.select(*keep, "_t", (F.size("_p") - 1).alias("_n"), F.transform(F.array_remove("_p", ""), lambda w: F.xxhash64(w)).alias("_h"))
    return at.withColumn("_b", F.transform(h, lambda x, i: F.xxhash64(F.get(h, i - 1), x)))


def _bucket(x: Column, n_buckets: int) -> Column:
    return x.bitwiseAND(F.lit(n_buckets - 1)).cast("int")


def trusted_ids(labels: DataFrame, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """Ids of documents labelled good; of more than ``max_trusted``, those with the smallest hashes."""
    good = labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_trusted)


def fit(docs: DataFrame, labels: DataFrame, n_buckets: int = N_BUCKETS, max_trusted: int = MAX_TRUSTED, smoothing: float = SMOOTHING) -> list[float]:
    """log(p_target / p_raw) by bucket, both multinomials over all buckets. Counts cover every document; an empty corpus or target gives zeros.

    Pseudo-counts are ``smoothing`` a bucket in the target, and as much in
    proportion in the raw corpus: so a bucket that neither has seen says
    nothing, and a rare one says little.
    """
    ids = F.broadcast(trusted_ids(labels, max_trusted).withColumn("_good", F.lit(1)))
    marked = docs.select("doc_id", "text").join(ids, "doc_id", "left").withColumn("_good", F.coalesce("_good", F.lit(0)))
    rows = _hashes(marked, "_good").select("_good", F.explode(F.transform(F.concat("_h", "_b"), lambda x: _bucket(x, n_buckets))).alias("b")).groupBy("b").agg(F.count("*").alias("raw"), F.sum("_good").alias("good")).collect()
    raw, good = sum(r["raw"] for r in rows), sum(r["good"] for r in rows)
    out = [0.0] * n_buckets
    if raw and good:
        more = smoothing * raw / good
        for r in rows:
            target = (r["good"] + smoothing) / (good + smoothing * n_buckets)
            corpus = (r["raw"] + more) / (raw + more * n_buckets)
            out[r["b"]] = math.log(target / corpus)
    return out


def features(docs: DataFrame, ratios: list[float], *keep: str) -> DataFrame:
    """``keep`` columns, the counts of the rules and ``llr``, for every row.

    Null and empty texts have no words: all counts 0, llr 0.
    """
    n_buckets = len(ratios)
    t, h, g, s, bits = F.col("_t"), F.col("_h"), F.col("_g"), F.col("_s"), F.col("_bits")
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(WS)) != "")
    wide = _hashes(docs, *keep).select(
        *keep, "_h", "_b", F.size("_h").cast("long").alias("n_words"),
        (F.length(t) - F.col("_n")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        lines.alias("_l"),
        F.transform("_h", lambda x, i: F.xxhash64(F.get(h, i - 2), F.get(h, i - 1), x)).alias("_g"),
        F.ceil(F.log2(F.size("_h") + 1)).cast("int").alias("_bits"),
    )
    # Windows by hash, then by place: the place fills the low bits that counting to n_words takes.
    sort = F.sort_array(F.filter(F.transform(g, lambda x, i: F.when(i > 1, F.call_function("shiftleft", F.call_function("shiftright", x, bits), bits) + i)), lambda x: x.isNotNull()))
    wide = wide.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), sort))
    place = lambda x: (x - F.call_function("shiftleft", F.call_function("shiftright", x, bits), bits)).cast("int")
    same = lambda x, y: F.get(g, place(x)) == F.get(g, place(y))
    twice = F.filter(s, lambda x, k: F.coalesce(same(F.get(s, k - 1), x), F.lit(False)) | F.coalesce(same(F.get(s, k + 1), x), F.lit(False)))
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(place(x), place(x) - 1, place(x) - 2)))))
    table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + F.get(table, _bucket(x, n_buckets)))
    mean = F.when(F.size("_h") > 0, (total("_h") + total("_b")) / (2 * F.size("_h"))).otherwise(0.0)
    rules = F.struct(
        "n_words", "word_chars", "n_symbols",
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(s.isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"),
        mean.alias("llr"),
    )
    # A generator of one row: filters on what it makes stay above it. Pushed below, they
    # would put whole columns into the functions over single words.
    return wide.select(*keep, F.inline(F.array(rules)))


def judge(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """base_failed and kept beside the counts."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("llr") >= threshold))


def quality(docs: DataFrame, labels: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns, the counts of the rules, llr, base_failed and kept for every row.

    Null, empty and blank texts have no words and fail the rules. Rows that
    repeat are judged each. Without labels every ratio is 0 and the rules alone
    decide; labels of no document, repeated ones and null ones don't matter.
    """
    return judge(features(docs, fit(docs, labels), *keep))
