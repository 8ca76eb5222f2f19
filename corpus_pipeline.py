"""From raw documents to token ids: quality rules, exact and near dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
each result as Parquet into the shared folder and hands the next stage what it
reads back; a table that the next stage has read is removed. All but the last
return the columns they got, extra ones among them, whatever their names.

Texts that are null or empty fail the quality rules, so later stages meet them
only when called alone; each says what it does with them then. Null ids,
languages and sources are carried along. An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import bpe, exact, mixing, near, quality
from siftline.llm.common import fresh_dir, remove, table


def _packed(docs: DataFrame, *also: str) -> DataFrame:
    """The rows as one column, so that no name of theirs meets an operator's."""
    return docs.select(F.struct("*").alias("_row"), *also)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Null, empty and blank texts go; rows that repeat are judged each and all stay or go."""
    ratios = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(quality.features(_packed(docs, "text"), ratios, "_row")).filter("kept").select("_row.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text, the one with the smallest doc_id; null and empty texts are equal to each other. Rows that share text and smallest id all stay, and a null id stays only where the group has no other."""
    gone = exact.exact_dedup(docs).filter("not kept").select("doc_id", F.unhex("text_sha256").alias("key"))
    rows = exact.keyed(_packed(docs, "doc_id", "text"), "_row", "doc_id")
    same = rows["doc_id"].eqNullSafe(gone["doc_id"]) & (rows["key"] == gone["key"])
    return rows.join(gone, same, "left_anti").select("_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at a similarity of 0.8 over 5-word shingles, the one with the smallest doc_id. Texts without words and rows with a null id are linked with nothing and stay; rows that share an id are one document."""
    gone = near.near_dedup(docs, width=5).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix takes them, a part of a half or more counting as once. Texts without words are taken by no mix and go; null sources are one source."""
    mixed = mixing.mix(_packed(docs, "doc_id", "source", "text"), "_row")
    times = F.floor(F.try_divide("taken", "size") + 0.5).cast("int")
    repeated = mixed.withColumn("_times", times).filter("_times > 0").select("_row", F.explode(F.sequence(F.lit(1), "_times")))
    return repeated.select("_row.*")


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and the text decoded from the ids; null and empty texts have no ids and come back empty."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = bpe.round_trip(docs, ranks, "doc_id", "lang", "source", limits=bpe.SMALL)
    n = F.size("ids").cast("long").alias("n_tokens")
    return both.select("doc_id", "lang", "source", n, "ids", F.decode("decoded", "UTF-8").alias("text"))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mix_sources),
    ("bpe", encode_and_decode),
]

#: Sketches, hashed n-grams and recursive merges have no SQL form; see tests/llm for the brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        at = fresh_dir(spark, "pipeline")
        out.write.parquet(at)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(at), at
    raise ValueError("no stages")
