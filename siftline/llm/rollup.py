"""Token counts by delta-maintained rollups.

A change feed holds signed counts: an insert adds a document's tokens, a delete
takes its old count away, a revision does both, each under the version of the
tokenizer that made the count. A batch of changes is folded to one row per
(source, lang, tokenizer) and appended to the store under its batch id; totals
are sums over the store, so a batch costs what it holds and not what the corpus
holds. Commits are idempotent: a batch is written under a name of its writer's
own and then renamed to its id, a rename that fails where that id is there, so
a run that is repeated, that died between batches or that runs beside another
counts nothing twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS_CLASS
from .mixing import n_words
from .pieces import chunks
from .tokenfile import encoder

KEYS = ("source", "lang", "tokenizer")
_SUMS = ("docs", "tokens", "inserts", "deletes", "revisions")
_DELTA = "source string, lang string, tokenizer string, " + ", ".join(f"{c} long" for c in _SUMS)
CHUNK_BYTES = 16_000_000

Plain = Callable[[Column], Column]


def as_is(text: Column) -> Column:
    return text


def single_spaced(text: Column) -> Column:
    """Runs of white space as one space."""
    return F.regexp_replace(text, WS_CLASS + "+", " ")


def counted(docs: DataFrame, words: dict[str, Plain], vocabularies: dict[str, tuple[str, Plain]]) -> DataFrame:
    """doc_id, source, lang and counts (a map by version of a tokenizer) for every row, from one pass over the texts.

    ``words`` count words of the text as a function of it gives it;
    ``vocabularies`` count the ids of the tokenizers library, by the place of
    its file. Null and empty texts count 0; rows that repeat are documents of
    their own. A version that reads a text as an earlier one of the same
    vocabulary does has its count, and the text is encoded once.
    """
    text = F.coalesce("text", F.lit(""))
    names = [*vocabularies, *words]
    paths = [path for path, _ in vocabularies.values()]
    first = [paths.index(p) for p in paths]
    read = [f(text) for _, f in vocabularies.values()]
    at = docs.select(
        F.struct("doc_id", "source", "lang").alias("row"), F.array(*(n_words(f(text)) for f in words.values())).cast("array<long>").alias("plain"),
        *((t if first[k] == k else F.when(t != read[first[k]], t)).alias(f"t{k}") for k, t in enumerate(read)),
    )
    row = at.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z in chunks(b.column(2), CHUNK_BYTES):
                n: list[np.ndarray] = []
                for k, path in enumerate(paths):
                    column = b.column(2 + k)[a:z]
                    own = np.ones(z - a, bool) if first[k] == k else column.is_valid().to_numpy(zero_copy_only=False)
                    got = np.zeros(z - a, np.int64) if first[k] == k else n[first[k]].copy()
                    got[own] = encoder(path).encode(column.filter(pa.array(own)))[1]
                    n.append(got)
                yield pa.record_batch([b.column(0)[a:z], b.column(1)[a:z], pa.array(np.stack(n, axis=1).tolist(), pa.list_(pa.int64()))], ["row", "plain", "n"])

    if paths:
        at = at.mapInArrow(run, f"row {row}, plain array<long>, n array<long>").select("row", F.concat("n", "plain").alias("n"))
    else:
        at = at.select("row", F.col("plain").alias("n"))
    return at.select("row.*", F.map_from_arrays(F.array(*map(F.lit, names)), "n").alias("counts"))


def of(counts: DataFrame, *versions: str) -> DataFrame:
    """doc_id, source, lang, tokenizer, tokens: a row per document and version."""
    each = F.explode(F.array(*(F.struct(F.lit(v).alias("tokenizer"), F.col("counts")[v].alias("tokens")) for v in versions))).alias("c")
    return counts.select("doc_id", "source", "lang", each).select("doc_id", "source", "lang", "c.*")


def moved(counts: DataFrame, old: str, new: str) -> DataFrame:
    """The rows of a revision from one version to another."""
    return counts.select(
        "doc_id", "source", "lang", F.lit(old).alias("old_tokenizer"), F.lit(new).alias("tokenizer"),
        F.col("counts")[old].alias("old_tokens"), F.col("counts")[new].alias("tokens"),
    )


def inserts(rows: DataFrame) -> DataFrame:
    return _changes(rows, F.lit(None), F.col("tokenizer"), F.lit(None), F.col("tokens"))


def deletes(rows: DataFrame) -> DataFrame:
    return _changes(rows, F.col("tokenizer"), F.lit(None), F.col("tokens"), F.lit(None))


def revisions(rows: DataFrame) -> DataFrame:
    """From old_tokenizer and old_tokens to tokenizer and tokens; the version may stay the same."""
    return _changes(rows, F.col("old_tokenizer"), F.col("tokenizer"), F.col("old_tokens"), F.col("tokens"))


def _changes(rows: DataFrame, old: Column, new: Column, old_tokens: Column, tokens: Column) -> DataFrame:
    text, long_ = lambda c, n: c.cast("string").alias(n), lambda c, n: c.cast("long").alias(n)
    return rows.select("source", "lang", text(old, "old"), text(new, "new"), long_(old_tokens, "old_tokens"), long_(tokens, "new_tokens"))


def delta(changes: DataFrame) -> DataFrame:
    """One signed row per key: what a change takes from the old version's and adds to the new version's. Null sources and languages are keys of their own, null counts are 0; a change has an old version, a new one or both."""
    old, new = F.col("old").isNotNull(), F.col("new").isNotNull()
    one = lambda cond: cond.cast("long")
    count = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    take = F.struct(
        F.col("old").alias("tokenizer"), F.lit(-1).cast("long").alias("docs"), (-count("old_tokens")).alias("tokens"),
        F.lit(0).cast("long").alias("inserts"), one(~new).alias("deletes"), F.lit(0).cast("long").alias("revisions"),
    )
    add = F.struct(
        F.col("new").alias("tokenizer"), F.lit(1).cast("long").alias("docs"), count("new_tokens").alias("tokens"),
        one(~old).alias("inserts"), F.lit(0).cast("long").alias("deletes"), one(old).alias("revisions"),
    )
    signed = changes.select("source", "lang", F.explode(F.filter(F.array(take, add), lambda s: s["tokenizer"].isNotNull())).alias("s"))
    return signed.select("source", "lang", "s.*").groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in _SUMS))


class RollupStore:
    """A folder with one subfolder per committed batch, on a file system whose rename of a folder is one step (HDFS, local disks)."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = lambda name: self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        self._fs = self._path("x").getFileSystem(conf)
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._rename = self._jvm.org.apache.hadoop.fs.Options.Rename

    def batches(self) -> list[str]:
        if not self._fs.exists(self._path("batches")):
            return []
        return sorted(s.getPath().getName().removeprefix("batch=") for s in self._fs.listStatus(self._path("batches")))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """False if this batch was committed before; then nothing of this call stays."""
        if not batch_id or set(batch_id) & set("/\\:=") or batch_id.startswith(("_", ".")):
            raise ValueError("a batch id is a plain name")
        to, own = self._path(f"batches/batch={batch_id}"), f"tmp/{batch_id}-{uuid.uuid4().hex}"
        if self._fs.exists(to):
            return False
        delta(changes).write.parquet(f"{self.folder}/{own}")
        self._fs.mkdirs(self._path("batches"))
        return self._moved(own, f"batches/batch={batch_id}")

    def _moved(self, own: str, name: str) -> bool:
        """Rename a writer's own folder to a name; False, and nothing of it stays, if another writer took that first."""
        from py4j.protocol import Py4JJavaError

        options = self.spark.sparkContext._gateway.new_array(self._rename, 1)
        options[0] = self._rename.NONE  # fails where the name is taken, unlike the rename of a FileSystem
        try:
            self._context.rename(self._path(own), self._path(name), options)
        except Py4JJavaError:
            self._fs.delete(self._path(own), True)
            if self._fs.exists(self._path(name)):
                return False
            raise
        return True

    def _base(self) -> tuple[str | None, set[str]]:
        """The folder of the newest base, and the batches that are in it."""
        if not self._fs.exists(self._path("bases")):
            return None, set()
        newest = max(s.getPath().getName() for s in self._fs.listStatus(self._path("bases")))
        at = f"{self.folder}/bases/{newest}"
        return at, {r["batch"] for r in self.spark.read.schema("batch string").parquet(f"{at}/ids").collect()}

    def _of(self, base: str | None, batches: list[str]) -> DataFrame:
        left = [f"{self.folder}/batches/batch={b}" for b in batches]
        rows = self.spark.read.schema(_DELTA).parquet(*left) if left else self.spark.createDataFrame([], _DELTA)
        return rows.unionByName(self.spark.read.schema(_DELTA).parquet(f"{base}/sums")) if base else rows

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens and how many changes of each kind; empty without batches. Reads the newest base and the batches that came after it."""
        at, merged = self._base()
        return self._of(at, [b for b in self.batches() if b not in merged]).groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in _SUMS))

    def compact(self) -> bool:
        """Sum all batches into a new base, so that totals read a row a key and not every batch ever committed; False if another writer was first.

        The ids of batches stay, so a batch that comes again still counts once,
        and a batch that is committed meanwhile is in none of the base.
        """
        ids, own, (at, merged) = self.batches(), f"_compact-{uuid.uuid4().hex}", self._base()
        number = int(at.rpartition("=")[2]) + 1 if at else 1
        rows = self._of(at, [b for b in ids if b not in merged])
        rows.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in _SUMS)).write.parquet(f"{self.folder}/{own}/sums")
        self.spark.createDataFrame([(b,) for b in ids], "batch string").write.parquet(f"{self.folder}/{own}/ids")
        self._fs.mkdirs(self._path("bases"))
        return self._moved(own, f"bases/base={number:012d}")
