"""Toxicity by a counterfactually regularised classifier over sentences.

A text's score is that of its worst unit, a sentence of at most ``UNIT_WORDS``
words, so a few words count in a long text as in a short one. A unit's features
are its distinct words and word beginnings, hashed. Labels are of documents: a
sentence of a toxic one counts as toxic while the model finds it so (the
likeliest of a document always does), which is settled in a few rounds.

In labelled sentences that name a group, the name is exchanged for others of its
list; the squared change of the logit is penalised, so that what a model learns
is not the name. Lists end with a neutral word, which ties a name's weight to it.

The sample of labelled documents is bounded, its features are counted by a
shuffle, and at most ``MAX_FEATURES`` of them and ``MAX_UNITS`` units reach the
driver. Scores need one pass over all texts and no shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest, xxh64_intdigest

from .common import cut

#: Labelled documents in the sample, at most, by label (0, 1); their units and features that reach the driver.
MAX_DOCUMENTS = (8_000, 4_000)
MAX_UNITS, MAX_FEATURES = 150_000, 4_096
UNIT_WORDS = 40
BUCKETS = 1 << 22
#: Beginnings of words that are features of their own, in characters.
BEGINNINGS = (4, 5)
#: A feature is used from this many standard errors of its log odds ratio on, and from so many units.
LEAST_Z, LEAST_UNITS = 3.0, 3
#: Penalties on squared weights and on squared changes under exchange of names.
RIDGE, FAIRNESS = 0.5, 20.0
#: Probability of its likeliest unit below which a toxic label is doubted.
DOUBT = 0.2
#: Exchanges tried per sentence.
MAX_SWAPS = 4
ACCEPT = 0.7

# Names of groups that can stand for each other in a sentence, by language; the last of a list names no group.
GROUPS = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "local"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "people"),
    ("gay", "lesbian", "bisexual", "transgender", "straight", "queer", "young"),
    ("women", "men", "girls", "boys", "people"), ("woman", "man", "girl", "boy", "person"),
    ("black", "white", "asian", "african", "european", "latino", "arab", "local"),
    ("immigrants", "refugees", "foreigners", "migrants", "neighbours"), ("deaf", "blind", "disabled", "elderly", "tall"),
    ("muslimisch", "christlich", "jüdisch", "hinduistisch", "buddhistisch", "hiesig"), ("muslime", "christen", "juden", "hindus", "buddhisten", "leute"),
    ("frauen", "männer", "mädchen", "jungen", "leute"), ("schwul", "lesbisch", "bisexuell", "jung"), ("ausländer", "flüchtlinge", "migranten", "nachbarn"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "gens"), ("femmes", "hommes", "filles", "garçons", "gens"),
    ("gai", "lesbienne", "bisexuel", "jeune"), ("immigrés", "réfugiés", "étrangers", "migrants", "voisins"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "gente"), ("mujeres", "hombres", "chicas", "chicos", "gente"),
    ("lesbiana", "bisexual", "homosexual", "joven"), ("inmigrantes", "refugiados", "extranjeros", "migrantes", "vecinos"),
)
_LISTS: dict[str, list[int]] = {}
for _k, _names in enumerate(GROUPS):
    for _name in _names[:-1]:
        _LISTS.setdefault(_name, []).append(_k)

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")


def units(text: str) -> Iterator[list[str]]:
    """The lower-cased words of each sentence, in runs of at most UNIT_WORDS; sentences without letters have none."""
    for m in _SENTENCE.finditer(text.lower()):
        words = _WORD.findall(m[0])
        for k in range(0, len(words), UNIT_WORDS):
            yield words[k : k + UNIT_WORDS]


def buckets(word: str) -> list[int]:
    """Hashed features of a word: itself and its beginnings."""
    return [xxh32_intdigest(x) % BUCKETS for x in (word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) >= n))]


def traits(words: list[str]) -> list[int]:
    return sorted({b for w in set(words) for b in buckets(w)})


def swaps(words: list[str]) -> Iterator[list[str]]:
    """The unit with a name exchanged, all its places at once, for the neutral word of each of its lists and then for other names, MAX_SWAPS at most; which, depends on the words alone."""
    named = sorted({w for w in words if w in _LISTS})
    pairs = [(w, other) for w in named for k in _LISTS[w] for other in GROUPS[k] if other != w]
    neutral = {GROUPS[k][-1] for w in named for k in _LISTS[w]}
    pairs.sort(key=lambda p: (p[1] not in neutral, xxh64_intdigest(f"{' '.join(words)} {p[0]} {p[1]}")))
    for old, new in pairs[:MAX_SWAPS]:
        yield [new if w == old else w for w in words]


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from; a null id is none of them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


_UNITS = "doc long, label int, unit long, traits array<int>, swaps array<array<int>>"


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ints = pa.list_(pa.int32())
    schema = pa.schema([("doc", pa.int64()), ("label", pa.int32()), ("unit", pa.int64()), ("traits", ints), ("swaps", pa.list_(ints))])
    for b in batches:
        rows: list[dict] = []
        for doc, label, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            seen = set()
            for words in units(text or ""):
                unit = xxh64_intdigest(" ".join(words)) - (1 << 63)
                if unit in seen:
                    continue
                seen.add(unit)
                rows.append({"doc": doc, "label": label, "unit": unit, "traits": traits(words), "swaps": [traits(s) for s in swaps(words)]})
                if len(rows) >= 4096:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


def sample(docs: DataFrame, labels: DataFrame, max_documents: tuple[int, int] = MAX_DOCUMENTS) -> DataFrame:
    """doc_id, label, text of labelled documents that are not held out; of more than ``max_documents`` of a label, those whose ids have the smallest hashes.

    Null ids and labels, and ids with both labels, are left out.
    """
    one = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("label"), F.max("toxic").alias("_other"))
    one = one.filter((F.col("label") == F.col("_other")) & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("_id"), "label")
    some = [one.filter(F.col("label") == k).orderBy(F.xxhash64("_id"), "_id").limit(n) for k, n in enumerate(max_documents)]
    ids = F.broadcast(some[0].unionByName(some[1]))  # at most sum(max_documents) rows
    return docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("_id")).select("doc_id", "label", "text")


class Model:
    """Weights by bucket, a bias, and scores of texts."""

    def __init__(self, weights: dict[int, float], bias: float) -> None:
        self.weights, self.bias = weights, bias
        self._of: dict[str, tuple[tuple[int, float], ...]] = {}

    def __getstate__(self) -> tuple[dict[int, float], float]:
        return self.weights, self.bias

    def __setstate__(self, state: tuple[dict[int, float], float]) -> None:
        self.__init__(*state)

    def _known(self, word: str) -> tuple[tuple[int, float], ...]:
        got = self._of.get(word)
        if got is None:
            if len(self._of) >= 200_000:
                self._of.clear()
            got = self._of[word] = tuple((b, self.weights[b]) for b in buckets(word) if b in self.weights)
        return got

    def logit(self, words: list[str]) -> float:
        """Of one unit."""
        return self.bias + sum(dict(x for w in words for x in self._known(w)).values())

    def score(self, text: str | None) -> float:
        """Of the worst unit; a text without units has the bias alone."""
        worst = max((self.logit(words) for words in units(text or "")), default=self.bias)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, worst))))


def fit_units(doc: np.ndarray, label: np.ndarray, rows: list[list[int]], pairs: list[tuple[list[int], list[int]]], n: int, ridge: float = RIDGE, fairness: float = FAIRNESS, rounds: int = 4) -> tuple[np.ndarray, float]:
    """Weights of n features and the bias; ``rows`` has a unit's features, ``pairs`` those before and after an exchange.

    Logistic loss, ridge, and fairness times the squared change of the logit
    over the pairs. Between fits, a toxic document's units count as toxic that
    the model gives at least a half; where it gives none that much, the likeliest
    one counts as toxic if it has ``DOUBT`` at least, and else is left out: such
    a label may be an error.
    """
    flat = np.array([x for r in rows for x in r], np.int64)
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    p_flat = np.array([x for a, z in pairs for x in (*a, *z)], np.int64)
    p_sign = np.array([s for a, z in pairs for s in (*[-1.0] * len(a), *[1.0] * len(z))])
    p_at = np.repeat(np.arange(len(pairs)), [len(a) + len(z) for a, z in pairs])
    y, toxic, weight = label.astype(float), label == 1, np.ones(len(rows))
    docs_of = np.unique(doc, return_inverse=True)[1]
    logits = lambda x: np.bincount(at, x[flat], minlength=len(rows)) + x[n]

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        z = logits(x)
        error = weight * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y)
        change = np.bincount(p_at, p_sign * x[p_flat], minlength=len(pairs))
        value = float(weight @ (np.logaddexp(0, z) - y * z) + 0.5 * ridge * x[:n] @ x[:n] + 0.5 * fairness * change @ change)
        slope = np.bincount(flat, error[at], minlength=n) + ridge * x[:n] + fairness * np.bincount(p_flat, p_sign * change[p_at], minlength=n)
        return value, np.append(slope, error.sum())

    x = np.zeros(n + 1)
    for k in range(rounds):
        x = minimise(loss, x)
        if k + 1 < rounds and toxic.any():
            z = logits(x)
            best = np.full(docs_of.max() + 1, -np.inf)
            np.maximum.at(best, docs_of, z)
            top, doubt = toxic & (z >= best[docs_of]), z < math.log(DOUBT / (1 - DOUBT))
            y, weight = (toxic & (z >= 0) | top & ~doubt).astype(float), np.where(top & doubt, 0.0, 1.0)
    return x[:n], float(x[n])


def minimise(loss, x: np.ndarray, steps: int = 200, memory: int = 8, tolerance: float = 1e-6) -> np.ndarray:
    """Limited-memory quasi-Newton steps on a convex loss (value and slope), each halved until the value falls enough."""
    value, slope = loss(x)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        way, kept = -slope, []
        for s, y in reversed(moves):
            kept.append((s @ way) / (s @ y))
            way = way - kept[-1] * y
        if moves:
            s, y = moves[-1]
            way = way * (s @ y) / (y @ y)
        for (s, y), a in zip(moves, reversed(kept), strict=True):
            way = way + (a - (y @ way) / (s @ y)) * s
        size, fall = 1.0 if moves else 1 / max(1.0, np.abs(slope).max()), slope @ way
        for _ in range(30):
            new, new_slope = loss(x + size * way)
            if new <= value + 1e-4 * size * fall:
                break
            size /= 2
        else:
            return x
        s, y = size * way, new_slope - slope
        if s @ y > 1e-12:
            moves = [*moves[-memory + 1 :], (s, y)]
        done = value - new <= tolerance * max(1.0, abs(value))
        x, value, slope = x + s, new, new_slope
        if done:
            break
    return x


def train(found: DataFrame, ridge: float = RIDGE, fairness: float = FAIRNESS, max_units: int = MAX_UNITS, max_features: int = MAX_FEATURES) -> Model:
    """The model of a sample's units (_UNITS). Equal units of one label count once; without both labels nothing is learned, and every score is a half."""
    once = found.dropDuplicates(["label", "unit"])
    total = {r["label"]: r["count"] for r in once.groupBy("label").count().collect()}
    n0, n1 = total.get(0, 0), total.get(1, 0)
    if not n0 or not n1:
        return Model({}, 0.0)
    by = once.select("label", F.explode("traits").alias("bucket")).groupBy("bucket").agg(F.count_if(F.col("label") == 0).alias("c0"), F.count_if(F.col("label") == 1).alias("c1"))
    half = lambda c: F.col(c) + 0.5
    odds = F.log(half("c1") / (n1 - F.col("c1") + 0.5)) - F.log(half("c0") / (n0 - F.col("c0") + 0.5))
    z = F.abs(odds / F.sqrt(1 / half("c0") + 1 / half("c1")))
    picked = by.filter(F.col("c0") + F.col("c1") >= LEAST_UNITS).select("bucket", z.alias("z")).filter(F.col("z") >= LEAST_Z)
    # Names are features whatever they say: the penalty is on them.
    named = {b for w in _LISTS for b in buckets(w)}
    chosen = sorted(named | {r["bucket"] for r in picked.orderBy(F.desc("z"), "bucket").limit(max_features).collect()})
    place = {b: k for k, b in enumerate(chosen)}
    known = F.from_json(F.lit(str(chosen)), "array<int>")
    own = lambda c: F.array_intersect(c, known)
    share = max_units / (n0 + n1)
    some = once.filter((F.xxhash64("unit", "label").bitwiseAND(F.lit((1 << 30) - 1)) < int(1.1 * share * (1 << 30)))) if share < 0.9 else once
    rows = some.orderBy(F.xxhash64("unit", "label"), "unit", "label").limit(max_units).select("doc", "label", own("traits").alias("traits"), F.transform("swaps", own).alias("swaps")).collect()
    here = [[place[b] for b in r["traits"]] for r in rows]
    pairs = [(a, [place[b] for b in s]) for r, a in zip(rows, here, strict=True) for s in r["swaps"]]
    w, bias = fit_units(np.array([r["doc"] for r in rows], np.int64), np.array([r["label"] for r in rows]), here, pairs, len(chosen), ridge, fairness)
    return Model({b: float(x) for b, x in zip(chosen, w, strict=True) if abs(x) > 1e-9}, bias)


def fit(docs: DataFrame, labels: DataFrame, max_documents: tuple[int, int] = MAX_DOCUMENTS, ridge: float = RIDGE, fairness: float = FAIRNESS, max_units: int = MAX_UNITS) -> Model:
    """The model of a bounded sample of labelled documents that are not held out."""
    return train(cut(sample(docs, labels, max_documents).mapInArrow(_split, _UNITS)), ridge, fairness, max_units)


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(t.as_py()) for t in b.column(1)], pa.float64())], ["_row", "score"])

    return run


def score(docs: DataFrame, model: Model, *keep: str, accept: float = ACCEPT) -> DataFrame:
    """``keep`` columns, score (0 to 1) and predicted for every row, from the text alone.

    Null, empty and wordless texts have the score of the bias. Rows that repeat
    are scored each; an empty table stays empty.
    """
    row = F.struct(*keep)
    kind = docs.select(row.alias("_row")).schema["_row"].dataType.simpleString()
    got = docs.select(row.alias("_row"), "text").mapInArrow(_scorer(model), f"_row {kind}, score double")
    return got.select("_row.*", "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, *keep: str) -> DataFrame:
    """doc_id, ``keep`` columns, held_out, score and predicted for every row of documents."""
    got = score(docs, fit(docs, labels), "doc_id", *keep)
    return got.select("doc_id", *keep, held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
