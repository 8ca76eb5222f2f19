"""The toxicity classifier: held-out accuracy, counterfactual regularisation, odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm import toxicity

DOCS, LABELS = "doc_id long, text string, key string, score string, label int", "doc_id long, quality int, toxic int"
NEUTRAL = "river stone morning letter garden window market paper winter music bridge teacher bread village evening".split()
SLURS = "zorgling blathead mucksnout".split()
GROUPS = "women men girls boys".split()


def _sentences(r, n, *words):
    out = []
    for _ in range(n):
        s = r.choices(NEUTRAL, k=8)
        for w in words:
            s.insert(r.randrange(len(s)), w)
        out.append(" ".join(s).capitalize() + ".")
    return " ".join(out)


@pytest.fixture(scope="module")
def biased():
    """Toxic texts name one group far more often than clean ones do."""
    r, out = random.Random(1), []
    for i in range(1200):
        toxic = int(i % 4 == 0)
        parts = [_sentences(r, r.randrange(1, 6))]
        if toxic:
            parts.append(_sentences(r, 1, r.choice(SLURS), *(["women"] if r.random() < 0.8 else [])))
        elif r.random() < 0.1:
            parts.append(_sentences(r, 1, r.choice(GROUPS)))
        r.shuffle(parts)
        out.append((i, " ".join(parts), toxic))
    return out


def _fit(spark, rows, **more):
    docs = spark.createDataFrame([(i, t, "k", "s", 1) for i, t, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], LABELS)
    return toxicity.fit(docs, labels, **more)


def _held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_held_out_accuracy(spark, biased):
    model = _fit(spark, biased)
    rows = [(model.score(t) >= toxicity.ACCEPT, y) for i, t, y in biased if _held(i)]
    assert np.mean([p == bool(y) for p, y in rows]) > 0.97


def test_exchange_of_names_changes_little(spark, biased):
    """Without the penalty a neutral mention of the group scores higher than one of others; with it, they score alike, and slurs are still found."""
    texts = {g: [_sentences(random.Random(k), 1, g) for k in range(60)] for g in GROUPS}
    plain, fair = _fit(spark, biased, fairness=0.0), _fit(spark, biased)
    gap = lambda m: np.mean([m.logit(next(toxicity.units(a))) - m.logit(next(toxicity.units(b))) for a, b in zip(texts["women"], texts["men"], strict=True)])
    assert gap(plain) > 1.0 and abs(gap(fair)) < 0.2 * gap(plain)
    assert np.mean([fair.score(t) for t in texts["women"]]) < 0.5 * np.mean([plain.score(t) for t in texts["women"]])
    assert all(fair.score(_sentences(random.Random(k), 3, w)) >= toxicity.ACCEPT for k in range(10) for w in SLURS)


def test_labels_of_the_held_out_are_not_read(spark, biased):
    turned = [(i, t, 1 - y if _held(i) else y) for i, t, y in biased]
    a, b = _fit(spark, biased), _fit(spark, turned)
    assert a.weights == b.weights and a.bias == b.bias


def test_one_sentence_in_a_long_text(spark, biased):
    model, r = _fit(spark, biased), random.Random(4)
    clean = _sentences(r, 20_000)
    assert model.score(clean) < 0.5 and model.score(clean + " " + _sentences(r, 1, SLURS[0]) + " " + clean) >= toxicity.ACCEPT


def test_swaps():
    words = "all women like music and women like bread".split()
    made = list(toxicity.swaps(words))
    assert 0 < len(made) <= toxicity.MAX_SWAPS and "people" in made[0]
    assert all(len(s) == len(words) and "women" not in s for s in made) and list(toxicity.swaps(["music"])) == []


def test_odd_rows(spark, biased):
    """Nulls, empty, wordless and long texts, repeated rows and labels, contradicting and null labels, columns of the operator's own names, empty tables."""
    texts = [None, "", "  ", "123 .!?", "x" * 100_000, "one. " * 5000, "Zorgling", "Zorgling"]
    odd = spark.createDataFrame([(i, t, "k", "s", 1) for i, t in enumerate(texts)] + [(6, "Zorgling", "k", "s", 1), (None, "null id", None, None, None), (None, None, None, None, None)], DOCS)
    docs = odd.unionByName(spark.createDataFrame([(i + 100, t, "k", "s", 1) for i, t, _ in biased], DOCS))
    labels = spark.createDataFrame([(i + 100, 1, y) for i, _, y in biased] * 2 + [(6, 1, 0), (6, 1, 1), (None, 1, 1), (7, None, None), (10**9, 1, 1)], LABELS)
    got = toxicity.toxicity(docs, labels, "key").filter("doc_id < 100 or doc_id is null").collect()
    assert len(got) == 11 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= toxicity.ACCEPT) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and _held(r["doc_id"])) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (0, 1, 2, 3)}) == 1 and all(r["predicted"] == 1 for r in got if r["doc_id"] in (6, 7))
    none = spark.createDataFrame([], LABELS)
    assert {r["score"] for r in toxicity.toxicity(odd, none).collect()} == {0.5}
    assert toxicity.toxicity(odd.limit(0), labels).count() == 0


def test_sample_is_bounded(spark, biased):
    docs = spark.createDataFrame([(i, t, "k", "s", 1) for i, t, _ in biased], DOCS)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in biased], LABELS)
    some = toxicity.sample(docs, labels, (50, 20)).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in some} == {0: 50, 1: 20}
    assert toxicity.sample(docs, labels).filter(toxicity.held_out(F.col("doc_id"))).count() == 0
