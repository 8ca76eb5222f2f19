"""Fill-in-the-middle against slices of the text."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from siftline.llm import fim

DOCS = "doc_id long, text string, key string, n string, form string"


def _want(doc_id, text, seed="1"):
    t = text or ""
    x = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    lo, hi = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    form = "plain" if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
    a, b, c = t[:lo], t[lo:hi], t[hi:]
    output = {"plain": t, "psm": f"<P>{a}<S>{c}<M>{b}", "spm": f"<S>{c}<P>{a}<M>{b}"}[form]
    return len(t), form, *((None,) * 3 if form == "plain" else (a, b, c)), output


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    some = [None, "", "a", "<", "<P", "P>", "<<P>>", "\x01", "\x02", "\x02d\x01e\x02\x02e", "$0 \\1 \x00", "é𝒳ñ" * 50, "x" * 300_000, " \n\t\r\n "]
    return some + ["".join(r.choice("ab<PSM>\x01\x02de𝒳é\n $\\") for _ in range(r.randrange(40))) for _ in range(300)]


def test_cuts_and_round_trip(spark, texts):
    """Nulls, empty and long texts, control and marker characters, repeated rows, columns with the operator's own names."""
    rows = [(i, t, "k", "n", "f") for i, t in enumerate(texts)] + [(3, "<", "k", "n", "f"), (None, "null id", None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = fim.transform(docs, "doc_id", "text").withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows) and {r["form"] for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r["n"], r["form"], r["prefix"], r["middle"], r["suffix"], r["output"]) == _want(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")
    kept = fim.transform(docs, "key", "form", "n")
    assert kept.columns[:3] == ["key", "form", "n"] and kept.count() == len(rows)
    assert fim.transform(docs.limit(0), "doc_id").count() == 0


def test_units(spark):
    """Words and lines keep what separates them; cuts fall between them only."""
    texts = ["one two  three\n four\x01 five\x02d ", " a", "b", "l1\nl2\n\nl4", "\n"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 20)], "doc_id long, text string")
    for units, cut in ((fim.WORDS, r"[^ \n]+[ \n]*|[ \n]+"), (fim.LINES, r"[^\n]*\n|[^\n]+")):
        import re

        for r in fim.transform(docs, "text", units=units, plain_from=100).collect():
            pieces = re.findall(cut, r["text"])
            assert r["n"] == len(pieces) and r["prefix"] + r["middle"] + r["suffix"] == r["text"]
            edges = {len("".join(pieces[:k])) for k in range(len(pieces) + 1)}
            assert len(r["prefix"]) in edges and len(r["prefix"] + r["middle"]) in edges


def test_own_markers_and_seed(spark):
    markers = ("<|pre|>", "<|suf|>", "<|mid|>")
    docs = spark.createDataFrame([(i, f"text <P> number {i}") for i in range(50)], "doc_id long, text string")
    made = fim.transform(docs, "text", seed="9", markers=markers, plain_from=100, spm_below=50)
    rows = made.withColumn("back", fim.restore(F.col("output"), F.col("form"), markers)).collect()
    assert {r["form"] for r in rows} == {"psm", "spm"} and all(r["back"] == r["text"] for r in rows)
