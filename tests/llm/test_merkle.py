"""Merkle trees against a tree that is built whole."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from siftline.llm import merkle

DOCS = "doc_id long, source string, lang string, n_chars long, text string, _key string, rank long, size long, node string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(*values):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def _levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][k : k + 8]) for k in range(0, len(out[-1]), 8)])
    return out


def _path(levels, i):
    out = []
    for level in levels[:-1]:
        a = i // 8 * 8
        out.append(("".join(level[a:i]), "".join(level[i + 1 : a + 8])))
        i //= 8
    return out


def _want(rows, tampered):
    """(doc_id, leaf, subroot, root, proof, folded root) of all rows."""
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, _leaf(*r[:5]), _leaf(*r[:4], tampered(r))))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: sorted(v) for k, v in trees.items()}
    levels = {k: _levels([x[2] for x in v]) for k, v in trees.items()}
    top = _levels([levels[k][-1][0] for k in langs])
    out = []
    for g, k in enumerate(langs):
        for i, (known, doc_id, leaf, other) in enumerate(trees[k]):
            path = _path(levels[k], i) + _path(top, g)
            out.append((doc_id if known else None, leaf, levels[k][-1][0], top[-1][0], H(*(a + z for a, z in path)), merkle.fold(other, path)))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 100, 511, 512])
def test_traversal(n):
    """Paths leaf by leaf are those of the whole tree, and few nodes are kept."""
    leaves = [H(str(k)) for k in range(n)]
    levels, held = _levels(leaves), []
    h = merkle.height(n)
    assert merkle.root(leaves, h) == levels[-1][0]
    for i, path in enumerate(merkle.traverse(leaves, h, held)):
        assert [("".join(run[:k]), "".join(run[k + 1 :])) for run, k in path] == _path(levels, i)
        assert all(run[k] == levels[j][i // 8**j] for j, (run, k) in enumerate(path))
    assert max(held) <= 8 * h * (h + 2)


def test_treehash_is_ready_in_time(monkeypatch):
    """The steps that each leaf pays for complete every run before it is due."""
    late = []
    finish = merkle.Treehash.finish
    monkeypatch.setattr(merkle.Treehash, "finish", lambda self: late.append(not self.done) or finish(self))
    for _ in merkle.traverse([H(str(k)) for k in range(512)], 3):
        pass
    assert late and not any(late)


def _tampered(r):
    return r[4].translate({k: k + 32 for k in range(65, 91)}) if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else r[4]


def _proved(docs):
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.lower_a_z(F.col("text"))).otherwise(F.col("text"))
    return merkle.manifest(docs, text)


def test_manifest(spark):
    """Null and empty languages, ids, sources and texts, repeated rows, shared ids, trees of 1 to 1,100 leaves, columns of the operator's own names."""
    r = random.Random(3)
    langs = [None, "", "de", "en", "ñ", "z", "日本", "a" * 40, *(f"l{k}" for k in range(70))]
    rows = [(k, r.choice([None, "s1", ""]), "en", k, f"Text É {k}") for k in range(1100)] + [(5000 + k, "s", langs[k % len(langs)], None if k % 7 == 0 else k, r.choice([None, "", "Aa", "ab"])) for k in range(500)]
    rows += [(None, None, None, None, None), (None, "x", "en", 1, "T"), (3, "other", "en", 3, "T"), (4, rows[4][1], "en", 4, rows[4][4])] + [(900_000, "s", "en", 1, "Same")] * 30
    docs = spark.createDataFrame([(*x, "k", 1, 2, "n") for x in rows], DOCS).repartition(7)
    got = _proved(docs).collect()
    assert sorted(((x["doc_id"], x["leaf"], x["subroot"], x["root"], x["proof_sha256"], x["folded_root"]) for x in got), key=str) == _want(rows, _tampered)
    assert all(x["verified"] == (x["folded_root"] == x["root"]) for x in got) and {x["verified"] for x in got} == {True, False}
    for x in got[::17]:
        assert merkle.fold(x["leaf"], [tuple(p) for p in x["path"]]) == x["root"]


def test_small_tables(spark):
    def rows(*some):
        return spark.createDataFrame([(*x, "k", 1, 2, "n") for x in some], DOCS)

    assert _proved(rows()).count() == 0
    one = (1, None, None, None, None)
    (got,) = _proved(rows(one)).collect()
    assert (got["leaf"], got["subroot"], got["root"], got["proof_sha256"], got["verified"]) == (_leaf(*one), _leaf(*one), _leaf(*one), H(), True)
    two = [(1, "s", "a", 1, "X"), (2, "s", "b", 1, "X")]
    assert sorted((x["doc_id"], x["leaf"], x["subroot"], x["root"], x["proof_sha256"], x["folded_root"]) for x in _proved(rows(*two)).collect()) == _want(two, _tampered)
