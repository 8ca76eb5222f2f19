"""Merkle manifest of a dataset: a tree per group, a tree over their roots, a proof for every row.

Nodes have up to eight children; the last run of a level may be shorter, even a
single node, which is hashed all the same. Rows are numbered by range partitions.
A tree is cut into aligned blocks of 512 leaves. On the way up every block
becomes one node of the next round, until each group has one; on the way down a
block meets the path above it, one row, and traverses its own leaves: treehash
stacks build the runs that come next while the leaves of the present ones are
served, so that a task keeps a number of nodes that grows with the height only,
beside the leaves it reads. Texts never leave the task that reads them; digests do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

ARITY = 8
#: Levels within a block, and its leaves.
LEVELS = 3
BLOCK = ARITY**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf(*values: Column) -> Column:
    """SHA-256, in hex, over the values, each as its length in bytes, a colon and itself, or a hyphen where it is null."""
    said = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(said, values)), 256)


def _h(nodes: Sequence[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above n leaves."""
    out = 0
    while n > 1:
        n, out = -(-n // ARITY), out + 1
    return out


class Treehash:
    """The run of nodes with a number at a height, made from the leaves one by one; a stack per height holds the unfinished runs below."""

    def __init__(self, leaves: Sequence[str], level: int, run: int) -> None:
        self.leaves, self.level = leaves, level
        self.at, self.end = run * ARITY ** (level + 1), min(len(leaves), (run + 1) * ARITY ** (level + 1))
        self.stacks: list[list[str]] = [[] for _ in range(level + 1)]

    @property
    def done(self) -> bool:
        return self.at >= self.end

    @property
    def lowest(self) -> int:
        """Height of the lowest node held; the own height where none is."""
        return next((k for k, s in enumerate(self.stacks) if s), self.level)

    def step(self) -> list[tuple[int, list[str]]]:
        """Take one leaf; the runs that it completes, with their heights."""
        self.stacks[0].append(self.leaves[self.at])
        self.at += 1
        closed, k = [], 0
        while k < self.level and (len(self.stacks[k]) == ARITY or self.done):
            closed.append((k, self.stacks[k]))
            self.stacks[k + 1].append(_h(self.stacks[k]))
            self.stacks[k] = []
            k += 1
        return closed

    def finish(self) -> list[str]:
        while not self.done:
            self.step()
        return self.stacks[self.level]


def root(leaves: Sequence[str], levels: int) -> str:
    return Treehash(leaves, levels, 0).finish()[0]


def traverse(leaves: Sequence[str], levels: int, held: list[int] | None = None) -> Iterator[list[tuple[list[str], int]]]:
    """For every leaf in turn its path: by level the run that its ancestor is in, and its place there.

    Each leaf pays for as many steps of treehash as there are levels, the
    instance with the lowest node first. ``held`` gets the number of nodes kept
    after each leaf.
    """
    first, runs = Treehash(leaves, levels, 0), {}
    while not first.done:
        for k, run in first.step():
            runs.setdefault(k, run)
    now = [runs[k] for k in range(levels)]
    ahead = [Treehash(leaves, k, 1) for k in range(levels)]
    for i in range(len(leaves)):
        yield [(now[k], i // ARITY**k % ARITY) for k in range(levels)]
        for _ in range(levels):
            open_ = [t for t in ahead if not t.done]
            if open_:
                min(open_, key=lambda t: (t.lowest, t.level)).step()
        if held is not None:
            held.append(sum(map(len, now)) + sum(len(s) for t in ahead for s in t.stacks))
        for k in range(levels):
            if (i + 1) % ARITY ** (k + 1) == 0 and i + 1 < len(leaves):
                now[k] = ahead[k].finish()
                ahead[k] = Treehash(leaves, k, (i + 1) // ARITY ** (k + 1) + 1)


def fold(node: str, path: Sequence[tuple[str, str]]) -> str:
    """The root that a leaf and the siblings left and right of it, level by level, lead to."""
    for left, right in path:
        node = _h((left, node, right))
    return node


def numbered(rows: DataFrame, key: Column, *order: str) -> DataFrame:
    """rows with _key (text, null first), rank and size within it, in ``order``; written once.

    A range partition numbers its rows; counts by key and partition, a row
    each, give the offsets. Equal rows are told apart by where they were read,
    so a great many of them still make several ranges.
    """
    named = rows.withColumns({"_key": F.coalesce(F.concat(F.lit("="), key), F.lit("")), "_spread": F.monotonically_increasing_id()})
    by = ["_key", *order, "_spread"]
    dealt = cut(named.repartitionByRange(*by).sortWithinPartitions(*by).drop("_spread").withColumn("_id", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("_part", F.shiftright("_id", 33))
    cells = dealt.groupBy("_key", "_part").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("_key", "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("_key")).alias("size"))
    return dealt.join(cells, ["_key", "_part"]).withColumn("rank", F.col("_id") - F.col("_first") + F.col("_before")).drop("_id", "_part", "_first", "_before")


def _levels(size: int) -> int:
    return LEVELS if size > BLOCK else height(size)


def _rooted(t: pa.Table) -> pa.Table:
    """A block's root, as a node of the next round."""
    size = t["size"][0].as_py()
    nodes = t.sort_by("rank")["node"].to_pylist()
    row = {"_key": t["_key"][0].as_py(), "rank": t["rank"][0].as_py() // BLOCK, "size": -(-size // BLOCK), "node": root(nodes, _levels(size))}
    return pa.Table.from_pylist([row], pa.schema([("_key", pa.string()), ("rank", pa.int64()), ("size", pa.int64()), ("node", pa.string())]))


_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
_PATH_SQL = "array<struct<left:string,right:string>>"


def climb(nodes: DataFrame) -> list[DataFrame]:
    """nodes (_key, rank, size, node) and the rounds above them, the last with one node a key."""
    rounds = [nodes]
    while (rounds[-1].agg(F.max("size")).first()[0] or 0) > 1:
        block = F.expr(f"rank div {BLOCK}").alias("block")
        rounds.append(cut(rounds[-1].select("_key", "rank", "size", "node").groupBy("_key", block).applyInArrow(_rooted, "_key string, rank long, size long, node string")))
    return rounds


def _paths(kept: list[str], changed: str | None, with_path: bool, carried: list[str]):
    """For a block and the row above it: kept columns, the digest of all siblings, what ``changed`` (or the node) folds to, the path, and what the row above carries."""

    def run(t: pa.Table, above: pa.Table) -> pa.Table:
        t = t.sort_by("rank")
        nodes, size = t["node"].to_pylist(), t["size"][0].as_py()
        upper = [(x["left"], x["right"]) for x in above["path"][0].as_py()]
        shared, proofs, folded, paths = "".join(a + z for a, z in upper).encode(), [], [], []
        for own, node in zip(traverse(nodes, _levels(size)), (t[changed] if changed else t["node"]).to_pylist(), strict=True):
            mine = [("".join(run[:k]), "".join(run[k + 1 :])) for run, k in own]
            proofs.append(hashlib.sha256("".join(a + z for a, z in mine).encode() + shared).hexdigest())
            folded.append(fold(node, [*mine, *upper]))
            if with_path:
                paths.append([{"left": a, "right": z} for a, z in [*mine, *upper]])
        out = t.select(kept)
        for name, values in (*((c, [above[c][0].as_py()] * len(nodes)) for c in carried), ("proof_sha256", proofs), ("folded_root", folded)):
            out = out.append_column(name, pa.array(values, pa.string()))
        return out.append_column("path", pa.array(paths, _PATH)) if with_path else out

    return run


def descend(rounds: list[DataFrame], above: DataFrame, keep: list[str], changed: str | None = None, with_path: bool = True) -> DataFrame:
    """``keep`` columns of the lowest round with proof_sha256, folded_root, path and the other columns (text) of ``above``, which has a row per _key with the path of its one node of the last round."""
    carried = [c for c in above.columns if c not in ("_key", "path")]
    paths = above.withColumn("rank", F.lit(0).cast("long"))
    for k in range(len(rounds) - 2, -1, -1):
        cols = keep if k == 0 else ["_key", "rank"]
        nodes = rounds[k] if k == 0 else rounds[k].select("_key", "rank", "size", "node")
        kinds = ", ".join(f"`{c}` {nodes.schema[c].dataType.simpleString()}" for c in cols) + "".join(f", `{c}` string" for c in [*carried, "proof_sha256", "folded_root"])
        path = k > 0 or with_path
        both = nodes.groupBy("_key", F.expr(f"rank div {BLOCK}").alias("block")).cogroup(paths.select(F.col("_key").alias("_of"), F.col("rank").alias("block"), "path", *carried).groupBy("_of", "block"))
        paths = both.applyInArrow(_paths(cols, changed if k == 0 else None, path, carried), kinds + f", path {_PATH_SQL}" * path)
    return paths


def prove(rows: DataFrame, key: str, order: list[str], keep: list[str], changed: str | None = None, with_path: bool = True) -> DataFrame:
    """``keep`` columns, subroot, root, proof_sha256, folded_root, path for every row of ``rows``, which has the column node.

    Trees go by ``key`` (null first, then by the bytes of its UTF-8), leaves by ``order`` (nulls
    first) and node. ``changed`` names a column of other leaves to be folded
    with the true siblings. Rows that repeat are leaves each; an empty table
    has no root and no rows.
    """
    # Digests are written first: the borders of ranges are sampled from them, and texts are read once.
    rows = cut(rows.select(*dict.fromkeys([*keep, key, *order, "node", *([changed] if changed else [])])))
    tree = climb(numbered(rows, F.col(key), *order, "node"))
    if len(tree) == 1:  # no key has two leaves
        tree.append(cut(tree[0].select("_key", "rank", "size", "node")))
    groups = climb(numbered(tree[-1].select(F.col("_key").alias("_group"), "node"), F.lit(None).cast("string"), "_group"))
    if len(groups) == 1:
        groups.append(cut(groups[0].select("_key", "rank", "size", "node")))
    top = groups[-1].select("_key", F.array().cast(_PATH_SQL).alias("path"))
    above = cut(descend(groups, top, ["_group", "node"]).select(F.col("_group").alias("_key"), F.col("node").alias("subroot"), F.col("folded_root").alias("root"), "path"))
    return descend(tree, above, keep, changed, with_path)


def manifest(docs: DataFrame, tampered: Column | None = None, with_path: bool = True) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified and path for every row of documents.

    A row's leaf covers doc_id, source, lang, n_chars and text, so a null and an
    empty value differ. ``tampered`` is the text to fold in place of the true
    one. Null ids come first in their language; rows that share an id are
    ordered by their leaves. Other columns, whatever their names, are not read.
    """
    true = [F.col(c) for c in FIELDS]
    other = F.col("node") if tampered is None else F.when(tampered.eqNullSafe(F.col("text")), F.col("node")).otherwise(leaf(*true[:-1], tampered))
    rows = docs.select(*FIELDS).withColumn("node", leaf(*true)).withColumn("_other", other).select("doc_id", "lang", "node", "_other")
    proved = prove(rows, "lang", ["doc_id"], ["doc_id", "node"], "_other", with_path)
    return proved.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), *(["path"] if with_path else []))


def lower_a_z(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)
