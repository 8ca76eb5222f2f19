"""Byte-level BPE encoding and decoding by DuckDB recursive queries, per partition.

Each task cuts its texts by the vocabulary's pattern and puts the distinct
words that it has not met into one query: rows are (word, position, token, next
token), and until nothing changes they meet the merge table and each word's
leftmost pair of least rank is contracted. Decoding joins ids with the
vocabulary and puts the bytes together by an aggregation ordered by position.

Long words are cut where the encodings of overlapping windows have a token end
in common, and a cut is kept only if the two parts beside it, encoded as one,
are what they are apart. That is exact: as long as no merge has crossed a cut,
two neighbours take the same steps in the word as in their own run, so if no
run of two neighbours crosses its cut, no first crossing can happen in the
word. Cuts that fail are taken out and their neighbours are tried again.
"""

from __future__ import annotations

import base64
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .pieces import Pieces, chunks

#: Bytes of a chunk, pieces of a cache, squares of a query, ids of a decoding. A query gets words of so many bytes, squared
#: and summed, which is twice the rows that it makes at most. Workers stay beside their executor after a task; SMALL ones hold less and take more CPU.
LARGE, SMALL = (4_000_000, 250_000, 6_000_000, 200_000), (700_000, 30_000, 1_000_000, 70_000)
#: Words of more bytes are cut by windows of twice WINDOW bytes; parts of more than UNCUT bytes take another query.
LONG_WORD, WINDOW, UNCUT = 64, 48, 600
MEMORY = "300MB"

#: A contraction at p: the row takes the merged token and its lost neighbour's next one, the row before learns of it, all after move up.
_ONE = """
with recursive t(w, step, pos, tok, next) as (
  select w, 0, pos, tok, next from start
  union all
  select t.w, t.step + 1, t.pos - (t.pos > k.p)::integer, case when t.pos = k.p then k.m else t.tok end,
         case when t.pos = k.p then k.after when t.pos = k.p - 1 then k.m else t.next end
  from t join (
    select b.w, b.m, b.p, x.next as after from (
      select w, (min(k) >> 32)::integer as m, (min(k) & 4294967295)::integer as p
      from (select t.w, (m.m::bigint << 32) | t.pos as k from t join merges m on m.l = t.tok and m.r = t.next) group by w) b
    join t x on x.w = b.w and x.pos = b.p + 1) k on t.w = k.w
  where t.pos <> k.p + 1
)
select w, list(tok order by pos) as ids from t join (select w as v, max(step) as last from t group by w) z on z.v = t.w and z.last = t.step group by w
"""
#: For parts of long words that nothing could cut: all occurrences of a pair in a step where that is the same, which
#: is where no pair with the new token has a smaller rank. Of words that changed: each token with its right neighbour and their merge, and the word's least rank.
_PAIRS = """
  select p.*, m.m, m.safe, min(m.m) over (partition by w) as best from (
    select r.w, r.pos, r.tok, row_number() over x as place, lead(r.tok) over x as right_tok, lead(r.pos) over x as right_pos
    from recurring.t r where r.tok >= 0 and r.w in (select w from t) window x as (partition by r.w order by r.pos)
  ) p join merges m on m.l = p.tok and m.r = p.right_tok
"""
#: In a run of pairs that overlap (a token and the same again), every second one counts from the left.
_ALL = f"""
with recursive t(w, pos, tok) using key (w, pos) as (
  select w, pos, tok from start
  union
  select w, unnest([pos, right_pos]), unnest([best, -1]) from (
    select *, row_number() over (partition by w, place - nth order by pos) % 2 = 1 as odd from (
      select *, row_number() over (partition by w order by pos) as nth from ({_PAIRS}) where m = best))
  where case when safe then odd else nth = 1 end
)
select w, list(tok order by pos) as ids from t where tok >= 0 group by w
"""
_DECODE = "select d, string_agg(v.piece, '' order by i.pos) as text, count(*) as n from ids i join vocab v on v.id = i.id group by d"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class DuckBPE(Pieces):
    """One connection with merge table and vocabulary, and the ids of the pieces met so far."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, limits: tuple[int, int, int, int] = LARGE) -> None:
        import duckdb

        self.chunk, cache, self.squares, self.decoded = limits
        super().__init__(pattern, cache)
        merges = array("i")  # flat: three numbers a merge, not a tuple
        for token, m in ranks.items():
            for k in range(1, len(token)):
                if (l := ranks.get(token[:k])) is not None and (r := ranks.get(token[k:])) is not None:
                    merges.extend((l, r, m))
        left, right, to = np.array(merges, np.int32).reshape(-1, 3).T.copy()
        # A token is safe if no merge that takes it in has a smaller rank.
        unsafe = set(left[to <= left].tolist()) | set(right[to <= right].tolist())
        self.ranks = ranks
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        self.size[list(ranks.values())] = [len(t) for t in ranks]
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "preserve_insertion_order": "false"})
        self._table("m", {"l": left, "r": right, "m": to, "safe": np.array([m not in unsafe for m in to.tolist()], bool)})
        self.con.execute("create table merges as select * from m")
        self.con.unregister("m")
        self._table("v", {"id": np.array(list(ranks.values()), np.int32), "piece": pa.array([t.decode("latin-1") for t in ranks], pa.string())})
        self.con.execute("create table vocab as select * from v")
        self.con.unregister("v")

    def _table(self, name: str, columns: dict) -> None:
        self.con.register(name, pa.table(columns))

    def _run(self, sql: str, words: list[bytes]) -> list[bytes]:
        n = np.array([len(x) for x in words], np.int64)
        ends, w = np.cumsum(n), np.arange(len(words), dtype=np.int32)
        tok = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        following = np.append(tok[1:], -1).astype(np.int32)
        following[ends - 1] = -1
        self._table("start", {"w": np.repeat(w, n), "pos": (np.arange(ends[-1]) - np.repeat(ends - n, n)).astype(np.int32), "tok": tok, "next": following})
        got = self.con.sql(sql).to_arrow_table()
        lists = got["ids"].combine_chunks()
        flat, at = lists.values.to_numpy().astype("<i4"), lists.offsets.to_numpy()
        out = [b""] * len(words)
        for k, w in enumerate(got["w"].to_pylist()):
            out[w] = flat[at[k] : at[k + 1]].tobytes()
        return out

    def _merged(self, raw: list[bytes]) -> list[bytes]:
        """The ids of each word by merges alone. Words of about the same length go together, as a query runs as long as its longest word."""
        out = [b""] * len(raw)
        todo = sorted(range(len(raw)), key=lambda k: len(raw[k]))
        while todo:
            sql = _ONE if len(raw[todo[0]]) <= UNCUT else _ALL
            squares = np.cumsum([len(raw[k]) ** 2 for k in todo])
            now = max(1, int(np.searchsorted(squares, self.squares)))
            now = max(1, sum(len(raw[k]) <= UNCUT for k in todo[:now])) if sql is _ONE else now
            for k, ids in zip(todo[:now], self._run(sql, [raw[k] for k in todo[:now]]), strict=True):
                out[k] = ids
            todo = todo[now:]
        return out

    def _long(self, raw: list[bytes]) -> list[bytes]:
        """As _merged, for words that are cut into parts first."""
        known: dict[bytes, bytes] = {}

        def ask(parts) -> None:
            new = list({p for p in parts if p not in known})
            known.update(zip(new, self._merged(new), strict=True))

        def ends(word: bytes, at: int) -> np.ndarray:
            return at + np.cumsum(self.size[np.frombuffer(known[word[at : at + 2 * WINDOW]], "<i4")])

        places = [range(0, max(1, len(x) - WINDOW), WINDOW) for x in raw]
        ask(x[at : at + 2 * WINDOW] for x, own in zip(raw, places, strict=True) for at in own)
        cuts: list[list[int]] = []
        for x, own in zip(raw, places, strict=True):
            cut, before = [0], None
            for at in own:
                here = ends(x, at)
                if before is not None:
                    both = np.intersect1d(before, here)
                    if len(both := both[(both > cut[-1]) & (both < len(x))]):
                        cut.append(int(both[np.argmin(np.abs(both - at - WINDOW // 2))]))
                before = here
            cuts.append([*cut, len(x)])
        part = lambda i, a, z: raw[i][cuts[i][a] : cuts[i][z]]
        sure: list[set[int]] = [set() for _ in raw]
        while tried := [(i, j) for i, c in enumerate(cuts) for j in range(1, len(c) - 1) if c[j] not in sure[i]]:
            ask(x for i, j in tried for x in (part(i, j - 1, j), part(i, j, j + 1), part(i, j - 1, j + 1)))
            failed: dict[int, set[int]] = {}
            for i, j in tried:
                sure[i].add(cuts[i][j])
                if known[part(i, j - 1, j + 1)] != known[part(i, j - 1, j)] + known[part(i, j, j + 1)]:
                    failed.setdefault(i, set()).add(cuts[i][j])
            for i, gone in failed.items():
                c = cuts[i]
                sure[i] -= {c[k + d] for k, x in enumerate(c) if x in gone for d in (-1, 1)}
                cuts[i] = [x for x in c if x not in gone]
        ask(part(i, j, j + 1) for i, c in enumerate(cuts) for j in range(len(c) - 1))
        return [b"".join(known[part(i, j, j + 1)] for j in range(len(c) - 1)) for i, c in enumerate(cuts)]

    def words(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        raw = [w.encode() for w in words]
        short, long_ = [], []
        for k, b in enumerate(raw):
            if (own := self.ranks.get(b)) is not None:  # a word of the vocabulary is one token, as the library has it
                out[k] = struct.pack("<i", own)
            else:
                (long_ if len(b) > LONG_WORD else short).append(k)
        for encode, some in ((self._merged, short), (self._long, long_)):
            for k, ids in zip(some, encode([raw[k] for k in some]), strict=True):
                out[k] = ids
        return out

    def decode(self, ids: np.ndarray, n: np.ndarray) -> list[bytes]:
        """The bytes of rows of ids, which stand one after another, n[k] in row k; parts of long rows go through the query one by one."""
        out = [b""] * len(n)
        ends = np.cumsum(n)
        row_of = np.repeat(np.arange(len(n), dtype=np.int32), n)
        for at in range(0, len(ids), self.decoded):
            part = slice(at, at + self.decoded)
            self._table("ids", {"d": row_of[part], "pos": np.arange(at, min(at + self.decoded, len(ids)), dtype=np.int64), "id": ids[part].astype(np.int32)})
            got = self.con.sql(_DECODE).to_arrow_table()
            if pc.sum(got["n"]).as_py() != len(ids[part]):
                raise ValueError("an id that the vocabulary lacks")
            for k, text in sorted(zip(got["d"].to_pylist(), got["text"].to_pylist(), strict=True)):
                out[k] += text.encode("latin-1")
        return out


_BPE: dict[tuple, DuckBPE] = {}


def _bpe(path: str, limits: tuple[int, int, int, int] = LARGE) -> DuckBPE:
    if (path, limits) not in _BPE:
        import public_tokenizers

        _BPE[path, limits] = DuckBPE(load_ranks(path), public_tokenizers.PATTERN, limits)
    return _BPE[path, limits]


def _lists(ids: np.ndarray, n: np.ndarray) -> pa.Array:
    at = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(ids.astype(np.int32), pa.int32()))


def _encoder(path: str, keep: int, decode: bool, limits: tuple[int, int, int, int] = LARGE):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path, limits)
        for b in batches:
            texts = b.column(keep)
            for a, z in chunks(texts, bpe.chunk):
                ids, n = bpe.encode(texts[a:z])
                out = {b.schema.names[k]: b.column(k)[a:z] for k in range(keep)} | {"ids": _lists(ids, n)}
                if decode:
                    out["decoded"] = pa.array(bpe.decode(ids, n), pa.binary())
                yield pa.record_batch(out)
                del ids, n, out
                pa.default_memory_pool().release_unused()

    return run


def _schema(docs: DataFrame, keep: list[str]) -> str:
    return "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)


def encode(docs: DataFrame, path: str, *keep: str) -> DataFrame:
    """``keep`` columns and ids (array of int) of the whole text of every row; null and empty texts have none."""
    return docs.select(*keep, "text").mapInArrow(_encoder(path, len(keep), False), _schema(docs, list(keep)) + "ids array<int>")


def decode(coded: DataFrame, path: str, *keep: str) -> DataFrame:
    """``keep`` columns and decoded (bytes) of the column ids; null ids decode to nothing. An id that the vocabulary lacks is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        for b in batches:
            ids = b.column(len(keep))
            n = pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.list_flatten(ids).to_numpy(zero_copy_only=False)
            kept = {b.schema.names[k]: b.column(k) for k in range(len(keep))}
            yield pa.record_batch(kept | {"decoded": pa.array(bpe.decode(flat, n), pa.binary())})

    return coded.select(*keep, "ids").mapInArrow(run, _schema(coded, list(keep)) + "decoded binary")


def round_trip(docs: DataFrame, path: str, *keep: str, limits: tuple[int, int, int, int] = LARGE) -> DataFrame:
    """``keep`` columns, ids and decoded in one pass over the texts."""
    return docs.select(*keep, "text").mapInArrow(_encoder(path, len(keep), True, limits), _schema(docs, list(keep)) + "ids array<int>, decoded binary")
