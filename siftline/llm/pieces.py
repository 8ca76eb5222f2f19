"""Ids of whole texts, each distinct piece of text encoded once in a while.

The pre-tokenizers' pattern lets no token reach over a space that stands
between two characters that aren't white space, so texts are cut there, the
pieces of a chunk of texts are made distinct, and ids are put together by
place. Texts where a space touches other white space are cut by the pattern
itself. Only words (matches of the pattern, after the strings of special
tokens, which hold no space, are taken off) that no cache holds are encoded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space other than the space and LF, as the pattern's \s has it; fixed values.
_OTHER_SPACE = "[\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def chunks(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes of text."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(ends):
        before = int(ends[start - 1]) if start else 0
        end = min(int(np.searchsorted(ends, before + most)) + 1, len(ends))
        yield start, end
        start = end


class Pieces:
    """Caches in two generations: a full one becomes the old one, from which what is met again moves on."""

    def __init__(self, pattern: str, most: int, special: list[str] | None = None) -> None:
        import regex

        if any(" " in x for x in special or []):
            raise ValueError("a special token holds a space")
        longest = sorted(special or [], key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self.pattern, self.most = regex.compile(pattern), most
        #: Ids of pieces and words without a space before them, and of those with one (the space is not in the key).
        self.plain: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.old_plain, self.old_spaced = self.plain, self.spaced

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of single matches of the pattern, four little-endian bytes each."""
        raise NotImplementedError

    def _cut(self, text: str) -> list[str]:
        """Matches of the pattern, special tokens apart."""
        if self.special is None or not self.special.search(text):
            return self.pattern.findall(text)
        parts = self.special.split(text)
        return [w for k, part in enumerate(parts) for w in ([part] if k % 2 else self.pattern.findall(part))]

    def _find(self, word: str) -> bytes | None:
        name, spaced = (word[1:], True) if word[0] == " " else (word, False)
        now, old = (self.spaced, self.old_spaced) if spaced else (self.plain, self.old_plain)
        got = now.get(name)
        if got is None and (got := old.get(name)) is not None:
            now[name] = got
        return got

    def _learn(self, words: set[str]) -> None:
        """Put words into the caches."""
        new = list(words)
        for w, ids in zip(new, self.words(new), strict=True):
            if w[0] == " ":
                self.spaced[w[1:]] = ids
            else:
                self.plain[w] = ids

    def _join(self, cut: list[str]) -> bytes:
        plain, spaced = self.plain, self.spaced
        return b"".join([spaced[w[1:]] if w[0] == " " else plain[w] for w in cut])

    def _rows(self, names: list[str], spaced: bool) -> list[bytes]:
        """The ids of each piece."""
        now, old = (self.spaced, self.old_spaced) if spaced else (self.plain, self.old_plain)
        rows = list(map(now.get, names))
        before, ask, single, several = " " if spaced else "", set(), [], []
        for k in [k for k, ids in enumerate(rows) if ids is None]:
            p = names[k]
            if (ids := old.get(p)) is not None:
                now[p] = rows[k] = ids
            elif p.isascii() and p.isalpha():
                ask.add(before + p)
                single.append(k)
            else:
                cut = self._cut(before + p)
                ask.update([w for w in cut if self._find(w) is None])
                several.append((k, cut))
        self._learn(ask)
        for k in single:
            rows[k] = now[names[k]]
        for k, cut in several:
            now[names[k]] = rows[k] = self._join(cut)
        return rows

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (u32) one after another, and how many each text has; a null text has none."""
        if len(self.plain) + len(self.spaced) > self.most:
            self.old_plain, self.old_spaced, self.plain, self.spaced = self.plain, self.spaced, {}, {}
        if not len(texts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        texts = texts.fill_null("")
        lists = pc.split_pattern(texts, " ")
        first = lists.offsets.to_numpy()[:-1].astype(np.int64)
        pieces = pc.dictionary_encode(lists.flatten())
        names, code = pieces.dictionary, pieces.indices.to_numpy().astype(np.int64)
        last = np.append(first[1:], len(code)) - 1
        inner, end = np.ones(len(code), bool), np.ones(len(code), bool)
        inner[first] = end[last] = False

        # Where a space touches other white space, or a piece holds some that isn't LF.
        mark = lambda what: np.append(what.to_numpy(zero_copy_only=False), False)[code]
        odd = mark(pc.match_substring_regex(names, _OTHER_SPACE)) | mark(pc.starts_with(names, "\n")) & inner
        odd |= mark(pc.ends_with(names, "\n")) & end | mark(pc.equal(pc.binary_length(names), 0)) & inner & end
        unsafe = np.logical_or.reduceat(odd, first)

        # Rows of ids: the pieces after a space, the first pieces, whole unsafe texts, and one without ids.
        plain, of = np.unique(code[first], return_inverse=True)
        use = np.zeros(len(names), bool)
        bad = np.repeat(unsafe, last - first + 1)
        use[code[inner & ~bad]] = True
        after = np.flatnonzero(use)
        place = np.zeros(len(names), np.int64)
        place[after] = np.arange(len(after))
        code = place[code]
        code[first] = len(after) + of
        rows = self._rows(names.take(pa.array(after)).to_pylist(), True)
        rows += self._rows(names.take(pa.array(plain)).to_pylist(), False)
        if unsafe.any():
            cuts = [self._cut(t) for t in texts.filter(pa.array(unsafe)).to_pylist()]
            self._learn({w for cut in cuts for w in cut if self._find(w) is None})
            code[bad] = len(rows) + len(cuts)
            code[first[unsafe]] = len(rows) + np.arange(len(cuts))
            rows += [*map(self._join, cuts), b""]

        flat = np.frombuffer(b"".join(rows), "<u4")
        size = np.fromiter(map(len, rows), np.int64, len(rows)) // 4
        start = np.cumsum(size) - size
        n = size[code]
        at = np.repeat(start[code] - (np.cumsum(n) - n), n)
        at += np.arange(len(at))
        return flat[at], np.add.reduceat(n, first)
