"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

Base spans (strict patterns with their checks) always stay. Candidates are
looser forms: numbers in national writing, spelled-out addresses, digit chains
and dotted numbers that fail a check, values assigned to names of secrets and
long hexadecimal strings. Labelers (pattern, gazetteer, context, borders,
variety) vote for, against or not at all on base spans and candidates alike.

Votes are counted by pattern over the whole corpus, at most 5 * 3^5 rows; EM on
these estimates a prior and each labeler's reliability by kind. The span
classifier is a logistic model that sees no vote: its features are the span's
text (shape, length, characters, check digit) and the words around it, hashed.
It is trained on the posteriors of at most ``max_training`` spans, those with
the smallest hashes, and scores every candidate. One pass reads the texts.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from .common import cut

KINDS = ("email", "ip", "card", "phone", "secret")
#: Probability from which a candidate is a span.
ACCEPT = 0.7
CONTEXT_CHARS = 40
#: Spans that train the classifier, at most, and its hashed features.
MAX_TRAINING, FEATURES = 20_000, 512

# Words that speak for and against each kind, in the four languages.
_FOR = {
    "email": ("mail", "contact", "write to", "kontakt", "courriel", "correo", "reach"),
    "ip": ("ip", "host", "server", "address", "adresse", "direccion", "client"),
    "card": ("card", "visa", "mastercard", "amex", "karte", "carte", "tarjeta", "credit", "payment"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "cell", "telefon", "téléphone", "teléfono", "whatsapp"),
    "secret": ("token", "key", "secret", "password", "passwd", "passwort", "mot de passe", "contraseña", "bearer", "auth", "credential"),
}
_AGAINST = {
    "email": ("look", "laugh", "arrive"),
    "ip": ("version", "release", "section", "chapter", "v."),
    "card": ("isbn", "order", "tracking", "serial", "timestamp", "hash"),
    "phone": ("isbn", "order", "invoice", "page", "pages", "years", "version", "score"),
    "secret": ("commit", "sha1", "sha256", "checksum", "digest", "hash", "md5", "uuid", "revision"),
}
# How keys of known services begin, and what stands where a secret has been left out.
_ISSUED = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "sk-", "sk_live_", "xoxb-", "xoxp-", "AIza", "eyJ")
_PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|<.*|\$\{.*|your.*|change.?me.*|example.*|redacted.*|none|null|true|false)$")
_TLDS = frozenset("com org net edu gov mil info biz io co de fr es uk us eu ch at be nl it pt pl ru cn jp in br mx ca au".split())
_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits is entered at its first digit only; a match can begin nowhere else, and runs are read once.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TWO_IN_A_DOT = re.compile(r"[0-9]\.[0-9]")
_NATIONAL = re.compile(r"(?<![\w+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])|(?<![\w+.-])0[0-9](?:[ .-][0-9]{2}){4}(?![\w-])")
_SPELLED = re.compile(r"(?<![\w.-])[A-Za-z0-9_+-]{1,64}(?:\.[A-Za-z0-9_+-]{1,64}){0,4} ?(?:\(at\)|\[at\]|\bat\b) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\bdot\b) ?[A-Za-z0-9-]{1,63}){1,4}(?![\w-])", re.IGNORECASE)
_NAMED = r"(?i)(?:token|secret|passw(?:or)?d|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?key)[\"']?[ \t]{0,3}(?:[:=]|=>)[ \t]{0,3}[\"']?"
_SECRET = re.compile(_NAMED + r"([^\s\"']{8,}+)")
_HEX = re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])")
#: Texts without a match hold neither of the two; in the syntax of Arrow's expressions.
_ANY_SECRET = _NAMED + r"[^\s\"']{8}|[0-9A-Fa-f]{32}"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _clear(spans: list[tuple], held: list[tuple[int, int]]) -> list[tuple]:
    """The spans (whose last two items are start and end) that overlap none of ``held``: of those that begin before a span's end, the largest end tells."""
    held = sorted(held)
    starts, tops = [a for a, _ in held], list(accumulate((z for _, z in held), max))
    return [x for x in spans if not (k := bisect_left(starts, x[-1])) or tops[k - 1] <= x[-2]]


def scan(text: str, secrets: bool = True) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and candidates: (kind, start, end), in code points, each in order of kind and start. Without ``secrets`` the text is known to have none."""
    base, more = [], []
    if "@" in text:
        base += [(0, a, z) for a, z in _emails(text)]
    if "dot" in text or "DOT" in text or "Dot" in text:
        more += [(0, *m.span()) for m in _SPELLED.finditer(text)]
    if _DIGIT.search(text):
        if _TWO_IN_A_DOT.search(text):
            for m in _IP.finditer(text):
                ok = all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split(".")))
                (base if ok else more).append((1, *m.span()))
        for m in _CARD.finditer(text):
            d = m.end() - m.start() >= 13 and _digits(m[0])
            if d and 13 <= len(d) <= 19:
                (base if luhn(d) else more).append((2, *m.span()))
        taken = []
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_digits(m[0])) <= 15:
                    base.append((3, *m.span()))
                    taken.append(m.span())
        more += _clear([(3, *m.span()) for m in _NATIONAL.finditer(text)], taken)
    if secrets:
        named = [m.span(1) for m in _SECRET.finditer(text)]
        bare = [m.span() for m in _HEX.finditer(text)]
        more += [(4, *x) for x in sorted({*named, *_clear(bare, named)})]
    return base, _clear(more, [(a, z) for _, a, z in base]) if more else more


def _said(words: tuple[str, ...]) -> re.Pattern:
    return re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, words)) + ")")


_SAID_FOR, _SAID_AGAINST = {k: _said(w) for k, w in _FOR.items()}, {k: _said(w) for k, w in _AGAINST.items()}


def votes(text: str, kind: int, start: int, end: int, strict: bool) -> tuple[int, ...]:
    """1, -1 or 0 from each labeler: pattern, gazetteer, context, and borders and variety, which speak against or not at all."""
    name, s = KINDS[kind], text[start:end]
    digits = _digits(s)
    before = text[max(0, start - CONTEXT_CHARS) : start].lower()
    left, right = text[start - 1 : start] if start else "", text[end : end + 1]
    pattern = 1 if strict else (-1 if kind in (1, 2) else 0)
    if kind == 0:
        gazetteer = 1 if re.split(r"[^A-Za-z0-9]+", s)[-1].lower() in _TLDS else -1
    elif kind == 1:
        gazetteer = -1 if s.startswith(("0.", "127.", "255.")) else 0
    elif kind == 2:
        gazetteer = 1 if digits[0] in "3456" else -1
    elif kind == 3:
        gazetteer = (1 if any(digits[:n] in _CODES for n in (1, 2)) else -1) if s.startswith("+") else 0
    else:
        pattern = -1 if _PLACEHOLDER.match(s) or s.isalpha() else 1 if re.search(r"[:=>][ \t]*[\"']?$", before) else -1
        gazetteer = 1 if s.startswith(_ISSUED) else 0
    context = -1 if _SAID_AGAINST[name].search(before) else 1 if _SAID_FOR[name].search(before) else 0
    borders = -1 if left and (left.isalnum() or left in "_/=#" and kind < 4) or right and (right.isalnum() or right in "_/=") else 0
    if kind == 4:
        variety = 0 if len(set(s)) >= 8 and digits else -1
    else:
        variety = -1 if kind and len(set(digits)) <= 2 else 0
    return pattern, gazetteer, context, borders, variety


_WORD = re.compile(r"\w+")


def traits(text: str, kind: int, start: int, end: int) -> list[int]:
    """Hashed features of a span's own text and of the words around it, distinct and sorted."""
    name, s = KINDS[kind], text[start:end]
    digits = _digits(s)
    shape = re.sub(r"[A-Z]+", "A", re.sub(r"[a-z]+", "a", re.sub(r"[0-9]+", "0", s)))[:64]
    before = _WORD.findall(text[max(0, start - CONTEXT_CHARS) : start].lower())[-3:]
    after = _WORD.findall(text[end : end + CONTEXT_CHARS].lower())[:2]
    found = {
        "", f"length {min(len(s), 64) // 4}", f"digits {10 * len(digits) // len(s)}", f"letters {10 * sum(map(str.isalpha, s)) // len(s)}",
        f"distinct {min(len(set(s)), 24) // 3}", f"first {digits[:1]}", f"last {re.split('[^A-Za-z]+', s)[-1].lower()[:8]}",
        f"check {12 < len(digits) < 20 and luhn(digits)}", f"left {text[start - 1 : start] if start else ''}", f"right {text[end : end + 1]}",
        *(f"large {len(p) > 3 or int(p) > 255}" for p in s.split(".") if kind == 1 and p.strip("0123456789") == "" and len(p) < 5),
        *(f"shape {shape[k : k + 3]}" for k in range(max(1, len(shape) - 2))), *(f"before {w}" for w in before), *(f"after {w}" for w in after),
    }
    return sorted({xxh32_intdigest(f"{name} {x}") % FEATURES for x in found})


LABELERS = 5


def _pattern(kind: int, v: tuple[int, ...]) -> int:
    """Kind and votes as one number."""
    out = kind
    for x in v:
        out = out * 3 + x + 1
    return out


def unpack(pattern: int) -> tuple[int, list[int]]:
    v = []
    for _ in range(LABELERS):
        pattern, x = divmod(pattern, 3)
        v.insert(0, x - 1)
    return pattern, v


_SPAN = "array<struct<kind:int,start:long,end:long,pattern:int,traits:array<int>>>"


def _scanner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("pattern", pa.int32()), ("traits", pa.list_(pa.int32()))]))
    for b in batches:
        rows: tuple[list, list] = ([], [])
        secrets = pc.match_substring_regex(b.column(1), _ANY_SECRET).fill_null(False)
        for t, some in zip(b.column(1), secrets.to_pylist(), strict=True):
            text = t.as_py() or ""
            for out, spans, strict in zip(rows, scan(text, some), (True, False), strict=True):
                out.append([
                    {"kind": k, "start": a, "end": z, "pattern": _pattern(k, votes(text, k, a, z, strict)), "traits": traits(text, k, a, z)}
                    for k, a, z in spans
                ])
        yield pa.record_batch([b.column(0), pa.array(rows[0], kind), pa.array(rows[1], kind)], ["doc_id", "base", "more"])


def expectation_maximisation(patterns: dict[int, int], rounds: int = 50, weight: float = 0.5) -> dict[int, float]:
    """Probability that a span of each pattern is personal data.

    By kind: a prior, and for each labeler how often a vote of its agrees with
    either class. Before any span is seen a class has half of the spans and a
    labeler is right four times of five; that counts as ``weight`` times the
    kind's spans, so that one labeler cannot be turned round where no other
    speaks on the same spans.
    """
    out: dict[int, float] = {}
    for kind in range(len(KINDS)):
        mine = sorted(p for p in patterns if unpack(p)[0] == kind)
        if not mine:
            continue
        v, n = np.array([unpack(p)[1] for p in mine]), np.array([patterns[p] for p in mine], float)
        q, held = np.clip(0.5 + 0.2 * v.sum(axis=1), 0.02, 0.98), 1 + weight * n.sum()
        for _ in range(rounds):
            log = np.zeros((len(mine), 2))
            for c, w in ((0, n * (1 - q)), (1, n * q)):
                log[:, c] += np.log((w.sum() + held / 2) / (n.sum() + held))
                for j in range(LABELERS):
                    own = 1 if c else -1
                    agree, against = (v[:, j] == own) @ w + 0.8 * held, (v[:, j] == -own) @ w + 0.2 * held
                    # Not voting says nothing.
                    log[:, c] += np.where(v[:, j] == 0, 0, np.log(np.where(v[:, j] == own, agree, against) / (agree + against)))
            q = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -60, 60)))
        out.update(zip(mine, q.tolist(), strict=True))
    return out


def train(spans: list[tuple[list[int], float]], steps: int = 40, penalty: float = 0.3) -> list[float]:
    """Weights by feature of a logistic model, fitted by Newton steps to (features, probability) pairs; equal pairs weigh as often as they are there."""
    if not spans:
        return [0.0] * FEATURES
    x = np.zeros((len(spans), FEATURES), np.float32)
    for row, (own, _) in zip(x, spans, strict=True):
        row[own] = 1
    y, w = np.array([q for _, q in spans]), np.zeros(FEATURES)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x.T * np.maximum(p * (1 - p), 1e-4).astype(np.float32)) @ x + penalty * np.eye(FEATURES)
        step = np.linalg.solve(h, x.T @ (y - p) - penalty * w)
        w += step * min(1.0, 2 / (1e-9 + np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def find(docs: DataFrame, accept: float = ACCEPT, max_training: int = MAX_TRAINING) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end, in order) for every row; null and empty texts have none.

    Rows that repeat are rows of their own. Without candidates, or in an empty
    table, spans are the base spans.
    """
    found = cut(docs.select("doc_id", "text").mapInArrow(_scanner, f"doc_id long, base {_SPAN}, more {_SPAN}"))
    spans = found.select("doc_id", F.explode(F.concat("base", "more")).alias("s")).select("doc_id", "s.*")
    posterior = expectation_maximisation({r["pattern"]: r["count"] for r in spans.groupBy("pattern").count().collect()})
    order = F.xxhash64("doc_id", "kind", "start")
    sample = spans.orderBy(order, "doc_id", "kind", "start", "pattern").limit(max_training).select("pattern", "traits").collect()
    weights = train([(r["traits"], posterior[r["pattern"]]) for r in sample])
    table = F.from_json(F.lit(json.dumps(weights)), "array<double>")
    odds = lambda s: F.aggregate(s["traits"], F.lit(0.0), lambda a, x: a + F.get(table, x))
    more = F.filter("more", lambda s: odds(s) >= float(np.log(accept / (1 - accept))))
    plain = lambda c: F.sort_array(F.transform(c, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    return found.select("doc_id", plain("base").alias("base"), plain(F.concat("base", more)).alias("spans"))
