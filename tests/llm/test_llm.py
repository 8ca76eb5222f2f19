"""Training-data operators against brute force, with nulls, ties, repeats and empty tables."""

import hashlib
import io
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from conftest import DATA
from pyspark.sql import functions as F

from siftline.llm import bpe, chat, common, exact, mixing, near, pii, quality, queries, rollup, tokenfile, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BYTE_BPE, MULTI = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty, blank and long texts, ties, repeated rows, extra columns with operators' own names."""
    base = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the dark wood "
    texts = [None, "", "   ", "one", base * 3, base * 3, base * 3 + "more", base.upper() * 3, "x" * 3000, base * 400, "a\n\n b\t c  ", "mail bob.1@mail.example.com +1 (222) 555-1234"]
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", len(t or ""), "k", 1, "size") for i, t in enumerate(texts)]
    rows += [rows[4], (None, "null id", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS + ", key string, label int, size string").cache()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_parity(name, spark, oracle, collected):
    assert collected(queries.queries()[name](spark, DATA)) == oracle(queries.oracle_sql()[name])


LABELS = "doc_id long, quality int, toxic int"


def _words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def test_every_operator_on_odd_rows(spark, odd):
    """By value: nulls, empty, blank and long texts, ties, repeated rows, columns of operators' own names."""
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 0), (None, 1, None), (9, None, None)], LABELS)
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    count = lambda some: Counter(map(str, some))

    got = quality.quality(odd, labels, "doc_id", "text", "key").collect()
    assert count((r["doc_id"], r["text"]) for r in got) == count(rows)
    for r in got:
        windows = Counter(zip(*(_words(r["text"])[k:] for k in range(3)), strict=False))
        assert r["n_words"] == len(_words(r["text"])) and r["kept"] == (not r["base_failed"] and r["llr"] >= quality.THRESHOLD)
        assert r["base_failed"] == (r["n_words"] < 50 or 2 * r["n_repeat_words"] > r["n_words"]) and (r["n_repeat_words"] > 0) == any(n > 1 for n in windows.values())
    assert all(r["llr"] == 0 for r in quality.quality(odd, spark.createDataFrame([], LABELS), "doc_id").collect())

    normal = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[normal(t)].append(i)
    first = lambda ids: min((i for i in ids if i is not None), default=None)
    want = [(i, first(groups[normal(t)]), len(groups[normal(t)]), i == first(groups[normal(t)]), hashlib.sha256(normal(t).encode()).hexdigest()) for i, t in rows]
    assert count(tuple(r) for r in exact.exact_dedup(odd).collect()) == count(want)

    named = [(i, t) for i, t in rows if i is not None]
    linked = _components(dict(named).items(), 2)
    want = [(i, linked[i][0], linked[i][1], linked[i][1] == i) if i is not None else (None, len(near.shingle_set(t, 2)), None, True) for i, t in rows]
    assert count(tuple(r) for r in near.near_dedup(odd, 2).collect()) == count(want)

    assert count((r["doc_id"], *((tuple(s) for s in r["base"]))) for r in pii.find(odd).collect()) == count((i, *_base(t or "")) for i, t in rows)
    got = mixing.mix(odd, "text").collect()
    assert count((r["doc_id"], r["text"], r["size"]) for r in got) == count((i, t, len(_words(t))) for i, t in rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)

    coded = bpe.encode(odd, MULTI, "doc_id", "text").collect()
    assert count((r["doc_id"], r["text"]) for r in coded) == count(rows) and all((len(r["ids"]) == 0) == (not r["text"]) for r in coded)


def test_every_operator_on_an_empty_table(spark, empty):
    none = spark.createDataFrame([], LABELS)
    assert quality.quality(empty, none, "doc_id").count() == exact.exact_dedup(empty).count() == near.near_dedup(empty, 2).count() == 0
    assert mixing.mix(empty).count() == pii.find(empty).count() == bpe.encode(empty, MULTI, "doc_id").count() == bpe.round_trip(empty, MULTI, "doc_id").count() == 0
    assert rollup.counted(empty, {"w": rollup.as_is}, {"b": (BYTE_BPE, rollup.as_is)}).count() == 0
    folder = common.fresh_dir(spark, "test")
    tokenfile.write(empty, folder, BYTE_BPE)
    assert tokenfile.checksums(spark, folder).count() == tokenfile.read(spark, folder).count() == 0
    assert chat.from_table(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert chat.from_json_rows(spark.createDataFrame([], "conv_id long, json string")).count() == 0


def test_clashing_names(spark):
    """Columns called like the operators' own change nothing."""
    pages = spark.createDataFrame([(1, "u", "<p>x</p>" * 300), (2, None, "<p>x</p>" * 300), (3, "w", None)], "page_id long, url string, html string")
    clash = pages.withColumns({c: F.lit(7) for c in ("payload", "digest", "d", "n", "last", "mark", "refers_to", "file")})
    folders = [common.fresh_dir(spark, "test") for _ in range(2)]
    made = [sorted((r["file"], r["sha1"]) for r in warc.write(x, f).collect()) for x, f in zip((pages, clash), folders, strict=True)]
    assert made[0] == made[1]
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", None)], "conv_id long, turn long, role string, text string")
    clash = turns.withColumns({c: F.lit(7) for c in ("t", "turns", "v", "layout", "fingerprint", "system")})
    assert chat.from_table(turns).collect() == chat.from_table(clash).collect()
    docs = spark.createDataFrame([(1, "a b c", "en", "s")], "doc_id long, text string, lang string, source string")
    clash = docs.withColumns({c: F.lit(7) for c in ("row", "plain", "n", "t0", "counts", "tokenizer", "tokens")})
    made = [rollup.of(rollup.counted(x, {"w": rollup.as_is}, {"b": (BYTE_BPE, rollup.as_is)}), "w", "b").collect() for x in (docs, clash)]
    assert made[0] == made[1] and len(made[0]) == 2
    some = spark.createDataFrame([(k, f"word {k} a.b@c.de +1 (222) 555-1234 " + "x y " * k, "en", f"s{k % 2}") for k in range(6)], "doc_id long, text string, lang string, source string")
    clash = some.withColumns({c: F.lit(7) for c in ("place", "shard", "w", "n", "mark", "size", "target", "base", "more", "spans", "kind", "pattern", "ids", "start", "block", "file", "plain")})
    folders = [common.fresh_dir(spark, "test") for _ in range(2)]
    for x, f in zip((some, clash), folders, strict=True):
        tokenfile.write(x, f, BYTE_BPE)
    for both in ([tokenfile.checksums(spark, f) for f in folders], [pii.find(x) for x in (some, clash)], [mixing.mix(x) for x in (some, clash)]):
        rows = [sorted(map(str, df.collect())) for df in both]
        assert rows[0] == rows[1] and len(rows[0]) == 6


# --- chat ---


def test_escape_is_reversible(spark):
    random.seed(1)
    parts = ["<", "\\", "|", "s>", "/s>", "[", "INST]", "/INST]", "SYS>>", "<|im_start|>", "<|im_end|>\n", "\n", "\\n", "a", "é", "[INST]", "<<SYS>>"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 12))) for _ in range(3000)]
    rows = [(i, [(texts[i], texts[-i - 1]), ("assistant", texts[i])]) for i in range(len(texts))]
    df = spark.createDataFrame(rows, f"i long, turns {chat.TURNS}")
    got = df.select("i", "turns", chat.format_chat(F.col("turns")).alias("f")).select("i", "turns", "f", chat.read_back(F.col("f")).alias("b"))
    assert got.filter(F.size("b") != F.size("turns")).count() == 0
    assert got.filter(F.transform("b", lambda t: F.struct(t["role"], t["text"])).cast(chat.TURNS) != F.col("turns")).count() == 0
    assert got.filter(~F.col("b")[1]["loss"]).count() == 0


def test_layouts(spark):
    import json

    rows = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, {"prompt": "q", "completion": "a"},
        {"prompt": "q", "response": "a"}, {"instruction": "q", "input": "", "output": "a"}, {"output": "a", "instruction": "q"}, {"other": 1},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)] + [(90, None), (91, "no json")], "conv_id long, json string")
    got = {r["conv_id"]: r for r in chat.from_json_rows(df).collect()}
    for i, name in enumerate(["messages", "sharegpt", "prompt", "response", "instruction", "instruction_only"]):
        assert (got[i]["layout"], [tuple(t) for t in got[i]["turns"]]) == (name, [("user", "q"), ("assistant", "a")])
    assert got[6]["layout"] is None and got[6]["fingerprint"] and got[90]["turns"] is None and got[91]["turns"] is None


def test_turn_rows(spark):
    rows = [(1, 1, None, None, 0), (1, 0, "user", "hi", 0), (1, 0, "user", "hi", 0), (None, None, "user", "x", 1)]
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat.from_table(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int")).collect()}
    assert got == {1: [("user", "hi"), ("user", "hi"), ("", "")], None: [("user", "x")]}
    with pytest.raises(ValueError):
        chat.from_table(spark.createDataFrame([(1,)], "conv_id long"))


def test_chat_layouts_with_more_keys(spark):
    import json

    two = [("user", "q"), ("assistant", "a")]
    rows = [
        ({"id": 1, "messages": [{"role": "user", "content": "q", "name": "n"}, {"role": "assistant", "content": "a"}], "tools": [{"f": 1}]}, "messages", two),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "system": "s"}, "sharegpt", [("system", "s"), *two]),
        ({"prompt": "q", "completion": "a", "id": "x"}, "prompt", two), ({"id": 1, "prompt": "q", "response": "a"}, "response", two),
        ({"id": 1, "instruction": "q", "input": "", "output": "a"}, "instruction", two), ({"instruction": "q", "output": "a", "meta": {"k": [1]}}, "instruction_only", two),
        ({"prompt": {"x": 1}, "completion": "a", "id": 1}, None, None), ({"messages": [{"role": "user"}], "id": 1}, None, None), ({"id": 1}, None, None),
    ]
    got = {r["conv_id"]: r for r in chat.from_json_rows(spark.createDataFrame([(i, json.dumps(r[0])) for i, r in enumerate(rows)], "conv_id long, json string")).collect()}
    for i, (_, layout, turns) in enumerate(rows):
        assert (got[i]["layout"], got[i]["turns"] and [tuple(t) for t in got[i]["turns"]]) == (layout, turns)
    for kind, row in {
        "messages array<struct<role:string,content:string,name:string>>, id int": ([("user", "q", "n"), ("assistant", "a", None)], 1),
        "conversations array<struct<`from`:string,value:string>>": ([("human", "q"), ("gpt", "a")],), "prompt string, completion string": ("q", "a"),
        "prompt string, response string": ("q", "a"), "instruction string, input string, output string": ("q", None, "a"), "instruction string, output string": ("q", "a"),
    }.items():
        assert [tuple(t) for t in chat.from_table(spark.createDataFrame([(5, *row)], "conv_id long, " + kind)).first()["turns"]] == two


# --- token files ---


def test_token_files(spark, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE_BPE)
    folder = common.fresh_dir(spark, "test")
    tokenfile.write(odd, folder, BYTE_BPE, block_tokens=50, file_blocks=2)
    rows = sorted(((r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, want = 0, []
    for i, x in rows:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = tokenfile.checksums(spark, folder).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in tokenfile.read(spark, folder).collect() if r["doc_id"] == 3} == {3: [*t.encode("one").ids, 0]}


def test_block_round_trip():
    random.seed(5)
    for ids in ([], [7], [2**32 - 1] * 3 + [0], [random.randrange(90_000) for _ in range(5000)], list(range(70_000))):
        ids = np.array(ids, np.uint32)
        data = tokenfile.encode_block([1, None], [len(ids), 0], ids)
        d, n, got = next(tokenfile.blocks(io.BytesIO(data)))
        assert d == [1, None] and n.tolist() == [len(ids), 0] and (got == ids).all()
        with pytest.raises(ValueError):
            list(tokenfile.blocks(io.BytesIO(data[:-5] + bytes([data[-5] ^ 1]) + data[-4:])))


def test_special_tokens_as_the_library_has_them():
    from tokenizers import Tokenizer

    random.seed(6)
    parts = ["<|endoftext|>", "<|endoftext", "|>", " ", "  ", "\n", " \n", "a", "the", "don't", "12", "!", "\u3000", "it's"]
    texts = ["a<|endoftext|>b"] + ["".join(random.choice(parts) for _ in range(random.randint(0, 9))) for _ in range(4000)]
    ids, n = tokenfile.PieceEncoder(BYTE_BPE).encode(pa.array(texts))
    got = [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got[0] == [64, 50256, 65] and got == [e.ids for e in Tokenizer.from_file(BYTE_BPE).encode_batch(texts, add_special_tokens=False)]


def test_caches_of_few_pieces(monkeypatch):
    """Generations turn over between and within chunks of texts."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokenfile, "CACHE_PIECES", 5)
    random.seed(8)
    coder, library = tokenfile.PieceEncoder(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
    for _ in range(60):
        texts = [" ".join(random.choice(["ab", "the.", "x", "", "It's", "a\nb", "\n", "é!"]) for _ in range(random.randint(0, 6))) for _ in range(random.randint(0, 5))]
        ids, n = coder.encode(pa.array(texts, pa.string()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n))[: len(n)]] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


# --- PII ---

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def _base(text):
    """By the contract's patterns."""
    part = lambda x: len(x := x.lstrip("0")) < 4 and int(x or "0") <= 255
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub(r"[^0-9]", "", m[0])
            if (k != 1 or all(map(part, m[0].split(".")))) and (k != 2 or 13 <= len(d) <= 19 and pii.luhn(d)) and (k != 3 or 9 <= len(d) <= 15):
                out.append((k, *m.span()))
    return out


def test_base_spans():
    random.seed(3)
    parts = ["a@b.c", "@", "1.2.3.4", ".5", "300.1.1.1", "4111 1111 1111 1111", "4111111111111112", "+1 (222) 555-1234", "+", "-", " ", "x.y", "é", "0", "12", "(", "555-123-4567", "tel ", " at ", "dot com", "."]
    for _ in range(5000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 14)))
        assert sorted(pii.scan(text)[0]) == _base(text)
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+1" * 100_000, "a@" * 100_000, "token=" * 40_000, "f" * 200_000 + "g", "key:" * 50_000):
        pii.scan(text)


def test_very_long_parts():
    zeros, nines = "0" * 5000, "9" * 5000
    assert pii.scan(f"{zeros}.1.1.1 ")[0] == _base(f"{zeros}.1.1.1 ") and (1, 0, 5006) in pii.scan(f"{zeros}.1.1.1 ")[0]
    assert pii.scan(f"{nines}.1.1.1")[0] == [] and (1, 0, 5006) in pii.scan(f"{nines}.1.1.1")[1]
    for text in (f"{zeros}.1.1.1", f"{nines}.1.1.1", f"+{nines}", f"{nines}@a.b"):
        for k, a, z in [*pii.scan(text)[0], *pii.scan(text)[1]]:
            pii.votes(text, k, a, z, True), pii.traits(text, k, a, z)


def test_many_spans_in_one_text():
    """Time in proportion to the spans of a text, and base spans as ever."""
    rnd = random.Random(8)
    kinds = ["+1 (212) 555-{:04d}", "(212) 555-{:04d}", "a{}@b.co", "a{} at b dot com", "10.0.{}.1", "300.1.{}.1", "4111 1111 1111 1111", "4111 1111 1111 {:04d}", "token=abcdefgh{}", "{:040d}"]
    some = [rnd.choice(kinds).format(rnd.randrange(10_000)) for _ in range(40_000)]
    text = " | ".join(some[:20_000])
    assert sorted(pii.scan(text)[0]) == _base(text)
    spent = []
    for n in (5_000, 40_000):
        t = time.process_time()
        pii.scan(" | ".join(some[:n]))
        spent.append(time.process_time() - t)
    assert spent[1] < 3 and spent[1] < 24 * max(spent[0], 0.01)
    held = sorted((a := rnd.randrange(3000), a + rnd.randrange(1, 60)) for _ in range(40))
    spans = [(0, a, a + rnd.randrange(1, 40)) for a in range(0, 3000, 7)]
    assert pii._clear(spans, held) == [x for x in spans if not any(a < x[2] and x[1] < z for a, z in held)]


def test_weak_supervision_adds_spans(spark):
    rows = [(i, f"please call +1 (212) 555-{1000 + i:04d} now") for i in range(300)] + [(1000 + i, f"please call (212) 555-{1000 + i:04d} now") for i in range(100)] + [(2000 + i, f"order version 212-555-{1000 + i:04d}x") for i in range(100)]
    got = {r["doc_id"]: (len(r["base"]), len(r["spans"])) for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == (1, 1) for i in range(300)) and all(got[1000 + i] == (0, 1) for i in range(100)) and all(got[2000 + i] == (0, 0) for i in range(100))


def _planted(i):
    """A text, and the span that a reader would mark in it (kind, start, end), or none."""
    rnd = random.Random(i)
    number = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rnd.choice("aeinorst") for _ in range(rnd.randint(3, 8)))
    hex40 = "".join(rnd.choice("0123456789abcdef") for _ in range(40))
    key = "".join(rnd.choice("ABCDEFGHIJKLMNOPqrstuvwxyz0123456789") for _ in range(24))
    what, before, after = rnd.choice([
        (("email", f"{word()}.{number(2)}@mail.example.com"), "", ""), (("ip", ".".join(str(rnd.randint(1, 255)) for _ in range(4))), "from host ", ""), (("phone", f"+1 ({number(3)}) 555-{number(4)}"), "", ""),
        (("phone", f"({number(3)}) 555-{number(4)}"), rnd.choice(["call me at ", "my phone is ", "fax "]), ""), (("email", f"{word()} at {word()} dot com"), rnd.choice(["mail me: ", "contact "]), ""),
        (("secret", hex40), rnd.choice(['token = "', 'api_key: "', 'SECRET="']), '"'), (("secret", key), rnd.choice(["password: ", "auth_key=", "access_key = "]), ""),
        ((None, hex40), rnd.choice(["commit ", "sha1 checksum ", "revision "]), ""), ((None, f"{number(3)}-{number(3)}-{number(4)}"), rnd.choice(["invoice ", "order ", "isbn "]), ""),
        ((None, f"{rnd.randint(300, 999)}.{number(1)}.{number(1)}.{number(2)}"), rnd.choice(["version ", "release ", "section "]), ""), ((None, "your-password-here"), "password: ", ""), ((None, "changeme"), 'token = "', '"'),
    ])
    head = " ".join(word() for _ in range(rnd.randint(3, 30))) + " " + before
    return f"{head}{what[1]}{after} {word()} {word()}", what[0] and (pii.KINDS.index(what[0]), len(head), len(head) + len(what[1]))


def test_recall_of_added_spans(spark):
    """Of planted spans that no base pattern finds at least 0.9 are found, and at least 0.9 of what is added is planted."""
    planted = [_planted(i) for i in range(3000)]
    got = pii.find(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(planted)], "doc_id long, text string")).collect()
    hit = added = missing = 0
    for r in got:
        text, span = planted[r["doc_id"]]
        base, all_ = {tuple(x) for x in r["base"]}, {tuple(x) for x in r["spans"]}
        assert base == set(_base(text)) and base <= all_
        added += len(all_ - base)
        hit += span in all_ - base
        missing += span is not None and span not in all_
    assert hit > 800 and hit / (hit + missing) >= 0.9 and hit / added >= 0.9, (hit, missing, added)


def test_planted_secrets(spark):
    """The shared tables hold secrets as token = "..."; each is a span, and documents without personal data or secrets have none."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: [s for s in r["spans"] if s["kind"] == 4] for r in pii.find(docs).collect()}
    for i, text in docs.select("doc_id", "text").collect():
        want = [m.span(1) for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', text or "")]
        assert [(s["start"], s["end"]) for s in got[i]] == want


def test_reliabilities():
    """Votes drawn with known reliabilities: the posterior finds the classes again."""
    random.seed(11)
    seen, truth = Counter(), defaultdict(Counter)
    for _ in range(20_000):
        y = random.random() < 0.6
        p = pii._pattern(2, tuple((1 if (random.random() < r) == y else -1) for r in (0.95, 0.8, 0.7, 0.9, 0.6)))
        seen[p] += 1
        truth[p][y] += 1
    q = pii.expectation_maximisation(seen)
    right = sum(truth[p][q[p] >= 0.5] for p in seen)
    assert right / 20_000 > 0.95


# --- near dedup ---


def _components(rows, width, percent=80):
    sets = {i: set(near.shingle_set(t, width).tolist()) for i, t in rows}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("width", [2, 5])
def test_near_dedup(spark, docs, width):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    random.seed(9)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [random.choice(vocabulary) for _ in range(120)]
    for i in range(60):  # a family whose members are partly over, partly under the limit
        words = list(base)
        for _ in range(random.randint(0, 14)):
            words[random.randrange(120)] = random.choice(vocabulary)
        rows.append((10_000 + i, " ".join(words)))
    rows += [(20_000, None), (20_001, ""), (20_002, "One"), (20_003, "one"), (20_004, " ONE\t")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), width).collect()}
    assert got == _components(rows, width)


def test_shingles():
    assert len(near.shingle_set("a b a b", 2)) == 2 and len(near.shingle_set("A", 2)) == 1 and len(near.shingle_set(None, 2)) == 0
    assert (near.shingle_set("É x", 2) != near.shingle_set("é x", 2)).all() and (near.shingle_set("A\x0bB", 2) == near.shingle_set("a b", 2)).all()


def test_sketch_estimates():
    rng = np.random.default_rng(1)
    for n in (1, 3, 40, 2000):
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        y = np.concatenate([x[: max(1, len(x) * 9 // 10)], np.unique(rng.integers(0, 2**63, len(x) // 10, dtype=np.uint64))])
        s = near.sketch([x, np.unique(y)])
        assert not (s == near._FREE).any()
        j = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        assert abs((s[0] == s[1]).mean() - j) < 0.08


# --- BPE ---


def test_bpe(spark, odd):
    import public_tokenizers as P
    import tiktoken

    ranks = bpe.load_ranks(MULTI)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder = bpe.DuckBPE(ranks, P.PATTERN)
    random.seed(2)
    parts = [" ", "  ", "\n", " \n", "\t", "　", "\x1c", " ", "\xa0", "a", "the", "'s", "don't", "12", "é", "日本", "<|endoftext|>", "!!", "\x85", "x" * 50, "", "ab" * 60, "entier"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 30))) for _ in range(800)] + ["a" * 2000, "ab" * 700, "", "é" * 500]
    ids, n = coder.encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [enc.encode_ordinary(t) for t in texts]
    assert coder.decode(ids, n) == [t.encode() for t in texts]
    with pytest.raises(ValueError):
        coder.decode(np.array([1, 60_000]), np.array([2]))
    got = bpe.decode(bpe.encode(odd, MULTI, "doc_id", "text"), MULTI, "doc_id", "text").collect()
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in got)


def test_long_words():
    """Words of 100,000 characters, random, periodic and mixed, in time that grows with their length."""
    import tiktoken

    ranks = bpe.load_ranks(MULTI)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder = bpe.DuckBPE(ranks, public_tokenizers.PATTERN)
    random.seed(4)
    draw = lambda some, n: "".join(random.choice(some) for _ in range(n))
    texts = [draw("abcdefghijklmnopqrstuvwxyz", 100_000), "a" * 99_999, "ab" * 30_000, "é" * 20_000, draw(["the", "tion", "aa"], 5000), draw("0123456789", 9000), draw([chr(x) for x in range(0x4E00, 0x9FFF, 7)], 4000), draw("😀👍🏽", 1500), "-" * 50_000]
    texts += [draw("abc", random.randint(60, 400)) for _ in range(200)]
    ids, n = coder.encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [enc.encode_ordinary(t) for t in texts]
    assert coder.decode(ids, n) == [t.encode() for t in texts]


# --- WARC ---


def test_warc(spark):
    long_ = "<p>é</p>" * 300
    rows = [(3, "http://a/é b", long_), (9, None, long_), (9, None, long_), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (5, "u", ""), (None, "n", long_), (-6, "m", "z" * 1000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    files = []
    for _ in range(2):
        folder = common.fresh_dir(spark, "test")
        files.append(sorted((r["file"], r["sha1"]) for r in warc.write(pages.repartition(3), folder, roll_bytes=400).collect()))
    assert files[0] == files[1]
    got = sorted(((r["page_id"], r["url"], r["record_type"], r["refers_to"], r["payload_bytes"], None if r["payload"] is None else bytes(r["payload"]).decode()) for r in warc.read(spark, folder).collect()), key=str)
    n = len(long_.encode())
    want = [(3, "http://a/é b", "revisit", 9, n, None), (9, None, "response", None, n, long_), (9, None, "response", None, n, long_), (1, "u", "response", None, 5, "short"), (2, "u", "response", None, 5, "short"), (4, "u", "response", None, 0, ""), (5, "u", "response", None, 0, ""), (None, "n", "revisit", 9, n, None), (-6, "m", "response", None, 1000, "z" * 1000)]
    assert got == sorted(want, key=str)
    empty = common.fresh_dir(spark, "test")
    assert warc.write(pages.limit(0), empty).count() == 0 and warc.read(spark, empty).count() == 0


# --- exact dedup ---


def test_index_inserts_deletes_resizes():
    index = exact.DigestIndex(16)
    texts = [str(i).encode() for i in range(4000)]
    keys = [hashlib.sha256(t).digest() for t in texts]
    index.add(keys, texts, list(range(4000)), [1] * 4000)
    assert index.resizes > 0 and all(x == (i, 1) for i, x in enumerate(index.lookup(keys, texts))) and index.filter.size == 4000
    index.add(keys[:3], texts[:3], [9, -4, None], [2, 2, 2])
    assert index.lookup(keys[:3], texts[:3]) == [(0, 3), (-4, 3), (2, 3)]
    for k, t in zip(keys[:2000], texts, strict=False):
        while index.remove(k, t):
            pass
    assert not any(index.lookup(keys[:2000], texts[:2000])) and all(index.lookup(keys[2000:], texts[2000:])) and index.filter.size == 2000
    index.add([keys[0]], [texts[0]], [77], [1])
    assert index.lookup([keys[0]], [texts[0]]) == [(77, 1)] and not index.remove(keys[1], texts[1])


def test_hits_are_verified_against_content():
    """A filter hit of another key is no match, and the same digest with another content is an error."""
    index = exact.DigestIndex()
    key = hashlib.sha256(b"a").digest()
    index.add([key], [b"a"], [1], [1])
    alike = key[:8] + bytes(24)  # the filter can't tell it from key
    assert index.filter.contains(index.hashes([alike]))[0] and index.lookup([alike], [b"b"]) == [None] and not index.remove(alike, b"b")
    index.add([alike], [b"b"], [0], [1])
    assert index.lookup([key, alike], [b"a", b"b"]) == [(1, 1), (0, 1)]
    for use in (lambda: index.add([key], [b"x"], [2], [1]), lambda: index.lookup([key], [b"x"]), lambda: index.remove(key, b"x")):
        with pytest.raises(ValueError):
            use()


def test_many_insertions():
    rng = np.random.default_rng(3)
    for n in (1, 5, 3000):
        hashes = rng.integers(0, 2**63, n, dtype=np.uint64)
        f = exact.CuckooFilter(n)
        assert f.insert_many(hashes) and f.contains(hashes).all() and f.size == n
    same = np.full(9, 5, np.uint64)  # eight slots hold one fingerprint
    assert not exact.CuckooFilter(64).insert_many(same) and exact.CuckooFilter(64).insert_many(same[:8])


def test_exact_dedup_in_small_batches(spark, docs, monkeypatch):
    monkeypatch.setattr(exact, "ROWS", 2)
    small = {bytes(r["key"]): (r["keep_id"], r["group_size"]) for r in exact.groups(docs, max_keys=3).collect()}
    bytes_ = {bytes(r["key"]): (r["keep_id"], r["group_size"]) for r in exact.groups(docs, max_bytes=5000).collect()}
    whole = {bytes(r["key"]): (r["keep_id"], r["group_size"]) for r in exact.groups(docs).collect()}
    want = defaultdict(list)
    for i, t in docs.select("doc_id", "text").collect():
        want[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t).encode()).digest()].append(i)
    assert small == bytes_ == whole == {k: (min(v), len(v)) for k, v in want.items()}


def test_a_fold_hands_on_between_keys():
    """One key over many small pieces of the input, dealt out and sorted, is one row."""
    keys = sorted(hashlib.sha256(str(i).encode()).digest() for i in range(7))
    rows = [(k, b"c" + k, i, 1) for k in keys for i in range(5)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("key", "content", "keep_id", "group_size"), r, strict=True))]) for r in rows]
    got = [tuple(r.values()) for b in exact._fold(iter(batches), 1, 10, ordered=True) for r in b.to_pylist()]
    assert got == [(k, 0, 5) for k in keys]


# --- quality ---


def _brute(text, ratios):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    long_ = lambda x, seed: xxhash.xxh64(int(x).to_bytes(8, "little", signed=True), seed=seed).intdigest()
    h = [signed(xxhash.xxh64(w.encode(), seed=42).intdigest()) for w in words]
    two = [long_(x, 42) if i == 0 else long_(x, long_(h[i - 1], 42)) for i, x in enumerate(h)]
    n = len(ratios)
    llr = (sum(ratios[x % n] for x in h) + sum(ratios[x % n] for x in two)) / (2 * len(h)) if h else 0.0
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), round(llr, 9)


def test_quality_features(spark, odd, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    ratios = quality.fit(docs, labels)
    got = quality.features(docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")), ratios, "text").collect()
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], round(r["llr"], 9)) == _brute(r["text"], ratios)


def test_quality_verdict(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = quality.quality(docs, labels, "doc_id").join(labels, "doc_id").filter("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in got}
    assert n.get((1, False), 0) <= 0.02 * n[(1, True)] and n[(0, False)] >= n.get((0, True), 0)


# --- rollups ---


def test_rollup(spark, odd, empty):
    store = rollup.RollupStore(spark, common.fresh_dir(spark, "test"))
    assert store.totals().count() == 0
    counts = rollup.counted(odd, {"words-1": rollup.as_is, "words-2": rollup.single_spaced}, {})
    rows = rollup.of(counts, "words-1")
    assert store.commit("a", rollup.inserts(rows)) and not store.commit("a", rollup.inserts(rows))
    want = Counter()
    for r in odd.collect():
        want[r["source"], r["lang"]] += len([w for w in re.split(r"[\x20\x09-\x0D]+", r["text"] or "") if w])
    assert {(r["source"], r["lang"]): r["tokens"] for r in store.totals().collect()} == want
    assert store.commit("b", rollup.revisions(rollup.moved(counts, "words-1", "words-2")))
    assert all((r["docs"], r["tokens"]) == (0, 0) for r in store.totals().filter("tokenizer = 'words-1'").collect())
    assert {(r["source"], r["lang"]): r["tokens"] for r in store.totals().filter("tokenizer = 'words-2'").collect()} == want
    assert store.commit("c", rollup.deletes(rollup.of(counts, "words-2"))) and store.batches() == ["a", "b", "c"]
    assert all((r["docs"], r["tokens"]) == (0, 0) for r in store.totals().collect()) and store.totals().count() > 1
    assert store.commit("none", rollup.inserts(rollup.of(rollup.counted(empty, {"words-1": rollup.as_is}, {}), "words-1")))
    with pytest.raises(ValueError):
        store.commit("x/y", rollup.inserts(rows))


def test_compaction(spark, odd):
    """Totals are the same from bases and from batches; batches come in between, come again, and another writer's base wins."""
    store, plain = (rollup.RollupStore(spark, common.fresh_dir(spark, "test")) for _ in range(2))
    rows = rollup.of(rollup.counted(odd, {"w": rollup.as_is}, {}), "w")
    same = lambda: sorted(map(str, store.totals().collect())) == sorted(map(str, plain.totals().collect()))
    assert store.compact() and store.totals().count() == 0
    for k, change in enumerate((rollup.inserts(rows), rollup.deletes(rows.filter("doc_id < 4")), rollup.inserts(rows.limit(2)))):
        for s in (store, plain):
            assert s.commit(f"b{k}", change) and not s.commit(f"b{k}", change)
        assert same() and store.compact() and same()
    assert not store.commit("b0", rollup.inserts(rows)) and same() and store.batches() == ["b0", "b1", "b2"]
    base = store._base
    store._base = lambda: (None, set())  # as a writer sees it that looked before the others
    assert not store.compact()
    store._base = base
    assert same()


def test_versions_that_read_alike_are_encoded_once(spark):
    texts = ["a  b", "a b", None, "", " x\ty ", "one two three"]
    docs = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = rollup.counted(docs, {}, {"one": (BYTE_BPE, rollup.as_is), "two": (BYTE_BPE, rollup.single_spaced), "three": (BYTE_BPE, rollup.as_is)}).collect()
    alone = [{r["doc_id"]: r["counts"]["v"] for r in rollup.counted(docs, {}, {"v": (BYTE_BPE, f)}).collect()} for f in (rollup.as_is, rollup.single_spaced)]
    assert {r["doc_id"]: (r["counts"]["one"], r["counts"]["two"], r["counts"]["three"]) for r in got} == {k: (alone[0][k], alone[1][k], alone[0][k]) for k in range(len(texts))}
    assert alone[0][0] != alone[1][0]


def test_a_batch_has_one_winner(spark, odd, monkeypatch):
    """Two writers of one batch at once: both find it free and write, one renames."""
    store = rollup.RollupStore(spark, common.fresh_dir(spark, "test"))
    rows = rollup.inserts(rollup.of(rollup.counted(odd, {"w": rollup.as_is}, {}), "w"))
    inner, won = rollup.delta, []

    def late(changes):
        monkeypatch.setattr(rollup, "delta", inner)
        won.append(store.commit("a", rows))  # the other writer, after this one has looked
        return inner(changes)

    monkeypatch.setattr(rollup, "delta", late)
    assert [store.commit("a", rows), *won] == [False, True]
    assert store.batches() == ["a"] and store.totals().agg(F.sum("docs")).first()[0] == odd.count()


def test_token_counts_whole(spark, docs):
    """The query against the tokenizers library, a document at a time."""
    from tokenizers import Tokenizer

    library, want = Tokenizer.from_file(BYTE_BPE), defaultdict(lambda: [0] * 5)
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if r["toxic"] == 1}
    assert toxic
    for i, text, lang, source, _ in docs.select("doc_id", "text", "lang", "source", "n_chars").collect():
        stays, text = int(i not in toxic), text or ""
        one, two = (len(library.encode(t, add_special_tokens=False).ids) for t in (text, re.sub(r"[\x20\x09-\x0D]+", " ", text)))
        n = len([w for w in re.split(r"[\x20\x09-\x0D]+", text) if w])
        for version, row in (("words-1", (stays, n * stays, 1, 1 - stays, 0)), ("byte_bpe_50k-1", (0, 0, 1, 1 - stays, 0)), ("byte_bpe_50k-2", (stays, two * stays, 0, 0, stays))):
            if version != "byte_bpe_50k-2" or stays:
                want[source, lang, version] = [a + b for a, b in zip(want[source, lang, version], row, strict=True)]
    got = {tuple(r[:3]): list(r[3:]) for r in queries.op9_token_counts(spark, DATA).collect()}
    assert got == dict(want)


# --- mixing ---


def test_sainte_lague():
    random.seed(1)
    for _ in range(400):
        n, seats = random.randint(1, 7), random.randint(0, 90)
        votes, most = [random.choice([0, 1, 2, 3, random.random() * 50]) for _ in range(n)], [random.randint(0, 30) for _ in range(n)]
        got = [0] * n
        for _ in range(seats):
            if not (open_ := [(-votes[i] / (2 * got[i] + 1), i) for i in range(n) if got[i] < most[i] and votes[i] > 0]):
                break
            got[min(open_)[1]] += 1
        assert got == mixing.sainte_lague(votes, seats, most)


def _mixed(rows, seed=1, words=mixing.BLOCK_WORDS):
    """taken of each (doc_id, text, source), by a walk over every word of every shard."""
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    xx = lambda data, seed: xxhash.xxh64(data, seed=seed % 2**64).intdigest()
    long_ = lambda x, seed: xx(int(x).to_bytes(8, "little", signed=True), seed)
    mark = lambda t: signed(xx(int(t is None).to_bytes(4, "little"), xx((t or "").encode(), 42)))
    first = lambda x, i, m: signed(long_(m, long_(i, xx(int(x).to_bytes(4, "little"), 42))))
    at = [(i, s, mark(t), len([w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w])) for i, t, s in rows]
    names = sorted({r[1] for r in at}, key=lambda s: (s is None, s or ""))
    size = [sum(r[3] for r in at if r[1] == s) for s in names]
    goal = mixing.targets(size)
    seats = mixing.sainte_lague(goal, round(sum(goal) / words), [-(-3 * w // words) for w in size])
    out = []
    for place, s in enumerate(names):
        mine = [r for r in at if r[1] == s]
        n = max(1, -(-size[place] // mixing.SHARD_WORDS), -(-len(mine) // mixing.SHARD_DOCS))
        shards = defaultdict(list)
        for r in mine:
            shards[first(seed, r[0], r[2]) % n].append(r)
        ids = sorted(shards)
        w = [sum(r[3] for r in shards[k]) for k in ids]
        blocks = [max(1, (x + words // 2) // words) for x in w]
        quota = mixing.sainte_lague([float(x) for x in w], seats[place], [3 * b if x else 0 for b, x in zip(blocks, w, strict=True)])
        for k, x, b, q in zip(ids, w, blocks, quota, strict=True):
            of = np.searchsorted([(j + 1) * x // b for j in range(b)], np.arange(x), side="right")  # each word's block
            rnd = random.Random(f"{seed} {place} {k}")
            step = rnd.randrange(1, b + 1)
            while np.gcd(step, b) != 1:
                step = step % b + 1
            offset, word = rnd.randrange(b), 0
            for r in sorted(shards[k], key=lambda r: (first(seed + 1, r[0], r[2]), r[0], r[2])):
                taken = 0
                for _ in range(r[3]):
                    taken += q // b + ((int(of[word]) * step + offset) % b < q % b)
                    word += 1
                out.append((r[0], s, r[3], taken))
    return sorted(map(str, out))


def test_mix(spark, docs, odd, monkeypatch):
    got = mixing.mix(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    by = defaultdict(lambda: [0, 0, None])
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by[r["source"]][0] += r["size"]
        by[r["source"]][1] += r["taken"]
        by[r["source"]][2] = (r["target"], r["source_size"])
    for size, taken, (target, source_size) in by.values():
        assert size == source_size and abs(taken - target) <= 2 * mixing.BLOCK_WORDS
    assert mixing.targets([100, 5, 0, 7]) == [76.0, 15.0, 0.0, 21.0]
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    assert sorted(str((r["doc_id"], r["source"], r["size"], r["taken"])) for r in got) == _mixed(rows)
    # Several shards for each source; odd rows, those that share an id among them.
    monkeypatch.setattr(mixing, "SHARD_WORDS", 300)
    more = odd.filter("doc_id is not null").unionByName(odd.filter("doc_id = 4").withColumn("text", F.lit("another text of that id")))
    for df in (docs, more):
        rows = [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
        got = mixing.mix(df, "lang", block_words=8).collect()
        assert sorted(str((r["doc_id"], r["source"], r["size"], r["taken"])) for r in got) == _mixed(rows, words=8)
    monkeypatch.setattr(mixing, "MAX_SOURCES", 2)
    with pytest.raises(ValueError):
        mixing.mix(docs)


# --- pipeline ---


def _stage_by_stage(spark, rows, sf_dir):
    import corpus_pipeline as c

    out = []
    for _, stage in c.STAGES:
        rows = common.cut(stage(spark, rows, sf_dir))
        out.append(rows)
    return out


def test_pipeline(spark, docs):
    """Each stage against its brute-force version on what its predecessor kept."""
    kept, unique, apart, mixed, coded = _stage_by_stage(spark, docs, DATA)
    assert all(x.columns == docs.columns for x in (kept, unique, apart, mixed))
    of = lambda df: sorted(map(tuple, df.select("doc_id", "text", "lang", "source", "n_chars").collect()))
    rows, labels = of(docs), spark.read.parquet(f"{DATA}/labels.parquet")
    ratios = quality.fit(docs, labels)
    good = lambda n: n[0] >= 50 and 2 * n[4] <= n[0] and n[5] >= quality.THRESHOLD
    want = [r for r in rows if good(_brute(r[1], ratios))]
    assert 0 < len(want) < len(rows) and of(kept) == want
    first = {}
    for r in want:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1]), r)
    assert of(unique) == sorted(first.values()) and len(first) < len(want)
    linked = _components([r[:2] for r in sorted(first.values())], 5)
    want = [r for r in sorted(first.values()) if linked[r[0]][1] == r[0]]
    assert of(apart) == want
    taken = Counter()
    for i, _, size, n in map(eval, _mixed([(r[0], r[1], r[3]) for r in want])):
        taken[i] += int(n / size + 0.5)
    assert of(mixed) == sorted(r for r in want for _ in range(taken[r[0]]))
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(MULTI), special_tokens={})
    got = sorted((r["doc_id"], r["text"], r["lang"], r["source"], r["ids"], r["n_tokens"]) for r in coded.collect())
    assert got == [(r[0], r[1], r[2], r[3], ids, len(ids)) for r in of(mixed) for ids in [enc.encode_ordinary(r[1])]]


def test_pipeline_stages_on_odd_rows(spark, odd, empty):
    import corpus_pipeline as c

    of = lambda df: Counter(str((r["doc_id"], r["text"], r["key"], r["label"], r["size"])) for r in df.collect())
    rows, stages = of(odd), {k: f(spark, odd, DATA) for k, f in c.STAGES[:4]}
    assert all(x.columns == odd.columns for x in stages.values())
    text = {str((r["doc_id"], r["text"], r["key"], r["label"], r["size"])): (r["doc_id"], r["text"]) for r in odd.collect()}
    assert not of(stages["quality rules"]) - rows and all(len(_words(text[k][1])) >= 50 for k in of(stages["quality rules"]))
    # Null, empty and one null id's texts are one group: the smallest id stays; the repeated row stays twice.
    blank = [k for k, (_, t) in text.items() if not t]
    got = of(stages["exact dedup"])
    assert [k for k in blank if k in got] == [k for k in blank if text[k][0] == 0] and got[next(k for k in text if text[k][0] == 4)] == 2
    got = of(stages["near dedup"])
    assert all(got[k] == rows[k] for k in text if len(_words(text[k][1])) == 0 or text[k][0] is None) and not got - rows
    assert not set(blank) & set(of(stages["mixing"]))
    back = {(r["doc_id"], r["text"], r["n_tokens"] == 0) for r in c.encode_and_decode(spark, odd, DATA).collect()}
    assert back == {(i, t or "", not t) for i, t in text.values()}
    for x in _stage_by_stage(spark, empty, DATA):
        assert x.count() == 0


def test_bpe_worker_holds_little(spark, monkeypatch):
    """In the pipeline a worker keeps less beside its executor; with chunks of 4 MB and caches of 250,000 entries two of them took it over the limit."""
    import corpus_pipeline
    from siftline.llm import bpe

    seen, was = [], bpe._encoder
    monkeypatch.setattr(bpe, "_encoder", lambda *a: (seen.append(a[3]), was(*a))[1])
    docs = spark.createDataFrame([(1, "a few words, and a few more", "en", "s")], "doc_id long, text string, lang string, source string")
    assert corpus_pipeline.encode_and_decode(spark, docs, "").collect()[0]["text"] == "a few words, and a few more"
    assert seen == [bpe.SMALL] and all(s < a for s, a in zip(bpe.SMALL, bpe.LARGE, strict=True)) and bpe.SMALL[0] <= 1_000_000
