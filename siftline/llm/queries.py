"""The queries of this subpackage and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact, fim, merkle, mixing, near, pii, quality, rollup, tokenfile, toxicity, warc
from .common import cut, fresh_dir, table


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each conversation's formatted text reads back as, and one more that holds control strings; null texts are empty."""
    extra = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    done = chat.from_table(rows).select("conv_id", chat.format_chat(F.col("turns")).alias("formatted"))
    back = done.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
with rows as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
              union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
esc as (select *, regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g') as etext from rows)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(length('<|im_start|>') + length(role) + 1 + length(etext) + length('<|im_end|>') + 1)::bigint as formatted_chars
from esc group by conv_id
"""


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the rules, ratio and verdict of every document; null, empty and blank texts have no words and fail."""
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of its equal texts; null counts as empty."""
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id is not distinct from min(doc_id) over w as kept, sha256(t) as text_sha256
from d window w as (partition by t)
"""


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file; a parameter of the queries below."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from token files."""
    folder = fresh_dir(spark, "tokens")
    tokenfile.write(table(spark, sf_dir, "documents"), folder, tokenizer or vocabulary("byte_bpe_50k.json"))
    return tokenfile.checksums(spark, folder)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans, and of all spans n_secret and n_spans, for every document."""
    found = pii.find(table(spark, sf_dir, "documents"))
    kind = F.array(*map(F.lit, pii.KINDS))
    name = lambda s: F.concat(F.get(kind, s["kind"]), F.lit(":"), s["start"], F.lit(":"), s["end"])
    text = lambda c: F.array_join(F.transform(c, name), ",")
    count = lambda c, k: F.size(F.filter(c, lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *(count("base", pii.KINDS.index(k)).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")),
        F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"),
        count("spans", pii.KINDS.index("secret")).alias("n_secret"), F.size("spans").cast("long").alias("n_spans"),
    )


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component of documents that are similar over word pairs; texts without words are linked with nothing."""
    return near.near_dedup(table(spark, sf_dir, "documents"), width=2)


def op5_bpe(spark: SparkSession, sf_dir: str, ranks: str | None = None) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the bytes decoded from them, for every document."""
    both = bpe.round_trip(table(spark, sf_dir, "documents"), ranks or vocabulary("byte_bpe_multi_50k.tiktoken"), "doc_id")
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as the archives have it, response or revisit; a null html is an empty payload."""
    folder = fresh_dir(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = r"""
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
q as (select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest, payload_bytes >= 1000) end as last from p)
select page_id, payload_bytes, payload_digest, case when last <> page_id then 'revisit' else 'response' end as record_type,
       case when last <> page_id then last end as refers_to from q
"""


def op9_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Totals after three batches over all documents, the last of which comes twice.

    Counts of words and of the tokenizer's ids come in for every document;
    toxic documents go; and the tokenizer's counts of all that stay move to a
    second version, which reads runs of white space as one space. Texts are
    tokenized once: the batches read a table of counts.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    path = tokenizer or vocabulary("byte_bpe_50k.json")
    words, one, two = "words-1", "byte_bpe_50k-1", "byte_bpe_50k-2"
    counts = cut(rollup.counted(docs, {words: rollup.as_is}, {one: (path, rollup.as_is), two: (path, rollup.single_spaced)}))
    toxic = labels.filter("toxic = 1").select("doc_id").distinct()
    store = rollup.RollupStore(spark, fresh_dir(spark, "rollup"))
    store.commit("0001-insert", rollup.inserts(rollup.of(counts, words, one)))
    gone, stay = counts.join(toxic, "doc_id", "left_semi"), counts.join(toxic, "doc_id", "left_anti")
    store.commit("0002-delete-toxic", rollup.deletes(rollup.of(gone, words, one)))
    for _ in range(2):
        store.commit("0003-second-version", rollup.revisions(rollup.moved(stay, one, two)))
    return store.totals()


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, source size, target and words taken of every document; null and wordless texts have size 0 and give none."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; labels of the held-out third are not learned from."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and what its proof leads to where a third of the texts is lower-cased."""
    docs = table(spark, sf_dir, "documents")
    chosen = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    text = F.when(chosen, merkle.lower_a_z(F.col("text"))).otherwise(F.col("text"))
    return merkle.manifest(docs, text, with_path=False)


OP12_SQL = r"""
with recursive
d as (select lang, doc_id, text, coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
             || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as head,
             xor(list_reduce(list_transform(range(length(doc_id::varchar)), lambda i: ascii(substr(doc_id::varchar, (i + 1)::int, 1))::ubigint),
                 lambda c, b: list_reduce(range(8)::ubigint[], lambda r, k: case when r & 1 = 1 then xor(r >> 1, 3988292384::ubigint) else r >> 1 end, xor(c, b)),
                 4294967295::ubigint), 4294967295::ubigint) % 3 = 0 as chosen from documents),
e as (select lang, doc_id, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
             sha256(head || coalesce(strlen(text) || ':' || case when chosen then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end, '-')) as other from d),
t as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos from e),
lv as (select lang, 0 as lvl, pos, leaf as h, count(*) over (partition by lang) as n from t
       union all select lang, lvl + 1, pos // 8, sha256(string_agg(h, '' order by pos)), (any_value(n) + 7) // 8 from lv where n > 1 group by lang, lvl, pos // 8),
r as (select lang, h as subroot, row_number() over (order by lang nulls first) - 1 as gpos from lv where n = 1),
gv as (select 0 as lvl, gpos as pos, subroot as h, count(*) over () as n from r
       union all select lvl + 1, pos // 8, sha256(string_agg(h, '' order by pos)), (any_value(n) + 7) // 8 from gv where n > 1 group by lvl, pos // 8),
near as (select t.lang, t.pos, lvl as step, s.pos as place, s.h, t.pos // (8 ** lvl)::bigint as own from t join lv s on s.lang is not distinct from t.lang and s.n > 1 and s.pos // 8 = t.pos // (8 ** (lvl + 1))::bigint
         union all select t.lang, t.pos, 100 + lvl, s.pos, s.h, gpos // (8 ** lvl)::bigint from t join r on r.lang is not distinct from t.lang join gv s on s.n > 1 and s.pos // 8 = gpos // (8 ** (lvl + 1))::bigint),
steps as (select lang, pos, step, coalesce(string_agg(h, '' order by place) filter (place < own), '') as l, coalesce(string_agg(h, '' order by place) filter (place > own), '') as r from near group by all),
paths as (select lang, pos, sha256(string_agg(l || r, '' order by step)) as proof, list(l || '|' || r order by step) as path from steps group by lang, pos),
f as (select t.doc_id, t.leaf, r.subroot, (select h from gv where n = 1) as root, coalesce(p.proof, sha256('')) as proof_sha256,
             list_reduce(coalesce(p.path, []), lambda a, s: sha256(split_part(s, '|', 1) || a || split_part(s, '|', 2)), t.other) as folded_root
      from t join r on r.lang is not distinct from t.lang left join paths p on p.lang is not distinct from t.lang and p.pos = t.pos)
select *, folded_root = root as verified from f
"""


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the parts, and digests of the output and of the text that is rebuilt from it, for every document."""
    made = fim.transform(table(spark, sf_dir, "documents"), "doc_id")
    return made.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP13_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(doc_id::varchar, '')) as x from documents),
h as (select doc_id, t, length(t) as n, ('0x' || x[1:8])::ubigint as h1, ('0x' || x[9:16])::ubigint as h2, ('0x' || x[17:24])::ubigint as h3, ('0x' || x[25:32])::ubigint as h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1))::bigint as lo, greatest(h1 % (n + 1), h2 % (n + 1))::bigint as hi,
             case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from h),
p as (select *, substr(t, 1, lo) as pre, substr(t, lo + 1, hi - lo) as mid, substr(t, hi + 1) as suf from c)
select doc_id, n, form, case when form <> 'plain' then lo end as prefix_chars, case when form <> 'plain' then hi - lo end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
       sha256(t) as restored_sha256 from p
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_chat, op2_token_files, op3_pii, op4_near_dedup, op5_bpe, op6_warc, op7_exact_dedup, op8_quality, op9_token_counts, op10_mixing, op11_toxicity, op12_merkle, op13_fim)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat": OP1_SQL, "op6_warc": OP6_SQL, "op7_exact_dedup": OP7_SQL, "op12_merkle": OP12_SQL, "op13_fim": OP13_SQL}
