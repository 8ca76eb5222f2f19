"""Fill-in-the-middle by escaped marker injection, in column expressions alone.

A delimiter is escaped in the text, one regexp_replace puts it after every unit,
counting it gives the number of units, and substring_index takes the units up to
or from a rank, whatever bytes they have. The parts are unescaped and set in the
order of their form. No row needs another one: nothing is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Put after each unit, and what a text's own ones are escaped with; both are escaped, so any text comes back.
DELIMITER, ESCAPE = "\x01", "\x02"
#: Units of an escaped text: a pattern must cover all of it and must not cut an escape, which has no white space.
CODE_POINTS = r"(?s)\x02[de]|[^\x02]"
WORDS = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+"
LINES = r"[^\n]*\n|[^\n]+"

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of texts that are left plain (those from this number on), and of the others those with the suffix first.
PLAIN_FROM, SPM_BELOW = 90, 20
SEED = "1"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "e")), F.lit(DELIMITER), F.lit(ESCAPE + "d"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE + "d"), F.lit(DELIMITER)), F.lit(ESCAPE + "e"), F.lit(ESCAPE))


def mark(text: Column, units: str = CODE_POINTS) -> Column:
    """The escaped text with the delimiter after every unit."""
    return F.regexp_replace(escape(text), units, "$0" + DELIMITER)


def count(marked: Column) -> Column:
    return (F.length(marked) - F.length(F.replace(marked, F.lit(DELIMITER), F.lit("")))).cast("long")


def between(marked: Column, n: Column, lo: Column, hi: Column) -> Column:
    """The units lo, lo + 1 ... hi - 1 of n as text; empty where hi is not above lo."""
    index = lambda s, k: F.call_function("substring_index", s, F.lit(DELIMITER), k.cast("int"))
    upto = F.when(hi >= n, marked).otherwise(F.concat(index(marked, hi), F.lit(DELIMITER)))
    # The last piece, after the last delimiter, is empty.
    some = F.when(lo <= 0, upto).otherwise(index(upto, lo - hi - 1))
    return F.when(hi > lo, unescape(F.replace(some, F.lit(DELIMITER), F.lit("")))).otherwise("")


def draws(key: Column, seed: str = SEED) -> list[Column]:
    """Four numbers below 2^32 from the SHA-256 of the seed, a colon and the key."""
    hex_ = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hex_, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(
    docs: DataFrame, *keep: str, key: str = "doc_id", text: str = "text", units: str = CODE_POINTS, seed: str = SEED,
    plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW, markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE),
) -> DataFrame:
    """``keep`` columns, n (units), form, prefix, middle, suffix (null in plain rows) and output, for every row.

    A null text is empty; texts that are empty or hold a marker stay plain, so
    every output can be taken apart. A null key draws as an empty one. Rows that
    repeat come out alike, each on its own; an empty table stays empty. Names
    of other columns don't matter: only ``keep``, ``key`` and ``text`` are read.
    """
    h = [F.col(f"_h{k}") for k in range(4)]
    p, s, m = markers
    t, n, lo, hi = F.col("_t"), F.col("_n"), F.col("_lo"), F.col("_hi")
    row = F.struct(*keep).alias("_row") if keep else F.lit(None).alias("_row")
    at = docs.select(row, F.coalesce(F.col(text), F.lit("")).alias("_t"), *(x.alias(f"_h{k}") for k, x in enumerate(draws(F.col(key), seed))))
    held = t.contains(p) | t.contains(s) | t.contains(m)
    form = F.when((t == "") | held | (h[2] % 100 >= plain_from), "plain").when(h[3] % 100 < spm_below, "spm").otherwise("psm")
    at = at.select("_row", "_t", "_h0", "_h1", form.alias("form"), mark(t, units).alias("_m"))
    at = at.withColumn("_n", count(F.col("_m")))
    at = at.withColumns({"_lo": F.least(h[0] % (n + 1), h[1] % (n + 1)), "_hi": F.greatest(h[0] % (n + 1), h[1] % (n + 1))})
    cut = F.col("form") != "plain"
    part = lambda a, z: F.when(cut, between(F.col("_m"), n, a, z))
    at = at.select("_row", "_t", "_n", "form", part(F.lit(0), lo).alias("prefix"), part(lo, hi).alias("middle"), part(hi, n).alias("suffix"))
    psm = F.concat(F.lit(p), "prefix", F.lit(s), "suffix", F.lit(m), "middle")
    spm = F.concat(F.lit(s), "suffix", F.lit(p), "prefix", F.lit(m), "middle")
    output = F.when(F.col("form") == "plain", t).when(F.col("form") == "psm", psm).otherwise(spm)
    return at.select(*([F.col("_row")[c].alias(c) for c in keep]), n.alias("n"), "form", "prefix", "middle", "suffix", output.alias("output"))


def restore(output: Column, form: Column, markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that an output was made of. No marker overlaps another or itself, so the first three are the injected ones."""
    pieces = F.split(output, "|".join(map(re.escape, markers)))
    a, b, c = (F.get(pieces, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == "plain", output).when(form == "psm", F.concat(a, c, b)).otherwise(F.concat(b, c, a))
