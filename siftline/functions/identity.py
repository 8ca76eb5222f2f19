"""Digests, 64-bit fingerprints and hash-defined choices as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def signed64(hex16: Column) -> Column:
    """An unsigned 64-bit number in hex as a signed long of the same bits."""
    return F.conv(hex16, 16, -10).cast("long")


def bands(radius: int, bits: int = 64) -> list[tuple[int, int]]:
    """(shift, width) of radius + 1 bands that cover all bits: two hashes within the radius agree in one whole band."""
    n = radius + 1
    edges = [round(i * bits / n) for i in range(n + 1)]
    return [(a, z - a) for a, z in zip(edges, edges[1:], strict=False)]


def band_value(h: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1).cast("long"))


def reaches(radius: int, bits: int = 64, most: int = 8) -> list[tuple[int, int, int]]:
    """(shift, width, reach) of at most ``most`` bands that cover all bits: two hashes within the radius differ by at most ``reach`` bits in some band.

    The numbers reach + 1 add up to radius + 1, so a pair that exceeds the reach
    of every band is further apart than the radius. Bands are wide, so their
    values are many, however large the radius is.
    """
    m = min(radius + 1, most)
    return [(s, w, (radius + 1) // m + (k < (radius + 1) % m) - 1) for k, (s, w) in enumerate(bands(m - 1, bits))]


def sha_mod(text: Column, n: int) -> Column:
    """The SHA-256 of a text, as a big number, modulo n: folded digit by digit, without overflow for n < 2^58."""
    digits = F.split(F.sha2(text, 256), "")
    return F.aggregate(F.filter(digits, lambda c: c != ""), F.lit(0).cast("long"), lambda a, c: (a * 16 + F.conv(c, 16, 10).cast("long")) % n)


def inventory_digest(rows: DataFrame, by: list[str], digest: str, prefix: int = 3) -> DataFrame:
    """by, digest, n: digest of a bag of rows (hex digests), whatever their order.

    Rows are digested by the first hex digits of theirs, and these digests, in
    order, again: no task holds more than one prefix's rows.
    """
    part = rows.groupBy(*by, F.substring(digest, 1, prefix).alias("_p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(digest)), ""), 256).alias("_d"), F.count("*").alias("_n"))
    both = F.array_sort(F.collect_list(F.struct("_p", "_d")))
    return part.groupBy(*by).agg(F.sha2(F.array_join(F.transform(both, lambda s: s["_d"]), ""), 256).alias("digest"), F.sum("_n").alias("n"))
