"""Image files: size from the header, decoding, pixel digests and perceptual hashes; faults are columns, not errors.

Headers of PNG, GIF, BMP, WebP and JPEG (with its orientation) are read here,
and PNG and BMP files are decoded with numpy; other files need Pillow where
it is installed, else they have a decode_error. Contents never leave the task
that reads them: what is kept of a file is a row.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .listing import listing
from .readers import IMAGE_SUFFIXES, split_of

_PNG = b"\x89PNG\r\n\x1a\n"


def header(data: bytes) -> tuple[int, int, int] | None:
    """width, height, orientation (1 without one) as the file's header says, None if it can't be read."""
    try:
        if data[:8] == _PNG:
            return (*struct.unpack(">II", data[16:24]), 1)
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return (*struct.unpack("<HH", data[6:10]), 1)
        if data[:2] == b"BM":
            w, h = struct.unpack("<ii", data[18:26])
            return w, abs(h), 1
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            return _webp(data)
        if data[:2] == b"\xff\xd8":
            return _jpeg(data)
    except (struct.error, IndexError):
        pass
    return None


def _webp(data: bytes) -> tuple[int, int, int] | None:
    kind, at = data[12:16], data[20:]
    if kind == b"VP8X":
        return 1 + int.from_bytes(at[4:7], "little"), 1 + int.from_bytes(at[7:10], "little"), 1
    if kind == b"VP8L":
        bits = int.from_bytes(at[1:5], "little")
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF), 1
    if kind == b"VP8 ":
        w, h = struct.unpack("<HH", at[6:10])
        return w & 0x3FFF, h & 0x3FFF, 1
    return None


def _jpeg(data: bytes) -> tuple[int, int, int] | None:
    at, turn = 2, 1
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            return None
        mark, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if mark == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            turn = _orientation(data[at + 10 : at + 2 + size])
        # Frame headers, all but tables (C4), extensions (C8) and arithmetic conditioning (CC).
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", data[at + 5 : at + 9])
            return w, h, turn
        at += 2 + size
    return None


def _orientation(exif: bytes) -> int:
    order = "<" if exif[:2] == b"II" else ">"
    try:
        first = struct.unpack(order + "I", exif[4:8])[0]
        for k in range(struct.unpack(order + "H", exif[first : first + 2])[0]):
            tag, _, _, value = struct.unpack(order + "HHIH", exif[first + 2 + 12 * k : first + 12 + 12 * k])
            if tag == 0x0112:
                return value if 1 <= value <= 8 else 1
    except struct.error:
        pass
    return 1


def decode(data: bytes) -> np.ndarray:
    """Pixels as height x width x 3 bytes, the way they are shown; ValueError if that can't be done here."""
    if data[:8] == _PNG:
        return _png(data)
    if data[:2] == b"BM":
        return _bmp(data)
    try:
        from io import BytesIO

        from PIL import Image, ImageOps
    except ImportError:
        raise ValueError("no decoder for this format") from None
    with Image.open(BytesIO(data)) as im:
        return np.asarray(ImageOps.exif_transpose(im).convert("RGB"))


def _png(data: bytes) -> np.ndarray:
    at, parts, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + size
    if head is None:
        raise ValueError("no header")
    w, h, depth, colour, _, _, lace = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if depth != 8 or lace or channels is None or not w or not h or colour == 3 and palette is None:
        raise ValueError("this kind of PNG is not decoded here")
    try:
        raw = zlib.decompress(b"".join(parts))
    except zlib.error as e:
        raise ValueError(f"damaged PNG: {e}") from None
    if len(raw) < h * (1 + w * channels):
        raise ValueError("damaged PNG: too few rows")
    out, above = np.empty((h, w * channels), np.uint8), np.zeros(w * channels, np.uint8)
    for y in range(h):
        row = raw[y * (1 + w * channels) : (y + 1) * (1 + w * channels)]
        above = out[y] = _unfilter(row[0], np.frombuffer(row, np.uint8, offset=1), above, channels)
    px = out.reshape(h, w, channels)
    return palette[px[:, :, 0] % len(palette)] if colour == 3 else px[:, :, :3] if channels > 2 else np.repeat(px[:, :, :1], 3, axis=2)


def _unfilter(kind: int, row: np.ndarray, above: np.ndarray, n: int) -> np.ndarray:
    """A row of a PNG from its differences to the left, to above, to both, or to the closest of three."""
    if kind == 0:
        return row
    if kind == 2:
        return row + above
    if kind == 1:
        return np.cumsum(row.reshape(-1, n), axis=0, dtype=np.uint64).astype(np.uint8).ravel()
    out, up = [0] * n + row.tolist(), [0] * n + above.tolist()
    for k in range(n, len(out)):
        left, over, corner = out[k - n], up[k], up[k - n]
        if kind == 3:
            guess = (left + over) // 2
        elif kind == 4:
            guess = min((abs(over - corner), 0, left), (abs(left - corner), 1, over), (abs(left + over - 2 * corner), 2, corner))[2]
        else:
            raise ValueError("damaged PNG: unknown filter")
        out[k] = (out[k] + guess) & 255
    return np.array(out[n:], np.uint8)


def _bmp(data: bytes) -> np.ndarray:
    start = struct.unpack("<I", data[10:14])[0]
    w, h, _, depth, packed = struct.unpack("<iiHHI", data[18:34])
    if depth not in (24, 32) or packed not in (0, 3) or w <= 0 or h == 0:
        raise ValueError("this kind of BMP is not decoded here")
    n, stride = depth // 8, -(-w * depth // 32) * 4
    if len(data) < start + stride * abs(h):
        raise ValueError("damaged BMP: too few rows")
    rows = np.frombuffer(data, np.uint8, stride * abs(h), start).reshape(abs(h), stride)[:, : w * n].reshape(abs(h), w, n)
    return (rows[::-1] if h > 0 else rows)[:, :, 2::-1]


def thumbnail(px: np.ndarray, side: int = 32) -> np.ndarray:
    """Gray means (0.299, 0.587, 0.114) over a grid of side x side, rounded to bytes."""
    gray = px.astype(float) @ np.array([0.299, 0.587, 0.114])

    def weights(n: int) -> np.ndarray:
        edges = np.linspace(0, n, side + 1)
        low, high = np.maximum(edges[:-1, None], np.arange(n)), np.minimum(edges[1:, None], np.arange(1, n + 1))
        return np.maximum(0, high - low) / (n / side)

    return np.clip(np.round(weights(gray.shape[0]) @ gray @ weights(gray.shape[1]).T), 0, 255).astype(np.uint8)


#: What is kept of a file. hash families that resize by area are not comparable with others.
_SCAN = "path string, length long, sha256 string, width int, height int, orientation int, decoded_sha256 string, gray array<int>, gray_std double, decode_error string"


def _row(path: str, length: int, data: bytes) -> tuple:
    got, sha = header(data) or (None, None, None), hashlib.sha256(data).hexdigest()
    try:
        px = np.ascontiguousarray(decode(data))
    except (ValueError, OSError, IndexError, struct.error, zlib.error) as e:
        return path, length, sha, *got, None, None, None, str(e)[:200]
    digest = hashlib.sha256(f"RGB:{px.shape[1]}:{px.shape[0]}:".encode() + px.tobytes()).hexdigest()
    gray = thumbnail(px)
    return path, length, sha, *got, digest, gray.ravel().tolist(), float(gray.std()), None


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [f.split()[0] for f in _SCAN.split(", ")]
    for b in batches:
        yield pd.DataFrame([_row(*r) for r in zip(b["path"], b["length"], b["content"], strict=True)], columns=names)


def _files(spark: SparkSession, path: str, suffixes: tuple[str, ...], per_split: int | None = None) -> DataFrame:
    """path, length, content of image files; empty ones too. With ``per_split`` the first by path of each split, of which alone any content is read."""
    named = listing(spark, path).filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*suffixes)).select("path", "length")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if per_split is None:
        at = read.load(path).select("path", "content")
    else:
        w = Window.partitionBy(split_of(F.col("path"))).orderBy("path")
        named = cut(named.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per_split).drop("_r"))
        some = [r["path"] for r in named.filter("length > 0").select("path").collect()]  # per_split names of each split
        at = read.load([re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in some]).select("path", "content") if some else read.load(path).select("path", "content").limit(0)
    return named.join(at, "path", "left").withColumn("content", F.coalesce("content", F.lit(b"")))


def content_scan(spark: SparkSession, path: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES, per_split: int | None = None) -> DataFrame:
    """A row for each image below a folder: digest of its bytes, size, digest of its pixels, gray thumbnail, or why it can't be decoded.

    ``per_split`` takes the first files by path of each split, for a trial run;
    the others are not opened.
    """
    return _files(spark, path, suffixes, per_split).select("path", "length", "content").mapInPandas(_scan, _SCAN)


def header_scan(spark: SparkSession, path: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES) -> DataFrame:
    """path, width, height as shown (orientations 5 to 8 swap them), null where the header can't be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *(header(c) or (None, None, None))) for p, c in zip(b["path"], b["content"], strict=True)]
            yield pd.DataFrame([(p, *((h, w) if t is not None and t > 4 else (w, h))) for p, w, h, t in rows], columns=["path", "width", "height"])

    return _files(spark, path, suffixes).select("path", "content").mapInPandas(run, "path string, width int, height int")


def changed_files(before: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """path, fault of files whose length or time of change is not what a listing (path, length, modificationTime) had; removed ones too."""
    now = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("_l"), F.col("modificationTime").alias("_m"))
    at = before.select("path", "length", "modificationTime").join(now, "path", "left")
    fault = F.when(F.col("_l").isNull(), "removed").when((F.col("_l") != F.col("length")) | (F.col("_m") != F.col("modificationTime")), "changed")
    return at.select("path", fault.alias("fault")).filter("fault is not null")
