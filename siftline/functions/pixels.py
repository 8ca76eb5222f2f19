"""Perceptual hashes and structural similarity of gray images, as Arrow-batched functions.

These and the comparisons of cells.py are the only functions here that leave the
JVM: a cosine transform over 1024 pixels is a matrix product, which numpy does
for a whole batch at once.
Images are arrays of 1024 values, 32 rows of 32.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, ShortType


def packed(images: DataFrame, gray: str = "gray") -> Column:
    """Whole numbers of 0 to 255 as one byte each, 128 below; other arrays as they are. Other whole numbers are an error."""
    whole = isinstance(images.schema[gray].dataType.elementType, (IntegerType, LongType, ShortType))
    return F.transform(gray, lambda v: (v - 128).cast("tinyint")) if whole else F.col(gray)


def _images(col: pd.Series) -> np.ndarray:
    """Pixels as numbers; arrays of bytes are packed ones, and binary values those of ``raw``."""
    if len(col) and isinstance(col.iloc[0], bytes):
        whole = len(col.iloc[0]) == 1024
        return np.frombuffer(b"".join(col), np.int8 if whole else float).reshape(-1, 32, 32) + 128.0 * whole
    rows = [np.asarray(v) for v in col]
    if rows and all(v.dtype == np.int8 for v in rows):
        return (np.stack(rows) + 128.0).reshape(-1, 32, 32)
    plain = lambda v: v.astype(float) + 128 if v.dtype == np.int8 else np.asarray(v, float)
    return np.stack([plain(v).reshape(32, 32) for v in rows]) if rows else np.empty((0, 32, 32))


@pandas_udf(BinaryType())
def raw(gray: pd.Series) -> pd.Series:
    """Packed values as their bytes, other numbers as doubles': what is compared in many pairs is handed over whole and not value by value."""
    return pd.Series([(v if (v := np.asarray(x)).dtype == np.int8 else v.astype(float)).tobytes() for x in gray], dtype=object)


def _pack(bits: np.ndarray) -> pd.Series:
    """64 bits, the first the highest, as a signed long."""
    return pd.Series(np.packbits(bits.astype(np.uint8), axis=1).view(">i8").ravel().astype(np.int64))


def _shrink(img: np.ndarray, h: int, w: int, whole: bool = False) -> np.ndarray:
    """Area means onto an h x w grid; with ``whole`` sums by whole weights, which the means are proportional to."""
    def weights(n: int, m: int) -> np.ndarray:
        edges = np.linspace(0, n, m + 1)
        a, z = np.maximum(edges[:-1, None], np.arange(n)), np.minimum(edges[1:, None], np.arange(1, n + 1))
        part = np.maximum(0, z - a)
        return np.rint(part * m) if whole else part / (n / m)

    return weights(32, h) @ img @ weights(32, w).T


def _cosine(n: int) -> np.ndarray:
    k = np.arange(n)
    out = np.sqrt(2 / n) * np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))
    out[0] /= np.sqrt(2)
    return out


#: Images that are held as numbers at once, however many a batch has: as numbers they take 8 kB each, several times over.
_BLOCK = 256


#: Pairs whose windows are summed at once, so that their numbers stay in the processor's cache.
_PAIRS = 32


def _blocks(of, *columns: pd.Series, most: int = _BLOCK) -> pd.Series:
    parts = [of(*(c.iloc[k : k + most] for c in columns)) for k in range(0, len(columns[0]), most)]
    return pd.concat(parts, ignore_index=True) if parts else pd.Series([], dtype="float64")


def _grid_bits(gray: pd.Series, rising: bool) -> pd.Series:
    def of(some: pd.Series) -> pd.Series:
        # Sums in ninths of a pixel: whole numbers for whole grays, so that equal cells are equal.
        s = _shrink(_images(some), 8, 9, whole=True)
        left, right = s[:, :, :-1], s[:, :, 1:]
        return _pack((right > left if rising else left > right).reshape(len(s), 64))

    return _blocks(of, gray)


@pandas_udf(LongType())
def dhash_left(gray: pd.Series) -> pd.Series:
    """A bit where a cell is brighter than its right neighbour, on an 8 x 9 grid. Not comparable with dhash_right."""
    return _grid_bits(gray, False)


@pandas_udf(LongType())
def dhash_right(gray: pd.Series) -> pd.Series:
    """A bit where the right neighbour is brighter."""
    return _grid_bits(gray, True)


@pandas_udf(LongType())
def phash(gray: pd.Series) -> pd.Series:
    """Signs of the low 8 x 8 block of the cosine transform against the block's median without its first value."""
    d = _cosine(32)

    def of(some: pd.Series) -> pd.Series:
        low = (d @ _images(some) @ d.T)[:, :8, :8].reshape(-1, 64)
        return _pack(low > np.median(low[:, 1:], axis=1, keepdims=True))

    return _blocks(of, gray)


def _similarity(x: np.ndarray, y: np.ndarray, axes: tuple[int, ...], ddof: int) -> np.ndarray:
    n = np.prod([x.shape[a] for a in axes])
    mx, my = x.mean(axis=axes), y.mean(axis=axes)
    keep = lambda m: np.expand_dims(m, axes)
    vx, vy = ((x - keep(mx)) ** 2).sum(axis=axes) / (n - ddof), ((y - keep(my)) ** 2).sum(axis=axes) / (n - ddof)
    cov = ((x - keep(mx)) * (y - keep(my))).sum(axis=axes) / (n - ddof)
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return (2 * mx * my + c1) * (2 * cov + c2) / ((mx**2 + my**2 + c1) * (vx + vy + c2))


@pandas_udf(DoubleType())
def ssim_global(a: pd.Series, b: pd.Series) -> pd.Series:
    """Structural similarity of whole images."""
    return _blocks(lambda x, y: pd.Series(_similarity(_images(x), _images(y), (1, 2), 0)), a, b)


#: Columns of an image in each quarter of a window's side.
_QUARTERS = np.repeat(np.eye(8), 4, axis=0)


def _window_sums(img: np.ndarray) -> np.ndarray:
    """Sums over the 8 x 8 windows at a stride of 4, by blocks of 4 x 4 that neighbours share."""
    s = (img.reshape(-1, 32) @ _QUARTERS).reshape(len(img), 8, 4, 8).sum(axis=2)
    s = s[:, 1:] + s[:, :-1]
    return s[:, :, 1:] + s[:, :, :-1]


def _windowed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each pair the similarity of every window, from sums: whole numbers for whole grays, so nothing is lost by them."""
    sx, sy, n = _window_sums(x), _window_sums(y), 64
    over = lambda both, p, q: (_window_sums(both) - p * q / n) / (n - 1)
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    mx, my = sx / n, sy / n
    return (2 * mx * my + c1) * (2 * over(x * y, sx, sy) + c2) / ((mx**2 + my**2 + c1) * (over(x * x, sx, sx) + over(y * y, sy, sy) + c2))


@pandas_udf(DoubleType())
def ssim_windowed(a: pd.Series, b: pd.Series) -> pd.Series:
    """Mean similarity over 8 x 8 windows at a stride of 4, clipped to [-1, 1]."""
    return _blocks(lambda x, y: pd.Series(np.clip(_windowed(_images(x), _images(y)), -1, 1).mean(axis=(1, 2))), a, b, most=_PAIRS)
