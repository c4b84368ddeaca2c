"""Rasters as struct<h, w, px>: array expressions where they suffice, numpy in Arrow functions for the rest."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BOXES = "array<struct<x:int,y:int,w:int,h:int,area:int,cx:double,cy:double>>"


def mask_light(px: Column, limit: float) -> Column:
    """Light pixels become white (1)."""
    return F.transform(px, lambda p: F.when(p > limit, F.lit(1.0)).otherwise(p))


def transpose(px: Column, h: int, w: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(h * w - 1)), lambda k: F.get(px, F.pmod(k, F.lit(h)) * w + F.floor(k / h).cast("int")))


def rotate_clockwise(px: Column, h: int, w: int) -> Column:
    """Rows of the result are the columns read upwards: (i, j) comes from (h - 1 - j, i)."""
    return F.transform(F.sequence(F.lit(0), F.lit(h * w - 1)), lambda k: F.get(px, (h - 1 - F.pmod(k, F.lit(h))) * w + F.floor(k / h).cast("int")))


def crop(px: Column, w: int, x: int, y: int, cw: int, ch: int) -> Column:
    return F.flatten(F.array(*(F.slice(px, (y + i) * w + x + 1, cw) for i in range(ch))))


def pad(px: Column, h: int, w: int, to_h: int, to_w: int, value: float) -> Column:
    """Centred on a larger raster; left and top get the smaller half."""
    top, left = (to_h - h) // 2, (to_w - w) // 2
    blank = lambda n: F.array_repeat(F.lit(value), n)
    rows = [blank(top * to_w), *(F.concat(blank(left), F.slice(px, i * w + 1, w), blank(to_w - w - left)) for i in range(h)), blank((to_h - h - top) * to_w)]
    return F.concat(*rows)


def clamped_crop(px: Column, h: int, w: int, x: Column, y: Column, cw: Column, ch: Column, margin: int) -> Column:
    """The box (x, y, cw, ch) with a margin, cut off at the raster's edges; empty if nothing of it lies inside."""
    x0, x1 = F.greatest(x - margin, F.lit(0)), F.least(x + cw + margin, F.lit(w))
    y0, y1 = F.greatest(y - margin, F.lit(0)), F.least(y + ch + margin, F.lit(h))
    return F.filter(px, lambda _, k: (k % w >= x0) & (k % w < x1) & (F.floor(k / w) >= y0) & (F.floor(k / w) < y1))


def pad_or_crop(px: Column, h: Column, w: Column, size: int, white: float) -> Column:
    """struct(px, h): cropped about the middle where it is larger than ``size``; the width alone is padded, with the smaller
    half on the left."""
    left, top = F.greatest(F.floor((w - size) / 2), F.lit(0)), F.greatest(F.floor((h - size) / 2), F.lit(0))
    cw, ch = F.least(w, F.lit(size)).cast("int"), F.least(h, F.lit(size)).cast("int")
    before = F.floor((size - cw) / 2).cast("int")
    row = lambda i: F.concat(F.array_repeat(F.lit(white), before), F.slice(px, ((top + i) * w + left + 1).cast("int"), cw), F.array_repeat(F.lit(white), size - cw - before))
    return F.struct(F.flatten(F.transform(F.sequence(F.lit(0), ch - 1), row)).alias("px"), ch.alias("h"))


def mask_or(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x | y)


def mask_and(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x & y)


def unit(grey: Column) -> Column:
    """Greys of 0 to 255 as 0 to 1."""
    return F.transform(grey, lambda x: x / 255)


def oversized(h: Column, w: Column) -> Column:
    """Whether a glyph of this size may be two: 7 pixels one way and wider than high."""
    return ((h >= 7) | (w >= 7)) & F.coalesce(F.try_divide(w, h) > 1, F.lit(False))


def sound_box(least: int) -> Column:
    """Whether x_min, x_max, y_min, y_max is a box with ``least`` pixels each way."""
    return (F.col("x_max") - F.col("x_min") >= least) & (F.col("y_max") - F.col("y_min") >= least)


def flip_symmetry(px: Column, h: int, w: int) -> Column:
    """Mean over both axes of 1 - mean |image - flipped|."""
    at = F.sequence(F.lit(0), F.lit(h * w - 1))

    def likeness(place):
        return 1 - F.aggregate(at, F.lit(0.0), lambda s, k: s + F.abs(F.get(px, k) - F.get(px, place(k)))) / (h * w)

    return (likeness(lambda k: F.floor(k / w).cast("int") * w + (w - 1 - F.pmod(k, F.lit(w)))) + likeness(lambda k: (h - 1 - F.floor(k / w).cast("int")) * w + F.pmod(k, F.lit(w)))) / 2


def label_components(ink: np.ndarray) -> np.ndarray:
    """8-connected components of a boolean raster, numbered from 1 in row order of their first pixel."""
    h, w = ink.shape
    label = np.where(ink, np.arange(1, h * w + 1).reshape(h, w), 0)
    big = h * w + 1
    while True:
        p = np.pad(np.where(ink, label, big), 1, constant_values=big)
        low = np.min([p[a : a + h, b : b + w] for a in range(3) for b in range(3)], axis=0)
        new = np.where(ink, low, 0)
        if np.array_equal(new, label):
            break
        label = new
    names = np.unique(label[ink])
    return np.where(ink, np.searchsorted(names, label) + 1, 0)


def boxes(ink: np.ndarray, least: int = 1) -> list[dict]:
    label = label_components(ink)
    out = []
    for k in range(1, int(label.max(initial=0)) + 1):
        y, x = np.nonzero(label == k)
        if len(x) >= least:
            out.append({"x": int(x.min()), "y": int(y.min()), "w": int(np.ptp(x) + 1), "h": int(np.ptp(y) + 1), "area": len(x), "cx": float(x.mean()), "cy": float(y.mean())})
    return out


def components_of(px: Column, h: int, w: int, threshold: float, least: int = 1) -> Column:
    """Boxes of the components of pixels above the threshold."""

    @F.pandas_udf(BOXES)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda a: boxes(np.asarray(a, float).reshape(h, w) > threshold, least))

    return run(px)


def erode(image: np.ndarray, kh: int, kw: int) -> np.ndarray:
    p = np.pad(image, ((kh // 2, kh - 1 - kh // 2), (kw // 2, kw - 1 - kw // 2)), mode="edge")
    return np.lib.stride_tricks.sliding_window_view(p, (kh, kw)).min((2, 3))


def dilate(image: np.ndarray, kh: int, kw: int) -> np.ndarray:
    return -erode(-image.astype(np.int64), kh, kw)


def line_mask(ink: np.ndarray, length: int, horizontal: bool = True) -> np.ndarray:
    """Only strokes of at least ``length``: opening with a one-pixel-wide element."""
    k = (1, length) if horizontal else (length, 1)
    return dilate(erode(np.pad(ink, ((length, length), (length, length))).astype(np.int64), *k), k[0] + 1 - k[0] % 2, k[1] + 1 - k[1] % 2)[length:-length, length:-length] * ink


def otsu(px: np.ndarray) -> int:
    """The level that parts 0..255 values with the greatest variance between; the first of equals."""
    n = np.bincount(px.ravel().astype(np.int64), minlength=256).astype(float)
    below, mass = np.cumsum(n), np.cumsum(n * np.arange(256))
    a, b = below, below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = a * b * (mass / a - (mass[-1] - mass) / b) ** 2
    return int(np.nanargmax(np.where((a > 0) & (b > 0), between, 0.0)))


def adaptive_mean(gray: np.ndarray, block: int, c: float) -> np.ndarray:
    """True where a pixel is darker than its surroundings' mean less c."""
    p = np.pad(gray.astype(float), block // 2, mode="edge")
    return gray < np.lib.stride_tricks.sliding_window_view(p, (block, block)).mean((2, 3)) - c


def resize_nearest(image: np.ndarray, h: int, w: int) -> np.ndarray:
    return image[(np.arange(h) * image.shape[0] // h)[:, None], np.arange(w) * image.shape[1] // w]


def write_png(gray: np.ndarray) -> bytes:
    h, w = gray.shape
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    raw = b"".join(b"\0" + gray[i].astype(np.uint8).tobytes() for i in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
