"""Synthetic variants of rasters: seeded by each row's key and the variant's number, so that reruns and retries agree."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.vision import blur, resize_area, resize_cubic


def degrade(image, rng, least=0.4):
    """Down to a share of its size and up again."""
    h, w = image.shape
    k = rng.uniform(least, 0.9)
    return resize_cubic(resize_area(image, max(1, round(h * k)), max(1, round(w * k))), h, w)


def soften(image, rng):
    return blur(image, 3, rng.uniform(0.4, 1.2))


def motion(image, rng):
    """Mean along a row or column."""
    n, axis = int(rng.integers(2, 5)), int(rng.integers(0, 2))
    return np.mean([np.roll(image, k - n // 2, axis) for k in range(n)], axis=0)


def salt_pepper(image, rng, share=0.02):
    r = rng.random(image.shape)
    return np.where(r < share / 2, 0.0, np.where(r > 1 - share / 2, 255.0, image))


def light(image, rng):
    """Contrast about the middle, and brightness."""
    return (image - 127.5) * rng.uniform(0.7, 1.3) + 127.5 + rng.uniform(-25, 25)


def occlude(image, rng):
    """A rectangle of at most a third of each side turns white."""
    h, w = image.shape
    a, b = int(rng.integers(1, max(2, h // 3 + 1))), int(rng.integers(1, max(2, w // 3 + 1)))
    y, x = int(rng.integers(0, h - a + 1)), int(rng.integers(0, w - b + 1))
    out = image.copy()
    out[y : y + a, x : x + b] = 255.0
    return out


def _sample(image, y, x):
    """Bilinear values at fractional places; white outside."""
    h, w = image.shape
    p = np.pad(image, 1, constant_values=255.0)
    y, x = np.clip(y + 1, 0, h + 1), np.clip(x + 1, 0, w + 1)
    i, j = np.minimum(y.astype(int), h), np.minimum(x.astype(int), w)
    b, a = y - i, x - j
    return (p[i, j] * (1 - a) + p[i, j + 1] * a) * (1 - b) + (p[i + 1, j] * (1 - a) + p[i + 1, j + 1] * a) * b


def affine(image, rng):
    """A small turn, shear and scale about the centre."""
    h, w = image.shape
    t, s, k = np.deg2rad(rng.uniform(-6, 6)), rng.uniform(-0.1, 0.1), rng.uniform(0.9, 1.1)
    y, x = np.mgrid[:h, :w].astype(float)
    y, x = y - (h - 1) / 2, x - (w - 1) / 2
    return _sample(image, (np.sin(t) * x + np.cos(t) * y) / k + (h - 1) / 2, (np.cos(t) * x - np.sin(t) * y + s * y) / k + (w - 1) / 2)


def elastic(image, rng, strength=1.5):
    """Each pixel from a place moved by smooth noise."""
    h, w = image.shape
    size = min(7, 2 * (min(h, w) // 2) - 1)
    move = [blur(rng.uniform(-1, 1, (h, w)), max(size, 1), 2.0) * strength for _ in range(2)]
    y, x = np.mgrid[:h, :w].astype(float)
    return _sample(image, y + move[0], x + move[1])


def texture(image, rng):
    return image + blur(rng.normal(0, 12, image.shape), 3, 1.0)


def slope_light(image, rng):
    """Light that falls off from one side to the other."""
    h, w = image.shape
    return image * (1 - rng.uniform(0.05, 0.3) * (np.linspace(0, 1, w)[None, :] if rng.random() < 0.5 else np.linspace(0, 1, h)[:, None]))


def binarise(image, rng):
    return np.where(image > rng.uniform(100, 180), 255.0, 0.0)


STEPS = {f.__name__: f for f in (degrade, soften, motion, salt_pepper, light, occlude, affine, elastic, texture, slope_light, binarise)}


def variant(image: np.ndarray, key: str, number: int, steps: int = 3) -> tuple[np.ndarray, list]:
    """A 0..255 raster after ``steps`` different steps drawn by (key, number), and their names."""
    rng = np.random.default_rng([zlib.crc32(key.encode()), number])
    names = [list(STEPS)[i] for i in rng.choice(len(STEPS), steps, replace=False)]
    out = np.asarray(image, float)
    for n in names:
        out = np.clip(STEPS[n](out, rng), 0.0, 255.0)
    return np.rint(out), names


def variants(df: DataFrame, key: str, h: int, w: int, copies: int) -> DataFrame:
    """(key, label, copy, steps, px) for ``copies`` variants of each raster (key, label, px of 0..255); null rasters give none."""

    def run(frames):
        for f in frames:
            made = [variant(np.asarray(a, float).reshape(h, w), str(k), int(c)) for k, c, a in zip(f[key], f["copy"], f["px"])]
            yield f.assign(steps=[n for _, n in made], px=[p.ravel().tolist() for p, _ in made])[[key, "label", "copy", "steps", "px"]]

    kinds = dict(df.dtypes)
    each = df.where(F.size("px") == h * w).select(key, "label", "px", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy"))
    return each.mapInPandas(run, f"{key} {kinds[key]}, label {kinds['label']}, copy int, steps array<string>, px array<double>")


def to_height(image: np.ndarray, rng, height: int, width: int) -> np.ndarray:
    """Scaled to a height with its shape kept, then padded with white on a random share of either side; squeezed to the width
    if it is too wide."""
    h, w = image.shape
    new = max(1, int(w * (height / h)))
    out = np.clip(resize_cubic(image.astype(float), height, min(new, width)), 0.0, 255.0)
    left = int(rng.integers(0, width - out.shape[1] + 1))
    return np.pad(out, ((0, 0), (left, width - out.shape[1] - left)), constant_values=255.0)


def noise_patch(kind: str, size: int, rng) -> np.ndarray:
    """A raster that shows nothing: light greys (gaussian), specks on white (salt_pepper), or blurred strokes (blur)."""
    if kind == "gaussian":
        return rng.integers(128, 255, (size, size)).astype(float)
    if kind == "salt_pepper":
        hit = rng.random((size, size)) < 0.1
        return np.where(hit, rng.choice([0.0, 255.0], (size, size)), 255.0)
    if kind != "blur":
        raise ValueError(f"no noise is called {kind}")
    out = np.full((size, size), 255.0)
    for _ in range(5):
        (x0, y0), (x1, y1) = rng.integers(0, size, (2, 2))
        grey, steps = float(rng.integers(0, 129)), max(abs(int(x1) - int(x0)), abs(int(y1) - int(y0)), 1)
        for k in range(steps + 1):
            y, x = round(y0 + (y1 - y0) * k / steps), round(x0 + (x1 - x0) * k / steps)
            out[y : y + 2, x : x + 2] = grey
    return blur(out, 13, 2.0)


def vocabulary(common: list, extra: list = ()) -> list:
    """Tokens to draw samples of, each once, in order: decimals that begin with a dot, numbers that end with one, whole numbers
    with .0, the common words, and any others."""
    rules = [*(f".{k}" for k in range(10)), *(f"{k}." for k in range(1, 21)), *(f"{k}.0" for k in range(10))]
    return list(dict.fromkeys([*rules, *common, *extra]))


def class_tokens(spark, words: list, n: int, seed: int = 42) -> DataFrame:
    """(id, kind, token): n tokens each of NUMBER, WORD and OTHER. Which one is drawn hangs on the id and the seed alone."""
    pick = lambda salt, m: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "id", "kind"), F.lit(m)).cast("int")
    table = lambda values, salt: F.get(F.array(*(F.lit(v) for v in values)), pick(salt, len(values)))
    digits = F.format_string("%d", pick("digits", 100_000))
    number = F.when(pick("form", 3) == 0, digits).when(pick("form", 3) == 1, F.concat(digits, F.lit(","), pick("tail", 100).cast("string"))).otherwise(F.concat(F.lit("-"), digits, F.lit("."), pick("tail", 10).cast("string")))
    other = F.when(pick("form", 3) == 0, F.lit("")).when(pick("form", 3) == 1, table(["№", "§", "±", "*", "/", "|"], "sign")).otherwise(F.concat(table(words, "word"), digits))
    rows = spark.range(n).select("id", F.explode(F.array(*map(F.lit, ("NUMBER", "WORD", "OTHER")))).alias("kind"))
    return rows.select("id", "kind", F.when(F.col("kind") == "NUMBER", number).when(F.col("kind") == "WORD", table(words, "word")).otherwise(other).alias("token"))
