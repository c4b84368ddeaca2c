"""Image kernels beyond thresholds and components: warps, edge-keeping filters, outlines, gradients and descriptors.

Kernels take one small raster (a cell, a word, a glyph) as a numpy array and hold nothing between rasters;
``kernel_column`` puts one behind an Arrow function, so that rasters of any number go through in batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.operators.raster import dilate, erode, label_components

#: Steps round a pixel, clockwise from the east, rows downwards.
AROUND = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]


def kernel_column(px: Column, h: int, w: int, kind: str, kernel) -> Column:
    """kernel(raster of h x w) for each row of a pixel-array column; a null raster, or one of another size, gives null."""

    def one(a):
        if a is None or len(a) != h * w:
            return None
        return kernel(np.asarray(a, float).reshape(h, w))

    @F.pandas_udf(kind)
    def scalar(s: pd.Series) -> pd.Series:
        return s.map(one)

    @F.pandas_udf(kind)
    def record(s: pd.Series) -> pd.DataFrame:
        names = [part.split(":")[0].strip() for part in kind[len("struct<") : -1].split(",")]
        return pd.DataFrame([one(a) or dict.fromkeys(names) for a in s], columns=names)

    return (record if kind.startswith("struct<") else scalar)(px)


# -- geometry


def order_corners(points: np.ndarray) -> np.ndarray:
    """Four (x, y) points as top left, top right, bottom right, bottom left."""
    total, slope = points.sum(1), points[:, 1] - points[:, 0]
    return points[[total.argmin(), slope.argmin(), total.argmax(), slope.argmax()]]


def homography(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The 3 x 3 map that takes each of four source points to its target."""
    rows, right = [], []
    for (x, y), (u, v) in zip(source, target):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1.0).reshape(3, 3)


def warp(image: np.ndarray, corners: np.ndarray, h: int, w: int, blank: float = 255.0) -> np.ndarray:
    """The quadrilateral of ``image`` straightened to h x w, nearest pixel; what lies outside is blank."""
    quad = order_corners(np.asarray(corners, float))
    back = homography(np.array([[0, 0], [w - 1, 0], [w - 1, h - 1], [0, h - 1]]), quad)
    y, x = np.mgrid[:h, :w]
    u, v, s = np.tensordot(back, np.stack([x, y, np.ones_like(x)]).astype(float), 1)
    px, py = np.rint(u / s).astype(int), np.rint(v / s).astype(int)
    inside = (px >= 0) & (py >= 0) & (px < image.shape[1]) & (py < image.shape[0])
    return np.where(inside, image[np.clip(py, 0, image.shape[0] - 1), np.clip(px, 0, image.shape[1] - 1)], blank)


def resize_area(image: np.ndarray, h: int, w: int) -> np.ndarray:
    """Each new pixel is the mean of the area that it covers."""

    def share(n, m):
        edge = np.linspace(0, n, m + 1)
        over = np.minimum(edge[1:, None], np.arange(1, n + 1)) - np.maximum(edge[:-1, None], np.arange(n))
        return np.maximum(over, 0) * m / n

    return share(image.shape[0], h) @ image @ share(image.shape[1], w).T


def resize_cubic(image: np.ndarray, h: int, w: int, a: float = -0.75) -> np.ndarray:
    """Cubic convolution with pixel centres aligned and edges repeated."""

    def weights(n, m):
        at = (np.arange(m) + 0.5) * n / m - 0.5
        out = np.zeros((m, n))
        for k in range(-1, 3):
            place = np.floor(at).astype(int) + k
            d = np.abs(at - place)
            near, far = (a + 2) * d**3 - (a + 3) * d**2 + 1, a * (d**3 - 5 * d**2 + 8 * d - 4)
            np.add.at(out, (np.arange(m), np.clip(place, 0, n - 1)), np.where(d <= 1, near, far))
        return out

    return weights(image.shape[0], h) @ image @ weights(image.shape[1], w).T


# -- filters


def _windows(image: np.ndarray, size: int) -> np.ndarray:
    p = np.pad(image.astype(float), size // 2, mode="reflect" if min(image.shape) > size // 2 else "edge")
    return np.lib.stride_tricks.sliding_window_view(p, (size, size))


def gaussian(size: int, sigma: float = 0.0) -> np.ndarray:
    sigma = sigma or 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    g = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma * sigma))
    return np.outer(g, g) / g.sum() ** 2


def blur(image: np.ndarray, size: int, sigma: float = 0.0) -> np.ndarray:
    return (_windows(image, size) * gaussian(size, sigma)).sum((2, 3))


def bilateral(image: np.ndarray, size: int = 9, sigma_value: float = 75.0, sigma_space: float = 75.0) -> np.ndarray:
    """A mean over a disc, weighted by nearness in place and in value: smooths flat areas, keeps edges."""
    view, r = _windows(image, size), size // 2
    y, x = np.mgrid[-r : r + 1, -r : r + 1]
    place = np.where(x * x + y * y <= r * r, np.exp(-(x * x + y * y) / (2 * sigma_space**2)), 0.0)
    weight = place * np.exp(-((view - image[:, :, None, None]) ** 2) / (2 * sigma_value**2))
    return (weight * view).sum((2, 3)) / weight.sum((2, 3))


def adaptive_gaussian(gray: np.ndarray, block: int, c: float) -> np.ndarray:
    """True where a pixel is no lighter than its surroundings' weighted mean less c."""
    return gray <= blur(gray, block) - c


def equalize(gray: np.ndarray) -> np.ndarray:
    """0..255 levels spread so that the cumulative histogram is a line; a raster of one level stays."""
    n = np.bincount(gray.astype(int).ravel(), minlength=256)
    upto = np.cumsum(n)
    low = upto[np.flatnonzero(n)[0]]
    if upto[-1] == low:
        return gray.astype(int)
    return np.rint(np.clip(upto - low, 0, None) * 255 / (upto[-1] - low)).astype(int)[gray.astype(int)]


def clahe(grey: np.ndarray, clip: float, tiles: tuple = (8, 8)) -> np.ndarray:
    """Contrast raised tile by tile: each tile's histogram is cut at ``clip`` times its mean, what was cut is dealt to all levels,
    and a pixel is mapped by the four tiles around it, weighted by nearness."""
    g = np.asarray(grey).astype(np.uint8)
    h, w = g.shape
    rows, cols = tiles
    wide = np.pad(g, ((0, -h % rows), (0, -w % cols)), mode="reflect") if h % rows or w % cols else g
    th, tw = wide.shape[0] // rows, wide.shape[1] // cols
    limit = max(1, int(clip * th * tw / 256))
    maps = np.zeros((rows, cols, 256))
    for r in range(rows):
        for c in range(cols):
            counts = np.bincount(wide[r * th : (r + 1) * th, c * tw : (c + 1) * tw].ravel(), minlength=256)
            over = int(np.maximum(counts - limit, 0).sum())
            counts = np.minimum(counts, limit) + over // 256
            if rest := over % 256:
                counts[: rest * max(256 // rest, 1) : max(256 // rest, 1)] += 1
            maps[r, c] = np.clip(np.rint(np.cumsum(counts) * (255 / (th * tw))), 0, 255)
    y, x = (np.arange(h) / th - 0.5)[:, None], (np.arange(w) / tw - 0.5)[None, :]
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = y - y0, x - x0
    at = lambda i, j: maps[np.clip(i, 0, rows - 1), np.clip(j, 0, cols - 1), g]
    upper, lower = at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx, at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx
    return np.clip(np.rint(upper * (1 - fy) + lower * fy), 0, 255)


def close_gaps(mask: np.ndarray, length: int, horizontal: bool = True) -> np.ndarray:
    """Gaps shorter than ``length`` between marked pixels of a row (or column) are filled; nothing else grows."""
    kh, kw = (1, length) if horizontal else (length, 1)
    wide = np.pad(mask.astype(np.int64), length)
    flipped = erode(dilate(wide, kh, kw)[::-1, ::-1], kh, kw)[::-1, ::-1]
    return (flipped[length:-length, length:-length] > 0) | (mask > 0)


def line_between(mask: np.ndarray, start: tuple, end: tuple, samples: int = 3, reach: int = 3, least: int = 5, level: float = 50) -> bool:
    """Whether most samples of a segment between two (x, y) points have a run of marked pixels across a band about it."""
    (x0, y0), (x1, y1) = start, end
    upright, votes = abs(y1 - y0) > abs(x1 - x0), 0
    for k in range(1, samples + 1):
        x, y = round(x0 + (x1 - x0) * k / (samples + 1)), round(y0 + (y1 - y0) * k / (samples + 1))
        if upright:
            part = mask[max(0, y - least) : y + least + 1, max(0, x - reach) : x + reach + 1].max(1, initial=0)
        else:
            part = mask[max(0, y - reach) : y + reach + 1, max(0, x - least) : x + least + 1].max(0, initial=0)
        run = best = 0
        for on in part > level:
            run = run + 1 if on else 0
            best = max(best, run)
        votes += best >= least
    return 2 * votes >= samples + samples % 2


def drop_dark_lines(image: np.ndarray, level: float = 10, share: float = 0.95) -> np.ndarray:
    """The raster without the columns, then the rows, of which at least ``share`` is as dark as ``level``."""
    for axis in (0, 1):
        if image.size:
            image = np.compress((image <= level).mean(axis) < share, image, axis=1 - axis)
    return image


# -- outlines


def outline(ink: np.ndarray) -> np.ndarray:
    """(x, y) of the outer boundary of the component whose first pixel in row order is first, clockwise."""
    if not ink.any():
        return np.zeros((0, 2), int)
    p = np.pad(ink, 1)
    first = tuple(np.argwhere(p)[0])
    at, facing, path, seen = first, 0, [first], set()
    while True:
        for turn in range(8):
            k = (facing + 5 + turn) % 8  # from just past where it came, clockwise
            to = (at[0] + AROUND[k][0], at[1] + AROUND[k][1])
            if p[to]:
                break
        else:
            break
        if (at, k) in seen:
            break
        seen.add((at, k))
        at, facing = to, k
        path.append(at)
    points = np.array(path)[:, ::-1] - 1
    return points[:-1] if len(points) > 1 and (points[0] == points[-1]).all() else points


def area_of(polygon: np.ndarray) -> float:
    x, y = polygon[:, 0].astype(float), polygon[:, 1].astype(float)
    return abs(float((x * np.roll(y, -1) - y * np.roll(x, -1)).sum())) / 2


def length_of(polygon: np.ndarray) -> float:
    return float(np.hypot(*(np.roll(polygon, -1, 0) - polygon).T).sum()) if len(polygon) else 0.0


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, corners only."""
    order = sorted(set(map(tuple, np.asarray(points).tolist())))
    if len(order) < 3:
        return np.array(order, float).reshape(-1, 2)

    def chain(seq):
        kept: list = []
        for q in seq:
            while len(kept) > 1 and (kept[-1][0] - kept[-2][0]) * (q[1] - kept[-2][1]) <= (kept[-1][1] - kept[-2][1]) * (q[0] - kept[-2][0]):
                kept.pop()
            kept.append(q)
        return kept[:-1]

    return np.array(chain(order) + chain(order[::-1]), float)


def simplify(polygon: np.ndarray, tolerance: float) -> np.ndarray:
    """A closed polygon with only the corners that stand out by more than the tolerance."""
    n = len(polygon)
    if n < 4:
        return polygon
    p = polygon.astype(float)
    a = int(np.hypot(*(p - p.mean(0)).T).argmax())
    p = np.roll(p, -a, 0)
    b = int(np.hypot(*(p - p[0]).T).argmax())
    ring, keep, stack = np.vstack([p, p[:1]]), {0, b}, [(0, b), (b, n)]
    while stack:
        i, j = stack.pop()
        if j - i < 2:
            continue
        base, rest = ring[j] - ring[i], ring[i + 1 : j] - ring[i]
        size = np.hypot(*base)
        far = np.abs(base[0] * rest[:, 1] - base[1] * rest[:, 0]) / size if size else np.hypot(*rest.T)
        k = int(far.argmax())
        if far[k] > tolerance:
            keep.add(i + 1 + k)
            stack += [(i, i + 1 + k), (i + 1 + k, j)]
    return ring[sorted(keep - {n})]


def outlines(ink: np.ndarray) -> list[np.ndarray]:
    """Outer boundaries of all components, the largest enclosed area first (then in row order)."""
    label = label_components(ink)
    found = [outline(label == k) for k in range(1, int(label.max(initial=0)) + 1)]
    return sorted(found, key=lambda p: -area_of(p))


def table_quad(ink: np.ndarray, tolerance: float = 0.02) -> np.ndarray | None:
    """Corners of the largest outline that simplifies to four points; None if there is none."""
    for p in outlines(ink):
        corners = simplify(p, tolerance * length_of(p))
        if len(corners) == 4:
            return order_corners(corners)
    return None


def holes(ink: np.ndarray) -> int:
    """Background areas (side-connected) that the border doesn't reach."""
    free = ~np.pad(ink, 1)
    h, w = free.shape
    label = np.where(free, np.arange(1, h * w + 1).reshape(h, w), 0)
    while True:
        p, big = np.pad(np.where(free, label, h * w + 1), 1, constant_values=h * w + 1), h * w + 1
        low = np.min([p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]], axis=0)
        new = np.where(free, np.minimum(low, big), 0)
        if np.array_equal(new, label):
            return len(np.unique(label[free])) - 1
        label = new


# -- descriptors

OUTLINE = "struct<outlines:int,holes:int,euler:int,area:double,perimeter:double,solidity:double,extent:double,roundness:double>"
HOG = "struct<mean:double,std:double,greatest:double,energy:double,n:int>"
FOURIER = "struct<energy:double,symmetry:double,complexity:double>"


def outline_features(ink: np.ndarray) -> dict:
    """Of all outlines the count, holes and Euler number; of the largest its area, length, share of hull and of box, 4 pi A / P^2."""
    found = outlines(ink)
    gaps = holes(ink)
    area = perimeter = solidity = extent = roundness = 0.0
    if found:
        big = found[0]
        area, perimeter = area_of(big), length_of(big)
        box = float(np.prod(np.ptp(big, axis=0) + 1))
        around = area_of(hull(big)) if len(big) > 2 else 0.0
        solidity, extent = (area / around if around else 0.0), area / box
        roundness = 4 * np.pi * area / perimeter**2 if perimeter else 0.0
    return {"outlines": len(found), "holes": gaps, "euler": len(found) - gaps, "area": area, "perimeter": perimeter, "solidity": solidity, "extent": extent, "roundness": float(roundness)}


def gradients(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Central differences (dx, dy); zero at the edges."""
    dx, dy = np.zeros(image.shape), np.zeros(image.shape)
    dx[:, 1:-1] = image[:, 2:] - image[:, :-2]
    dy[1:-1] = image[2:] - image[:-2]
    return dx, dy


def hog(image: np.ndarray, bins: int = 9, cell: int = 8, block: int = 2, eps: float = 1e-5) -> np.ndarray:
    """Histograms of unsigned gradient directions by cell, normalised (length, cut at 0.2, length again) by block."""
    dx, dy = gradients(image.astype(float))
    size = np.hypot(dx, dy)
    place = np.minimum((np.rad2deg(np.arctan2(dy, dx)) % 180 / (180 / bins)).astype(int), bins - 1)
    rows, cols = image.shape[0] // cell, image.shape[1] // cell
    cells = np.zeros((rows, cols, bins))
    for b in range(bins):
        part = np.where(place == b, size, 0)[: rows * cell, : cols * cell]
        cells[:, :, b] = part.reshape(rows, cell, cols, cell).mean((1, 3)) if part.size else 0
    out = []
    for i in range(rows - block + 1):
        for j in range(cols - block + 1):
            v = cells[i : i + block, j : j + block].ravel()
            v = np.minimum(v / np.sqrt((v * v).sum() + eps * eps), 0.2)
            out.append(v / np.sqrt((v * v).sum() + eps * eps))
    return np.concatenate(out) if out else np.zeros(0)


def hog_features(image: np.ndarray, **kw) -> dict:
    v = hog(image, **kw)
    some = len(v) > 0
    return {"mean": float(v.mean()) if some else 0.0, "std": float(v.std()) if some else 0.0, "greatest": float(v.max()) if some else 0.0, "energy": float((v * v).sum()), "n": len(v)}


def fourier_features(ink: np.ndarray) -> dict:
    """Of the largest outline's spectrum, scaled by its first harmonic: energy, how alike the two ends are, the share of high harmonics."""
    found = outlines(ink)
    none = {"energy": 0.0, "symmetry": 0.0, "complexity": 0.0}
    if not found or len(found[0]) < 4:
        return none
    size = np.abs(np.fft.fft(found[0][:, 0] + 1j * found[0][:, 1]))[1:]
    scale = max(size[0], size[-1])
    if scale <= 0:
        return none
    size = size / scale
    half = len(size) // 2
    ahead, behind = size[:half], size[::-1][:half]
    total = float(size.sum())
    return {"energy": float((size * size).sum()), "symmetry": float(1 - np.abs(ahead - behind).sum() / (ahead + behind).sum()), "complexity": float(size[half // 2 : len(size) - half // 2].sum() / total)}


def high_frequency_share(image: np.ndarray) -> float:
    """Share of the spectrum's size beyond a quarter of the raster's shorter side."""
    spectrum = np.abs(np.fft.fftshift(np.fft.fft2(image)))
    h, w = image.shape
    y, x = np.mgrid[:h, :w]
    far = np.hypot(y - h // 2, x - w // 2) > min(h, w) / 4
    total = spectrum.sum()
    return float(spectrum[far].sum() / total) if total else 0.0
