"""Shape measures of one raster: strokes, spread of its components, edges, straight lines and a fan of binarised variants."""

from __future__ import annotations

import numpy as np

from gridloom.operators.raster import dilate, erode, label_components, line_mask, otsu
from gridloom.operators.vision import adaptive_gaussian, clahe, equalize, holes, resize_area, resize_cubic

STROKES = "struct<upright:int,level:int>"
SPREAD = "struct<n:int,aspect_mean:double,aspect_std:double,aspect_range:double,area_mean:double,area_std:double,eccentricity:double,euler:int,density:double>"
EDGES = "struct<mean:double,std:double,share:double,direction:double>"
LINES = "array<struct<rho:int,degrees:int,votes:int>>"
FAN = "array<struct<name:string,ink:double>>"


def strokes(ink: np.ndarray, length: int = 5) -> dict:
    """How many upright and level strokes of at least ``length`` pixels there are."""
    count = lambda horizontal: int(label_components(line_mask(ink, length, horizontal) > 0).max(initial=0))
    return {"upright": count(False), "level": count(True)}


def eccentricity(x: np.ndarray, y: np.ndarray) -> float:
    """That of the ellipse with the pixels' second moments, a pixel being a unit square; 0 for a disc, towards 1 for a line."""
    moments = np.cov(np.stack([x, y]).astype(float), bias=True) + np.eye(2) / 12
    small, large = np.linalg.eigvalsh(moments)
    return float(np.sqrt(max(0.0, 1 - small / large)))


def spread(ink: np.ndarray, least: int = 1) -> dict:
    """Statistics over the components of at least ``least`` pixels; all zero where there are none."""
    label = label_components(ink)
    places = [np.nonzero(label == k) for k in range(1, int(label.max(initial=0)) + 1)]
    places = [(y, x) for y, x in places if len(x) >= least]
    aspect = np.array([(np.ptp(x) + 1) / (np.ptp(y) + 1) for y, x in places] or [0.0])
    area = np.array([len(x) for _, x in places] or [0.0], float)
    round_off = [eccentricity(x, y) for y, x in places]
    return {
        "n": len(places), "aspect_mean": float(aspect.mean()), "aspect_std": float(aspect.std()), "aspect_range": float(np.ptp(aspect)), "area_mean": float(area.mean()), "area_std": float(area.std()),
        "eccentricity": float(np.mean(round_off)) if places else 0.0, "euler": int(label.max(initial=0)) - holes(ink), "density": float(ink.mean()) if ink.size else 0.0,
    }


def sobel(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sobel's derivatives, with the border repeated."""
    p = np.pad(image.astype(float), 1, mode="edge")
    across, down = p[:, 2:] - p[:, :-2], p[2:] - p[:-2]
    return across[:-2] + 2 * across[1:-1] + across[2:], down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:]


def edge_features(image: np.ndarray) -> dict:
    """Mean and deviation of the edge strength, the share of pixels above its mean, and level against upright change."""
    dx, dy = sobel(image)
    size = np.hypot(dx, dy)
    return {"mean": float(size.mean()), "std": float(size.std()), "share": float((size > size.mean()).mean()), "direction": float(np.abs(dx).sum() / (np.abs(dy).sum() + 1e-9))}


def straight_lines(mask: np.ndarray, votes: int, step: int = 1) -> list[dict]:
    """Hough lines rho = x cos t + y sin t that ``votes`` pixels or more lie on, most first, then by angle and rho.

    Of neighbouring cells of the accumulator only one with no greater, and no equal earlier, neighbour counts."""
    y, x = np.nonzero(mask)
    degrees = np.arange(0, 180, step)
    reach = int(np.ceil(np.hypot(*mask.shape)))
    seen = np.zeros((len(degrees), 2 * reach + 1), np.int64)
    for k, t in enumerate(np.deg2rad(degrees)):
        seen[k] = np.bincount(np.rint(x * np.cos(t) + y * np.sin(t)).astype(np.int64) + reach, minlength=2 * reach + 1)
    p = np.pad(np.concatenate([seen[-1:, ::-1], seen, seen[:1, ::-1]]), ((0, 0), (1, 1)))  # half a turn on, rho changes its sign
    top = seen >= votes
    for a in range(3):
        for b in range(3):
            if (a, b) != (1, 1):
                other = p[a : a + seen.shape[0], b : b + seen.shape[1]]
                top &= seen > other if (a, b) < (1, 1) else seen >= other
    found = sorted((-int(seen[k, r]), int(degrees[k]), int(r) - reach) for k, r in zip(*np.nonzero(top)))
    return [{"rho": r, "degrees": t, "votes": -n} for n, t, r in found]


def fan(grey: np.ndarray, levels: tuple = (200, 220, 240)) -> list[dict]:
    """Binarised variants of a 0..255 raster (dark is ink), each also cleaned by a 2 x 2 opening and closing, with its share of ink."""
    spread_out = equalize(grey)
    made = {"otsu": grey <= otsu(grey), "adaptive": adaptive_gaussian(grey, 11, 2) > 0, **{f"fixed_{v}": grey <= v for v in levels}, "equalized": spread_out <= otsu(spread_out)}

    def cleaned(ink):
        turned = lambda step, a: np.flip(step(np.flip(a), 2, 2))  # the second step reaches the other way, so that nothing moves
        opened = turned(dilate, erode(ink.astype(np.int64), 2, 2))
        return turned(erode, dilate(opened, 2, 2)) > 0

    return [{"name": n + tail, "ink": float(np.mean(x))} for n, ink in made.items() for tail, x in (("", ink), ("_clean", cleaned(ink)))]


INPUTS = "array<struct<name:string,px:array<double>>>"


def model_inputs(grey: np.ndarray, size: tuple) -> list[dict]:
    """What a model may be given of a 0..255 raster, resized and in 0..1: as it is, inverted, binarised, both, and with its
    contrast raised."""
    grey = np.asarray(grey, float)
    turned = 255 - grey
    made = {"simple": grey, "inverted": turned, "thresholded": (grey > otsu(grey)) * 255.0, "inverted_thresholded": (turned > otsu(turned)) * 255.0, "clahe": clahe(grey, 3.0)}
    fit = lambda a: a if a.shape == size else resize_area(a, *size) if a.shape[0] >= size[0] and a.shape[1] >= size[1] else resize_cubic(a, *size).clip(0, 255)
    return [{"name": n, "px": (fit(a) / 255).ravel().tolist()} for n, a in made.items()]
