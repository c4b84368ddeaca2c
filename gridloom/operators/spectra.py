"""Edges by Canny and Sobel with their densities, and Fourier descriptors of the largest contour."""

from __future__ import annotations

import numpy as np

from gridloom.operators.vision import outlines

EDGE_DENSITY = "struct<canny:double,share:double,mean:double,std:double,direction:double,high:double>"
CONTOUR = "struct<energy:double,symmetry:double,complexity:double>"


def sobel_reflected(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sobel's derivatives; beyond the border the raster is mirrored about its outermost pixels."""
    p = np.pad(image.astype(float), 1, mode="reflect")
    across, down = p[:, 2:] - p[:, :-2], p[2:] - p[:-2]
    return across[:-2] + 2 * across[1:-1] + across[2:], down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:]


def canny(image: np.ndarray, low: float, high: float) -> np.ndarray:
    """Edges: ridges of |dx| + |dy| above ``low`` that hang together (8 ways) with one above ``high``."""
    p = np.pad(image.astype(float), 1, mode="edge")
    across, down = p[:, 2:] - p[:, :-2], p[2:] - p[:-2]
    dx, dy = across[:-2] + 2 * across[1:-1] + across[2:], down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:]
    size = np.abs(dx) + np.abs(dy)
    m = np.pad(size, 1)
    at = lambda i, j: m[1 + i : 1 + i + size.shape[0], 1 + j : 1 + j + size.shape[1]]
    steep, flat = np.abs(dy) > np.abs(dx) * np.tan(np.deg2rad(67.5)), np.abs(dy) < np.abs(dx) * np.tan(np.deg2rad(22.5))
    rising = (dx < 0) ^ (dy < 0)
    ridge = np.where(flat, (size > at(0, -1)) & (size >= at(0, 1)), np.where(steep, (size > at(-1, 0)) & (size >= at(1, 0)), np.where(rising, (size > at(-1, 1)) & (size > at(1, -1)), (size > at(-1, -1)) & (size > at(1, 1)))))
    weak = ridge & (size > low)
    found = weak & (size > high)
    while True:
        q = np.pad(found, 1)
        near = np.zeros_like(found)
        for i in range(3):
            for j in range(3):
                near |= q[i : i + found.shape[0], j : j + found.shape[1]]
        more = near & weak
        if (more == found).all():
            return found
        found = more


def edge_density(image: np.ndarray) -> dict:
    """Of a raster in 0..1: the share of Canny edges, of pixels whose Sobel strength is above its mean, that mean and
    deviation, level against upright change, and the share of the spectrum past a quarter of each axis."""
    grey = (image * 255).astype(np.uint8)
    dx, dy = sobel_reflected(grey)
    size = np.hypot(dx, dy)
    spectrum = np.abs(np.fft.fft2(image))
    h, w = spectrum.shape
    return {
        "canny": float(canny(grey, 50, 150).mean()), "share": float((size > size.mean()).mean()), "mean": float(size.mean()), "std": float(size.std()),
        "direction": float(np.abs(dx).mean() / (np.abs(dy).mean() + 1e-8)), "high": float(spectrum[h // 4 :, w // 4 :].sum() / (spectrum.sum() + 1e-8)),
    }


def corners_of(contour: np.ndarray) -> np.ndarray:
    """The points of a closed boundary at which its direction changes."""
    if len(contour) < 3:
        return contour
    ahead, behind = np.roll(contour, -1, axis=0) - contour, contour - np.roll(contour, 1, axis=0)
    return contour[(ahead != behind).any(1)]


def contour_spectrum(ink: np.ndarray) -> dict:
    """Of the largest contour's corners as complex numbers: energy of the spectrum, |F1| / |F0|, deviation over mean; all 0
    below 10 corners."""
    found = outlines(ink)
    points = corners_of(found[0]) if found else np.zeros((0, 2))
    if len(points) < 10:
        return {"energy": 0.0, "symmetry": 0.0, "complexity": 0.0}
    size = np.abs(np.fft.fft(points[:, 0] + 1j * points[:, 1]))
    return {"energy": float((size**2).sum()), "symmetry": float(size[1] / (size[0] + 1e-8)), "complexity": float(size.std() / (size.mean() + 1e-8))}
