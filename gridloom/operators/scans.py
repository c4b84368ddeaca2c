"""Scans of profiles and borders: peaks that stand apart, dark borders by side."""

from __future__ import annotations

import numpy as np

PEAKS = "struct<columns:int,rows:int>"
BORDERS = "struct<top:int,right:int,bottom:int,left:int>"
# The border rule's limits (greys of 0 to 255, shares of a line).
DARK, WHITE, BLACK_MEAN, GREY_MEAN = 30, 230, 125, 210
MOST_DARK, SOME_DARK, LONG_RUN, FEW_WHITE, AHEAD = 0.75, 0.4, 25, 10, 3


def peaks(profile: np.ndarray, height: float, distance: int) -> np.ndarray:
    """Local maxima (the middle of a plateau) of at least ``height``; of two nearer than ``distance`` the higher stays, the
    later one among equals."""
    edges = np.concatenate([[0], np.flatnonzero(np.diff(profile)) + 1, [len(profile)]])
    levels = profile[edges[:-1]]
    top = [k for k in range(1, len(levels) - 1) if levels[k - 1] < levels[k] > levels[k + 1] and levels[k] >= height]
    at = np.array([(edges[k] + edges[k + 1] - 1) // 2 for k in top], int)
    kept: list = []
    for k in sorted(range(len(at)), key=lambda k: (-profile[at[k]], -k)):
        if all(abs(int(at[k]) - p) >= distance for p in kept):
            kept.append(int(at[k]))
    return np.array(sorted(kept), int)


def projection_peaks(ink: np.ndarray) -> dict:
    """Peaks of the column sums (3 apart) and row sums (2 apart), each over its maximum; none where that is below 10."""
    out = {}
    for name, axis, distance in (("columns", 0, 3), ("rows", 1, 2)):
        total = ink.sum(axis)
        out[name] = len(peaks(total / total.max(), 0.2, distance)) if total.max() >= 10 else 0
    return out


def dark_lines(lines: np.ndarray, most: int) -> int:
    """The last of the outermost lines (rows of ``lines``) that belongs to a dark border, or -1.

    Three lines are looked at, and three more beyond each that belongs to it, ``most`` at most. White pixels are counted over
    all lines so far, as the rule has it."""
    n = lines.shape[1]
    last, limit, white, i = -1, min(AHEAD, most), 0, 0
    while i < limit:
        line = lines[i]
        white += int((line >= WHITE).sum())
        edge = np.diff(np.concatenate([[0], (line < DARK).astype(int), [0]]))
        runs = np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)
        ends = int((np.flatnonzero(edge == -1) < n).sum())  # a light pixel that ends a run takes nothing away
        score = int(runs.sum()) - (n - int(runs.sum()) - ends)
        longest = 100 * int(runs.max(initial=0)) / n
        mean = line.sum() / n
        black = mean < BLACK_MEAN or score > MOST_DARK * n or longest >= LONG_RUN
        if 100 * white / n < FEW_WHITE or black or (mean < GREY_MEAN and score > SOME_DARK * n):
            last = i
            limit = min(limit + AHEAD, most)
        i += 1
    return last


def borders(grey: np.ndarray) -> dict:
    """The dark border of each side, which is cut off before the next is looked at: top, right, bottom, left."""
    found = {}
    for side in ("top", "right", "bottom", "left"):
        turned = {"top": grey, "right": grey[:, ::-1].T, "bottom": grey[::-1], "left": grey.T}[side]
        k = found[side] = dark_lines(turned, min(grey.shape) - 1) if grey.size else -1
        if k >= 0:
            grey = {"top": grey[k + 1 :], "right": grey[:, : grey.shape[1] - k - 1], "bottom": grey[: grey.shape[0] - k - 1], "left": grey[:, k + 1 :]}[side]
    return found
