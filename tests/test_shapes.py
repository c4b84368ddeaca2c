"""Shape measures on small rasters whose answers are known."""

import numpy as np
import pytest

from gridloom.operators import shapes


def raster(*rows):
    return np.array([[c == "#" for c in r] for r in rows])


def test_strokes_by_direction():
    ink = raster("#......", "#......", "#..####", "#......", "#......", ".......")
    assert shapes.strokes(ink, 4) == {"upright": 1, "level": 1}
    assert shapes.strokes(ink, 6) == {"upright": 0, "level": 0}


def test_eccentricity_of_line_and_square():
    line, square = np.nonzero(np.ones((1, 30))), np.nonzero(np.ones((4, 4)))
    assert shapes.eccentricity(line[1], line[0]) > 0.99
    assert shapes.eccentricity(square[1], square[0]) == pytest.approx(0, abs=1e-6)


def test_spread_over_components():
    s = shapes.spread(raster("###....", "#.#.##.", "###.##.", ".......", "......#"))
    assert (s["n"], s["euler"], s["aspect_range"]) == (3, 2, 0)
    assert s["area_mean"] == pytest.approx((8 + 4 + 1) / 3)
    assert shapes.spread(raster("###....", "#.#.##.", "###.##.", "......."), 5)["n"] == 1
    none = shapes.spread(np.zeros((3, 3), bool))
    assert none["n"] == 0 and set(none.values()) == {0}


def test_edges_of_a_step():
    up = np.repeat([[0, 0, 9, 9]], 4, axis=0)
    dx, dy = shapes.sobel(up)
    assert not dy.any() and dx[:, 1:3].tolist() == [[36, 36]] * 4
    assert shapes.edge_features(up)["share"] == 0.5
    assert shapes.edge_features(up.T)["direction"] == 0
    assert set(shapes.edge_features(np.full((3, 3), 7)).values()) == {0}


def test_lines_by_votes():
    mask = np.zeros((120, 120), bool)  # long enough for a degree to tell
    mask[4] = True
    mask[:, 11] = True
    found = shapes.straight_lines(mask, 100)
    assert {(x["rho"], x["degrees"]) for x in found} == {(4, 90), (11, 0)}
    assert [x["votes"] for x in found] == [120, 120]
    short = shapes.straight_lines(mask[:20, 5:20], 18)  # its neighbours tie: one of them counts, across the half turn too
    assert len([x for x in short if abs(x["rho"]) == 6]) == 1
    assert shapes.straight_lines(np.zeros((5, 5), bool), 1) == []


def test_fan_of_variants():
    grey = np.full((12, 12), 250.0)
    grey[3:7, 2:8] = 20
    grey[10, 10] = 210
    got = {x["name"]: x["ink"] for x in shapes.fan(grey)}
    assert len(got) == 12
    assert got["fixed_200"] == got["fixed_200_clean"] == got["otsu"] == 24 / 144
    assert (got["fixed_220"], got["fixed_220_clean"]) == (25 / 144, 24 / 144)  # cleaning takes the speck
