"""Image kernels against hand-made rasters and plain definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import augment, vision


def art(text):
    return np.array([[c == "#" for c in line] for line in text.split()])


BLOCK = art("........ .######. .######. .######. .######. ........")
RING = art("......... .#######. .#.....#. .#.....#. .#######. .........")


def test_corners_and_warp():
    quad = np.array([[9, 1], [1, 0], [0, 8], [8, 9]])
    assert vision.order_corners(quad).tolist() == [[1, 0], [9, 1], [8, 9], [0, 8]]
    image = np.arange(48.0).reshape(6, 8)
    straight = vision.warp(image, [[1, 1], [6, 1], [6, 4], [1, 4]], 4, 6)
    assert straight.tolist() == image[1:5, 1:7].tolist()
    assert vision.warp(image, [[-9, -9], [20, -9], [20, 20], [-9, 20]], 4, 4)[0, 0] == 255
    m = vision.homography(quad, quad * 2 + 1)
    u, v, s = m @ np.array([9, 1, 1])
    assert (u / s, v / s) == pytest.approx((19, 3))


def test_resizes_keep_flat_rasters_and_means():
    a = np.random.default_rng(1).random((6, 9))
    assert vision.resize_area(a, 3, 3) == pytest.approx(a.reshape(3, 2, 3, 3).mean((1, 3)))
    assert vision.resize_area(a, 4, 5).mean() == pytest.approx(a.mean())
    assert vision.resize_cubic(np.full((3, 4), 7.0), 8, 9) == pytest.approx(np.full((8, 9), 7.0))
    assert vision.resize_cubic(a, 6, 9) == pytest.approx(a)


def test_filters():
    step = np.repeat([[0.0] * 6 + [200.0] * 6], 12, 0)
    kept, smooth = vision.bilateral(step, 5, 20, 20), vision.blur(step, 5)
    assert abs(kept - step).max() < 1e-3 < abs(smooth - step).max()
    assert vision.gaussian(5).sum() == pytest.approx(1)
    dot = np.full((9, 9), 200.0)
    dot[4, 4] = 0
    assert np.argwhere(vision.adaptive_gaussian(dot, 5, 10)).tolist() == [[4, 4]]
    assert vision.equalize(np.array([[10, 10], [11, 12]])).tolist() == [[0, 0], [128, 255]]
    assert vision.equalize(np.full((2, 2), 9)).tolist() == [[9, 9], [9, 9]]


@pytest.mark.parametrize("length", [2, 3, 4])
def test_close_gaps(length):
    row = art("#.#..#...#....#")
    got = vision.close_gaps(row, length)[0]
    want, marked = row[0].copy(), np.flatnonzero(row[0])
    for a, b in zip(marked, marked[1:]):
        if b - a - 1 < length:
            want[a:b] = True
    assert got.tolist() == want.tolist()
    assert (vision.close_gaps(row.T, length, False)[:, 0] == want).all()


def test_lines_and_dark_borders():
    mask = np.zeros((30, 30))
    mask[10, :] = 255
    assert vision.line_between(mask, (2, 11), (27, 11)) and not vision.line_between(mask, (2, 20), (27, 20))
    assert vision.line_between(mask.T, (11, 2), (11, 27))
    framed = np.full((6, 6), 200.0)
    framed[0] = framed[:, 0] = framed[:, -1] = 0
    assert vision.drop_dark_lines(framed).shape == (5, 4)
    assert vision.drop_dark_lines(np.zeros((3, 3))).size == 0


def test_outlines():
    p = vision.outline(BLOCK)
    assert len(p) == 16 and vision.area_of(p) == 15 and vision.length_of(p) == 16
    assert vision.hull(p).tolist() == [[1, 1], [6, 1], [6, 4], [1, 4]]
    assert vision.table_quad(RING).tolist() == [[1, 1], [7, 1], [7, 4], [1, 4]]
    assert vision.table_quad(np.zeros((3, 3), bool)) is None
    assert vision.outline(art("...  .#. ...")).tolist() == [[1, 1]]
    line = vision.outline(art("..... .###. ....."))
    assert set(map(tuple, line.tolist())) == {(1, 1), (2, 1), (3, 1)} and vision.area_of(line) == 0
    assert [vision.holes(x) for x in (BLOCK, RING, art("##### #.#.# #####"), art("#.# .#. #.#"))] == [0, 1, 2, 0]


def test_descriptors():
    f = vision.outline_features(RING)
    assert (f["outlines"], f["holes"], f["euler"], f["area"], f["perimeter"], f["solidity"]) == (1, 1, 0, 18.0, 18.0, 1.0)
    assert vision.outline_features(np.zeros((4, 4), bool))["outlines"] == 0
    ramp = np.repeat([np.arange(16.0)], 16, 0)
    v = vision.hog(ramp)
    assert len(v) == 36 and (v.reshape(4, 9)[:, 1:] == 0).all() and (v @ v) == pytest.approx(1, abs=1e-3)
    assert len(vision.hog(np.zeros((4, 4)))) == 0 and vision.hog_features(np.zeros((16, 16)))["energy"] == 0
    square, thin = vision.fourier_features(BLOCK), vision.fourier_features(RING)
    assert 0 <= square["complexity"] < 1 and square["energy"] >= 1 and thin["symmetry"] <= 1
    y, x = np.mgrid[:40, :40]
    disc = (x - 20) ** 2 + (y - 20) ** 2 <= 225
    assert vision.fourier_features(disc)["complexity"] < square["complexity"]
    assert vision.high_frequency_share(np.ones((8, 8))) == pytest.approx(0) and vision.high_frequency_share(np.indices((8, 8)).sum(0) % 2 - 0.5) == pytest.approx(1)


def test_kernel_column_takes_nulls(spark):
    ring = [float(v) for v in RING.ravel()]
    df = spark.createDataFrame([(1, ring), (2, None), (3, [1.0])], "id int, px array<double>")
    kernel = vision.kernel_column(F.col("px"), *RING.shape, vision.OUTLINE, lambda a: vision.outline_features(a > 0.5))
    got = {r["id"]: r["f"] for r in df.select("id", kernel.alias("f")).collect()}
    assert got[1]["holes"] == 1 and got[2]["holes"] is None and got[3]["area"] is None


def test_variants_agree_on_reruns(spark):
    a = np.full((12, 10), 255.0)
    a[3:9, 4:6] = 0
    for name, step in augment.STEPS.items():
        out = step(a, np.random.default_rng(3))
        assert out.shape == a.shape and np.isfinite(out).all(), name
    df = spark.createDataFrame([(1, 7, a.ravel().tolist()), (2, 7, a.ravel().tolist()), (3, 7, None)], "id long, label int, px array<double>")
    made = augment.variants(df, "id", 12, 10, 3)
    rows = sorted(map(tuple, made.collect()))
    assert [(r[0], r[2]) for r in rows] == [(i, c) for i in (1, 2) for c in (1, 2, 3)]
    assert rows == sorted(map(tuple, made.repartition(3).collect()))
    assert all(len(r[3]) == 3 and len(r[4]) == 120 and 0 <= min(r[4]) <= max(r[4]) <= 255 for r in rows)
    assert len({tuple(r[4]) for r in rows}) > 3
