"""Queries without SQL against plain versions over their whole table; models, readers and writers on small data."""

import math
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import augment, columns, joins, models, raster, runs, scans, shapes, spectra, vision
from gridloom.plans import catalog
from gridloom.sources import sinks, tables

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def rasters(spark):
    if not DATA.exists():
        pytest.skip("no test tables")
    return {r["vec_id"]: np.array(r["px"]).reshape(8, 8) for r in catalog.glyphs(spark, str(DATA)).collect()}


def answers(spark, name):
    out = defaultdict(list)
    for r in catalog.QUERIES[name](spark, str(DATA)).collect():
        out[r["vec_id"]].append(r.asDict())
    return out


def plain_components(ink):
    """Pixels of each 8-connected component, by a search from each pixel in row order."""
    left = {tuple(p) for p in np.argwhere(ink).tolist()}
    found = []
    for p in sorted(left):
        if p in left:
            todo, part = [p], []
            left.discard(p)
            while todo:
                y, x = todo.pop()
                part.append((y, x))
                for q in [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                    if q in left:
                        left.discard(q)
                        todo.append(q)
            found.append(part)
    return found


def test_components(spark, rasters):
    got = answers(spark, "ink_components")
    for k, a in rasters.items():
        want = []
        for part in plain_components(a > 0.05):
            ys, xs = [y for y, _ in part], [x for _, x in part]
            if len(part) >= 2:
                want.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(part), round(sum(xs) / len(xs), 6), round(sum(ys) / len(ys), 6)))
        assert sorted((r["x"], r["y"], r["w"], r["h"], r["area"], round(r["cx"], 6), round(r["cy"], 6)) for r in got.get(k, [])) == sorted(want)


def plain_strokes(ink, length, level):
    """Components of the pixels that stay when runs shorter than ``length`` go."""
    stay = np.zeros_like(ink)
    rows = ink if level else ink.T
    out = stay if level else stay.T
    for i, row in enumerate(rows):
        start = None
        for j, v in enumerate([*row, False]):
            if v and start is None:
                start = j
            elif not v and start is not None:
                if j - start >= length:
                    out[i, start:j] = True
                start = None
    return stay


def test_strokes(spark, rasters):
    got = answers(spark, "stroke_counts")
    for k, a in rasters.items():
        row = got[k][0]
        for name, level in (("level", True), ("upright", False)):
            kept = plain_strokes(a > 0, 3, level)
            grown = raster.line_mask(a > 0, 3, level) > 0
            assert not (kept & ~grown).any()  # the mask is what stays, grown along the stroke
            assert row[name] == len(plain_components(grown))


def test_spread(spark, rasters):
    got = answers(spark, "component_spread")
    for k, a in rasters.items():
        parts = plain_components(a > 0.05)
        aspect = [(max(x for _, x in p) - min(x for _, x in p) + 1) / (max(y for y, _ in p) - min(y for y, _ in p) + 1) for p in parts] or [0.0]
        area = [len(p) for p in parts] or [0]
        row = got[k][0]
        mean = lambda v: sum(v) / len(v)
        dev = lambda v: math.sqrt(mean([(x - mean(v)) ** 2 for x in v]))
        want = {"n": len(parts), "aspect_mean": mean(aspect), "aspect_std": dev(aspect), "aspect_range": max(aspect) - min(aspect), "area_mean": mean(area), "area_std": dev(area), "density": (a > 0.05).sum() / 64}
        assert all(math.isclose(row[n], v, abs_tol=1e-9) for n, v in want.items())


def plain_sobel(a, border):
    h, w = a.shape

    def at(y, x):
        if border == "reflect":
            y, x = (abs(v) if v < n else 2 * n - 2 - v for v, n in ((y, h), (x, w)))
        else:
            y, x = min(max(y, 0), h - 1), min(max(x, 0), w - 1)
        return float(a[y, x])

    dx, dy = np.zeros((h, w)), np.zeros((h, w))
    for y in range(h):
        for x in range(w):
            dx[y, x] = sum(k * (at(y + i, x + 1) - at(y + i, x - 1)) for i, k in ((-1, 1), (0, 2), (1, 1)))
            dy[y, x] = sum(k * (at(y + 1, x + i) - at(y - 1, x + i)) for i, k in ((-1, 1), (0, 2), (1, 1)))
    return dx, dy


def test_edges(spark, rasters):
    own, dense = answers(spark, "edge_features"), answers(spark, "edge_densities")
    for k, a in list(rasters.items())[::5]:
        dx, dy = plain_sobel(a, "edge")
        size = np.hypot(dx, dy)
        want = {"mean": size.mean(), "std": size.std(), "share": (size > size.mean()).mean(), "direction": np.abs(dx).sum() / (np.abs(dy).sum() + 1e-9)}
        assert all(math.isclose(own[k][0][n], v, rel_tol=1e-9) for n, v in want.items())
        unit = ((a + 0.6) / 1.2).clip(0, 1)
        dx, dy = plain_sobel((unit * 255).astype(np.uint8), "reflect")
        size = np.hypot(dx, dy)
        wave = [[abs(sum(unit[y, x] * np.exp(-2j * np.pi * (u * y + v * x) / 8) for y in range(8) for x in range(8))) for v in range(8)] for u in range(8)]
        want = {"share": (size > size.mean()).mean(), "mean": size.mean(), "std": size.std(), "direction": np.abs(dx).mean() / (np.abs(dy).mean() + 1e-8), "high": sum(sum(r[2:]) for r in wave[2:]) / (sum(map(sum, wave)) + 1e-8)}
        assert all(math.isclose(dense[k][0][n], v, rel_tol=1e-6) for n, v in want.items())
        assert 0 <= dense[k][0]["canny"] <= 1


def test_canny_on_known_rasters():
    step = np.repeat([[0.0] * 6 + [200.0] * 6], 12, axis=0)
    found = spectra.canny(step, 50, 150)
    assert found.sum(0).tolist() == [0] * 5 + [12] + [0] * 6  # one column of the two that are equally steep
    assert not spectra.canny(np.full((9, 9), 7.0), 50, 150).any()
    faint = np.repeat([[0.0] * 6 + [30.0] * 6], 12, axis=0)
    assert not spectra.canny(faint, 50, 150).any()  # weak edges that hang on no strong one
    faint[4:8, 6:] = 200
    assert spectra.canny(faint, 50, 150)[:4].any()  # and such as do


def test_contour_spectrum(spark, rasters):
    got = answers(spark, "contour_fourier")
    some = 0
    for k, a in rasters.items():
        found = vision.outlines(a > 0.02)
        points = [tuple(p) for p in found[0]] if found else []
        n = len(points)
        corners = [p for i, p in enumerate(points) if n < 3 or (points[(i + 1) % n][0] - p[0], points[(i + 1) % n][1] - p[1]) != (p[0] - points[i - 1][0], p[1] - points[i - 1][1])]
        row, n = got[k][0], len(corners)
        if n < 10:
            assert (row["energy"], row["symmetry"], row["complexity"]) == (0, 0, 0)
            continue
        some += 1
        size = [abs(sum((x + 1j * y) * np.exp(-2j * np.pi * f * i / n) for i, (x, y) in enumerate(corners))) for f in range(n)]
        mean = sum(size) / n
        assert math.isclose(row["energy"], sum(s * s for s in size), rel_tol=1e-9) and math.isclose(row["symmetry"], size[1] / (size[0] + 1e-8), rel_tol=1e-9)
        assert math.isclose(row["complexity"], math.sqrt(sum((s - mean) ** 2 for s in size) / n) / (mean + 1e-8), rel_tol=1e-9)
    assert some > 50


def test_hog(spark, rasters):
    got = answers(spark, "hog_descriptors")
    for k, a in list(rasters.items())[::10]:
        cells = np.zeros((2, 2, 9))
        for y in range(8):
            for x in range(8):
                dx = a[y, x + 1] - a[y, x - 1] if 0 < x < 7 else 0.0
                dy = a[y + 1, x] - a[y - 1, x] if 0 < y < 7 else 0.0
                cells[y // 4, x // 4, min(8, int(math.degrees(math.atan2(dy, dx)) % 180 // 20))] += math.hypot(dx, dy) / 16
        v = cells.ravel()
        v = np.minimum(v / math.sqrt((v**2).sum() + 1e-10), 0.2)
        v = v / math.sqrt((v**2).sum() + 1e-10)
        row = got[k][0]
        assert row["n"] == 36 and all(math.isclose(row[n], x, rel_tol=1e-6) for n, x in (("mean", v.mean()), ("std", v.std()), ("greatest", v.max()), ("energy", (v * v).sum())))


def test_filters(spark, rasters):
    got = answers(spark, "filtered_rasters")
    for k, a in list(rasters.items())[::25]:
        grey = (a + 0.6) / 1.2 * 255
        wave = np.abs(np.fft.fftshift([[sum(a[y, x] * np.exp(-2j * np.pi * (u * y + v * x) / 8) for y in range(8) for x in range(8)) for v in range(8)] for u in range(8)]))
        far = sum(wave[y, x] for y in range(8) for x in range(8) if math.hypot(y - 4, x - 4) > 2)
        assert math.isclose(got[k][0]["fine"], far / wave.sum(), rel_tol=1e-6)
        assert grey.min() * 64 <= got[k][0]["kept"] <= grey.max() * 64


def test_outlines_and_lines(spark, rasters):
    got, lines = answers(spark, "outline_descriptors"), answers(spark, "straight_lines")
    for k, a in rasters.items():
        ink = a > 0.05
        parts = plain_components(ink)
        outside, gaps = np.pad(ink, 1), 0
        seen = np.zeros_like(outside)
        for start in np.argwhere(~outside).tolist():  # the background falls into 4-connected parts; all but one are holes
            if not seen[tuple(start)]:
                gaps += 1
                todo = [tuple(start)]
                seen[tuple(start)] = True
                while todo:
                    y, x = todo.pop()
                    for q in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                        if 0 <= q[0] < 10 and 0 <= q[1] < 10 and not outside[q] and not seen[q]:
                            seen[q] = True
                            todo.append(q)
        row = got[k][0]
        assert (row["outlines"], row["holes"], row["euler"]) == (len(parts), gaps - 1, len(parts) - gaps + 1)
        for r in lines.get(k, []):  # each line has the votes of the pixels that lie on it
            t = math.radians(r["degrees"])
            assert r["votes"] == sum(round(x * math.cos(t) + y * math.sin(t)) == r["rho"] for y, x in np.argwhere(ink).tolist()) >= 5


def test_fan_and_variants(spark, rasters):
    got = answers(spark, "variant_fan")
    for k, a in list(rasters.items())[::10]:
        grey = ((a + 0.6) / 1.2 * 255).clip(0, 255).round()
        ink = {r["name"]: r["ink"] for r in got[k]}
        assert all(math.isclose(ink[f"fixed_{level}"], (grey <= level).mean()) for level in (200, 220, 240)) and len(ink) == 12
    again = answers(spark, "augmented_rasters")
    assert {k: str(v) for k, v in again.items()} == {k: str(v) for k, v in answers(spark, "augmented_rasters").items()} and set(again) == set(rasters)


def test_model_inputs(spark, rasters):
    got = answers(spark, "model_input_fan")
    for k, a in list(rasters.items())[::10]:
        g = ((a + 0.6) / 1.2 * 255).clip(0, 255).round()
        mean = {r["name"]: r["mean"] for r in got[k]}
        assert len(mean) == 5 and math.isclose(mean["simple"], g.mean() / 255, abs_tol=1e-6) and math.isclose(mean["inverted"], 1 - g.mean() / 255, abs_tol=1e-6)
        assert math.isclose(mean["thresholded"], (g > raster.otsu(g)).mean(), abs_tol=1e-6)
    flat = np.full((16, 16), 90.0)
    assert len(np.unique(vision.clahe(flat, 3.0, (2, 2)))) == 1
    steps = np.repeat(np.arange(100, 116, dtype=float)[None], 16, axis=0)
    raised = vision.clahe(steps, 40.0, (1, 1))  # one tile that nothing is cut of: the plain equalisation
    assert raised[0].tolist() == [round((k + 1) * 16 * 255 / 256) for k in range(16)] and np.ptp(vision.clahe(steps, 3.0, (2, 2))) > np.ptp(steps)


def test_samples_are_drawn_alike(spark):
    rng = lambda: np.random.default_rng(3)
    wide = augment.to_height(np.zeros((4, 6)), rng(), 8, 40)
    assert wide.shape == (8, 40) and (wide == 0).sum() == 8 * 12 and (wide == 255).sum() == 8 * 28
    assert augment.to_height(np.zeros((4, 90)), rng(), 8, 40).shape == (8, 40)
    for kind in ("gaussian", "salt_pepper", "blur"):
        a = augment.noise_patch(kind, 20, rng())
        assert a.shape == (20, 20) and a.min() >= 0 and a.max() <= 255 and np.array_equal(a, augment.noise_patch(kind, 20, rng()))
    with pytest.raises(ValueError):
        augment.noise_patch("silence", 4, rng())
    words = augment.vocabulary(["a", "b", ".5", "a"], ["c", "1."])
    assert words[:10] == [f".{k}" for k in range(10)] and words[-3:] == ["a", "b", "c"] and len(words) == len(set(words)) == 43
    one, two = (sorted(map(tuple, augment.class_tokens(spark, ["x", "yz"], 50).repartition(n).collect())) for n in (1, 5))
    assert one == two and len(one) == 150


def test_projection_peaks(spark, rasters):
    def plain(v, height, distance):
        if max(v) < 10:
            return 0
        v = [x / max(v) for x in v]
        found = [(v[i], i) for i in range(1, 7) if v[i - 1] < v[i] > v[i + 1] and v[i] >= height]  # no two sums are equal here
        kept = []
        for _, i in sorted(found, reverse=True):
            if all(abs(i - j) >= distance for j in kept):
                kept.append(i)
        return len(kept)

    got = answers(spark, "projection_peaks")
    for k, a in rasters.items():
        ink = (a > 0.1) * ((a + 0.6) / 1.2 * 255).clip(0, 255).round()
        if min(np.diff(np.sort(ink.sum(0))).min(), np.diff(np.sort(ink.sum(1))).min()) > 0:
            assert (got[k][0]["columns"], got[k][0]["rows"]) == (plain(ink.sum(0).tolist(), 0.2, 3), plain(ink.sum(1).tolist(), 0.2, 2))
    assert scans.peaks(np.array([0, 3, 3, 3, 0, 2, 0, 1]), 1, 1).tolist() == [2, 5]  # a plateau's middle; the last value is no peak
    assert scans.peaks(np.array([0, 5, 0, 4, 0, 3, 0]), 1, 3).tolist() == [1, 5]


def test_border_scan(spark, rasters):
    def plain(line, white):
        """Whether a line belongs to the border, pixel by pixel, given the white pixels so far."""
        n, run, score, longest = len(line), 0, 0, 0
        for v in line:
            white += v >= 230
            if v < 30:
                run += 1
            elif run:
                score, longest, run = score + run, max(longest, run), 0
            else:
                score -= 1
        score, longest = score + run, max(longest, run)
        mean = sum(line) / n
        return 100 * white / n < 10 or mean < 125 or score > 0.75 * n or 100 * longest / n >= 25 or (mean < 210 and score > 0.4 * n), white

    got = answers(spark, "border_scan")
    for k, a in rasters.items():
        image = (((a + 0.6) / 1.2 * 255).clip(0, 255).round() * (a > -0.1)).tolist()
        want = []
        for side in range(4):  # turning the raster to the left brings the next side to the top
            most, last, white, i = min(len(image), len(image[0]) if image else 0) - 1, -1, 0, 0
            limit = min(3, most)
            while i < limit:
                dark, white = plain(image[i], white)
                if dark:
                    last, limit = i, min(limit + 3, most)
                i += 1
            want.append(last)
            image = [list(r) for r in zip(*image[last + 1 :])][::-1] if last + 1 < len(image) else []
            if not image:
                want += [-1] * (3 - side)
                break
        row = got[k][0]
        assert [row[n] for n in ("top", "right", "bottom", "left")] == want
    edged = np.full((30, 30), 255.0)
    edged[:2], edged[:, -1] = 0, 0
    assert scans.borders(edged) == {"top": 1, "right": 0, "bottom": -1, "left": -1}


@pytest.mark.parametrize("name", ["logistic_regression", "random_forest"])
def test_models_beat_the_commonest_class(spark, name):
    rows = [(r["label"], r["prediction"]) for r in catalog.QUERIES[name](spark, str(DATA)).collect()]
    commonest = max(sum(a == c for a, _ in rows) for c in range(10))
    assert sum(a == b for a, b in rows) > 1.5 * commonest


# -- models


def glyph_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "abc"[i % 3], (np.eye(3)[i % 3].repeat(4) + rng.normal(0, 0.2, 12)).tolist()) for i in range(240)]
    return spark.createDataFrame(rows, "id long, label string, px array<double>")


def test_a_model_s_life(spark, tmp_path):
    df = models.with_features(glyph_rows(spark))
    model = models.pipeline("forest", ["a", "b", "c"], numTrees=10).fit(df)
    models.save(model, str(tmp_path / "m"))
    again = models.scored(df, models.load(str(tmp_path / "m"))).collect()
    assert sorted(map(str, again)) == sorted(map(str, models.scored(df, model).collect()))
    assert sum(r["label"] == r["predicted"] for r in again) > 230
    weights = models.importances(model.stages[2], [f"p{k}" for k in range(12)]).collect()
    assert math.isclose(sum(r["weight"] for r in weights), 1, rel_tol=1e-6) and weights[0]["weight"] == max(r["weight"] for r in weights)
    plain = models.pipeline("logistic", ["a", "b", "c"], maxIter=20).fit(df)
    assert len(models.importances(plain.stages[2], [f"p{k}" for k in range(12)]).collect()) == 12
    with pytest.raises(ValueError):
        models.classifier("oracle")


def test_cross_validation_by_folds(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StringIndexer

    df = models.with_features(columns.folds(glyph_rows(spark), "label", ["id"], 3)).withColumn("fold", F.col("fold").cast("int"))
    df = StringIndexer(inputCol="label", outputCol="code").fit(df).transform(df).withColumn("scaled", F.col("features"))
    assert models.cross_validated(df, Pipeline(stages=[models.classifier("logistic", maxIter=20)]), "fold", 3) > 0.9


def test_batches_and_error_rows(spark):
    rng = np.random.default_rng(2)
    layers = [(rng.normal(size=(4, 5)), rng.normal(size=5), "relu"), (rng.normal(size=(5, 3)), rng.normal(size=3), "softmax")]
    rows = [(i, rng.normal(size=4).tolist()) for i in range(50)] + [(50, None), (51, [1.0]), (52, [1.0, float("nan"), 0.0, 0.0]), (53, [1.0, None, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, px array<double>")
    for batch in (1, 7, 1024):
        got = {r["id"]: r for r in models.scored_batches(df, layers, "px", 4, batch).collect()}
        for i, v in rows[:50]:
            h = [max(0.0, sum(v[a] * layers[0][0][a][b] for a in range(4)) + layers[0][1][b]) for b in range(5)]
            z = [sum(h[a] * layers[1][0][a][b] for a in range(5)) + layers[1][1][b] for b in range(3)]
            p = [math.exp(x) / sum(map(math.exp, z)) for x in z]
            assert got[i]["predicted"] == p.index(max(p)) and math.isclose(got[i]["confidence"], max(p), rel_tol=1e-9) and got[i]["error"] is None
        assert [(got[i]["predicted"], got[i]["confidence"], got[i]["error"]) for i in (50, 51, 52, 53)] == [(None, 0.0, "no raster"), (None, 0.0, "1 values"), (None, 0.0, "not finite"), (None, 0.0, "not finite")]
    names = spark.createDataFrame([("zero", 0), ("one", 1)], "class string, id int")
    assert [r[0] for r in spark.range(3).select(models.decoded(F.col("id").cast("int"), names)).collect()] == ["zero", "one", None]


# -- columns, runs, joins


def test_runs_against_loops(spark):
    """Runs with their shifts and merges, as a loop over the signal finds them."""

    def plain(v, rows):
        top, n = max(v), len(v)
        v = [x / top for x in v] if (top < 1 if rows else top > 1) else v
        on = [x < 0.9 if rows else x > 0.3 for x in v]
        found, start = [], None
        for i, x in enumerate([*on, False]):
            if x and start is None:
                start = i - 1 if rows and i > 2 else i
            elif not x and start is not None:
                found.append([start, min(i + 1, n) if rows else i])
                start = None
        out = []
        for s, e in (r for r in found if r[1] - r[0] >= (2 if rows else 3)):
            if out and s - out[-1][1] < 1:
                out[-1][1] = e
            else:
                out.append([s, e])
        return [tuple(r) for r in out]

    rng = np.random.default_rng(4)
    signals = {k: np.round(rng.choice([0.1, 0.5, 0.95, 1.0], int(rng.integers(1, 40))) * (1 + (k % 3) / 2 if k % 2 else 0.9), 6).tolist() for k in range(60)}
    df = spark.createDataFrame([(k, i, x) for k, v in signals.items() for i, x in enumerate(v)], "k long, i long, value double")
    for rows, found in ((True, runs.row_runs(df, ["k"], "i")), (False, runs.column_runs(df, ["k"], "i", 0.3))):
        got = defaultdict(list)
        for r in found.collect():
            got[r["k"]].append((r["s"], r["e"]))
        assert all(sorted(got[k]) == plain(v, rows) for k, v in signals.items())


def test_same_line_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), int(i) % 4, *map(int, rng.integers(0, 120, 2)), int(rng.integers(0, 12)), int(rng.integers(0, 30))) for i in range(160)]
    df = spark.createDataFrame(rows, "id long, k long, x long, y long, w long, h long")
    median = {k: float(np.median([r[4] for r in rows if r[1] == k])) for k in range(4)}
    want = set()
    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[1] == b[1]:
                inter, least = max(0, min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3])), min(a[5], b[5])
                gap = b[2] - a[2] - a[4] if a[2] <= b[2] else a[2] - b[2] - b[4]
                if least > 0 and inter / least >= 0.45 and gap <= 1.5 * (median[a[1]] if median[a[1]] >= 1 else 10):
                    want.add((a[0], b[0]))
    for bucket in (5.0, 64.0):
        pairs = joins.same_line(df, "k", "id", bucket)
        assert sorted((r["a"], r["b"]) for r in pairs.collect()) == sorted(want)
    label = {r[0]: r[0] for r in rows}
    while any(label[a] != label[b] for a, b in want):
        for a, b in want:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["id"]: r["component"] for r in joins.group_components(df, pairs, "k", "id").collect()}
    assert got == label


def test_columns(spark):
    df = spark.createDataFrame([(1, "x", 2.0, 5.0), (2, "y", float("nan"), 5.0), (3, "z", None, 5.0 + 1e-9)], "a int, b string, c double, d double")
    assert columns.numeric(df).columns == ["a", "c", "d"] and columns.without(df, "b", "nothing").columns == ["a", "c", "d"]
    assert columns.varying(columns.finite(columns.numeric(df), ["c"])).columns == ["a", "c"]
    assert [tuple(r) for r in columns.one_hot(df.select("a", "b"), "b", "is").orderBy("a").collect()] == [(1, 0, 0), (2, 1, 0), (3, 0, 1)]
    many = spark.range(300).select((F.col("id") % 17).cast("double").alias("u"), ((F.col("id") * 7) % 23).cast("double").alias("v"))
    p = many.toPandas()
    assert math.isclose(columns.correlations(many, ["u", "v"], ranks=True).first()["r"], p["u"].rank().corr(p["v"].rank()), abs_tol=1e-9)


# -- readers and writers


def test_images_from_files_to_pixels(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(f"cell_r{i}_c{i % 2}.png", rng.integers(0, 256, 48).astype(float).tolist()) for i in range(4)]
    folder = str(tmp_path / "png")
    sinks.write_pngs(spark.createDataFrame(rows, "filename string, px array<double>"), folder, 6, 8)
    got = {r["filename"]: r for r in tables.pixels(spark, folder, unit=False).collect()}
    assert {k: (r["h"], r["w"], r["px"]) for k, r in got.items()} == {n: (6, 8, v) for n, v in rows}
    half = {r["filename"]: r["px"] for r in tables.pixels(spark, folder, (3, 4)).collect()}
    for name, v in rows:
        want = np.array(v).reshape(3, 2, 4, 2).mean((1, 3)) / 255
        assert np.allclose(np.array(half[name]).reshape(3, 4), want)
    assert [r["filename"] for r in tables.sorted_images(spark, folder).collect()] == sorted(n for n, _ in rows)
    assert sorted(map(tuple, tables.image_cells(spark, folder).collect())) == [(0, 0), (1, 1), (2, 0), (3, 1)]


def test_tables_written_and_read(spark, tmp_path):
    df = spark.createDataFrame([("r1", "a", "1"), ("r1", "b", "2"), ("r2", "a", "3")], "r string, c string, v string")
    at = lambda n: str(tmp_path / n)
    sinks.write_pivoted(df, at("wide"), "r", "c", "v")
    assert sorted(map(tuple, tables.indexed_csv(spark, at("wide"), "a string, b string").collect())) == [("r1", "1", "2"), ("r2", "3", None)]
    sinks.append_csv(df, at("log"))
    sinks.append_csv(df, at("log"))
    assert spark.read.option("header", True).csv(at("log")).count() == 6
    sinks.rewrite(spark, at("log"), lambda x: x.where("c = 'a'").orderBy("v"))
    assert sorted(r["v"] for r in spark.read.option("header", True).csv(at("log")).collect()) == ["1", "1", "3", "3"]
    sinks.write_text_report(df, at("report"), "%s in %s: %s", ["v", "r", "c"])
    assert sorted(r["value"] for r in spark.read.text(at("report")).collect()) == ["1 in r1: a", "2 in r1: b", "3 in r2: a"]
    corners = spark.sql("select 1 as row, 2 as col, named_struct('x', 3, 'y', 4) as top_left, named_struct('x', 5, 'y', 6) as bottom_right")
    sinks.write_coordinates(corners, at("cells"))
    assert spark.read.option("header", True).csv(at("cells")).first().asDict() == {"row": "1", "col": "2", "x1": "3", "y1": "4", "x2": "5", "y2": "6"}
    assert tables.same_columns(df, df.drop("v")) == {"same": False, "first": ["v"], "second": []}


def test_shapes_module_is_what_queries_use():
    assert shapes.edge_features(np.zeros((3, 3)))["mean"] == 0
