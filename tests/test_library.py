"""The library's own operators: every query against its SQL, kernels and rules against plain versions and hand-made cases."""

import os
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import keys, signals, tokens
from gridloom.operators import evaluate, joins, raster, runs
from gridloom.plans import catalog
from gridloom.sources import sinks, tables

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not DATA.exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    for p in DATA.iterdir():
        con.execute(f"CREATE VIEW {p.name.split('.')[0]} AS SELECT * FROM '{p if p.is_file() else p / '*.parquet'}'")
    return con


def plain(x):
    if x is None or x != x:
        return None
    if hasattr(x, "item"):
        x = x.item()
    return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_against_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    got = duck.execute(catalog.ORACLE[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted(repr([plain(r[names.index(c)]) for c in order]) for r in got.fetchall())
    assert sorted(repr([plain(r[c]) for c in order]) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_without_sql_runs(spark, name):
    if not DATA.exists():
        pytest.skip("no test tables")
    assert catalog.QUERIES[name](spark, str(DATA)).count() > 0


def test_entry_names_match():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())


NAMES = {
    "cell_r1_c2.png": (1, 2, None, None, None, None), "cell_r1_c2_blob_3.png": (1, 2, "3", None, None, None), "cell_r10_c2_blob_3_blob_4_word_5_char_06.png": (10, 2, "3_4", 5, 6, None),
    "cell_r1_c2_blob_3_word_5_char_00_1.png": (1, 2, "3", 5, 0, 1), "note.png": None, "xcell_r1_c2.png": None,
}


def test_keys(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "name string")
    got = {r["name"]: None if r["k"] is None else tuple(r["k"]) for r in df.select("name", keys.parse_key(F.col("name")).alias("k")).collect()}
    assert got == NAMES


def test_token_rules(spark):
    given = {"+12.5": "number", "1,234": "number", "A1": "other", "ёлка": "word", "Итого:": "word", "12 3": "other", "": "other"}
    df = spark.createDataFrame([(k,) for k in given], "t string")
    assert {r["t"]: r["k"] for r in df.select("t", tokens.token_type(F.col("t")).alias("k")).collect()} == given
    counts = [((0, 0, 0), "none"), ((2, 1, 2), "words"), ((1, 2, 2), "numbers"), ((0, 0, 1), "other"), ((1, 1, 0), "mixed"), ((1, 0, 5), "mixed")]
    df = spark.createDataFrame([(*c, w) for c, w in counts], "w int, n int, o int, want string")
    assert df.where(tokens.dominant(F.col("w"), F.col("n"), F.col("o")) != F.col("want")).count() == 0
    cases = [((0, 0, 0, 0, 0.0, 0), "EMPTY"), ((5, 2, 9, 0, 0.0, 9), "NUMBER"), ((0, 0, 3, 0, 0.0, 3), "TEXT"), ((3, 1, 2, 0, 0.0, 9), "NUMBER"), ((2, 2, 2, 0, 0.0, 9), "TEXT"), ((3, 2, 0, 0, 0.0, 9), "NUMBER"), ((2, 2, 0, 2, 0.0, 9), "NUMBER"), ((1, 1, 0, 0, 0.7, 9), "NUMBER"), ((1, 1, 0, 1, 0.1, 9), "TEXT")]
    df = spark.createDataFrame([(*c, w) for c, w in cases], "a int, b int, c int, d int, e double, n int, want string")
    assert df.where(tokens.cell_type(*(F.col(x) for x in "abcden")) != F.col("want")).count() == 0


def test_runs_at_edges_and_gaps(spark):
    rows = [(1, i, c == "x") for i, c in enumerate("xx.xxx..x....xx")] + [(2, i, False) for i in range(3)] + [(3, i, True) for i in range(4)]
    df = spark.createDataFrame(rows, "k int, pos long, on boolean")
    got = lambda **kw: sorted(map(tuple, runs.runs(df, ["k"], "pos", F.col("on"), **kw).collect()))
    assert got() == [(1, 0, 2), (1, 3, 6), (1, 8, 9), (1, 13, 15), (3, 0, 4)]
    assert got(least=2, merge_gap=2) == [(1, 0, 6), (1, 13, 15), (3, 0, 4)]


def test_run_score(spark):
    def score(text):
        total = run = longest = 0
        for c in text:
            if c == "x":
                run += 1
                longest = max(longest, run)
            else:
                total, run = total + (run or -1), 0
        return total + run, longest

    texts = ["", "x", ".", "xx.x", "..xx", "x..x", "xxx....", ".x.x."]
    df = spark.createDataFrame([(t, [c == "x" for c in t]) for t in texts], "t string, a array<boolean>")
    assert {r["t"]: tuple(r["s"]) for r in df.select("t", signals.run_score(F.col("a")).alias("s")).collect()} == {t: score(t) for t in texts}


def test_band_join_has_every_pair(spark):
    a, b = [(i, 1, i * 0.37) for i in range(40)], [(i, 1, i * 0.53 - 3) for i in range(40)]
    left, right = spark.createDataFrame(a, "i int, k int, x double"), spark.createDataFrame(b, "j int, k int, y double")
    got = {(r["i"], r["j"]) for r in joins.band_join(left, right, ["k"], "x", "y", 0.8).collect()}
    assert got == {(i, j) for i, _, x in a for j, _, y in b if abs(x - y) <= 0.8}


def art(text):
    return np.array([[c == "#" for c in line] for line in text.split()])


def test_components_and_lines():
    ink = art("##..# ..#.# ....# #####")
    found = raster.boxes(ink)
    assert [(b["x"], b["y"], b["w"], b["h"], b["area"]) for b in found] == [(0, 0, 3, 2, 3), (0, 0, 5, 4, 8)]
    assert raster.label_components(np.zeros((3, 3), bool)).max() == 0
    lines = raster.line_mask(art("#.### ..... #####").astype(int), 4)
    assert lines.sum() == 5 and lines[2].all()


def test_threshold_and_resize():
    px = np.array([[10, 10, 200], [12, 210, 205]])
    assert 12 <= raster.otsu(px) < 200
    dark = raster.adaptive_mean(np.array([[9, 9, 9], [9, 1, 9], [9, 9, 9]]), 3, 2)
    assert dark.sum() == 1 and dark[1, 1]
    assert raster.resize_nearest(np.arange(4).reshape(2, 2), 4, 4)[::2, ::2].tolist() == [[0, 1], [2, 3]]


def test_raster_columns(spark):
    a = np.arange(6.0).reshape(2, 3)
    df = spark.createDataFrame([(a.ravel().tolist(),)], "px array<double>")
    px = F.col("px")
    r = df.select(raster.transpose(px, 2, 3).alias("t"), raster.rotate_clockwise(px, 2, 3).alias("r"), raster.crop(px, 3, 1, 0, 2, 2).alias("c"), raster.pad(px, 2, 3, 4, 5, 9.0).alias("p")).first()
    assert r["t"] == a.T.ravel().tolist() and r["r"] == np.rot90(a, -1).ravel().tolist() and r["c"] == a[:2, 1:3].ravel().tolist()
    assert r["p"] == np.pad(a, ((1, 1), (1, 1)), constant_values=9).ravel().tolist()


def test_png_round_trip(spark, tmp_path):
    a = np.arange(12, dtype=np.uint8).reshape(3, 4) * 20
    df = spark.createDataFrame([(a.ravel().tolist(),)], "px array<int>")
    (tmp_path / "cell_r1_c2.png").write_bytes(bytes(sinks.png_bytes(df, 3, 4).first()["png"]))
    (tmp_path / "note.txt").write_text("x")
    r = tables.images(spark, str(tmp_path)).first()
    assert (r["filename"], r["h"], r["w"], bytes(r["data"])) == ("cell_r1_c2.png", 3, 4, a.tobytes())
    assert tables.image_keys(spark, str(tmp_path)).first()["key"]["c"] == 2


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "words.csv").write_text("﻿первый, x\n\n second ,y\nthird\n")
    assert [r["token"] for r in tables.word_list(spark, str(tmp_path / "words.csv")).collect()] == ["первый", "second", "third"]
    (tmp_path / "c.json").write_text('["a",\n "b"]')
    assert sorted(map(tuple, tables.classes(spark, str(tmp_path / "c.json")).collect())) == [(0, "a"), (1, "b")]
    (tmp_path / "k.txt").write_text("a.png, 12\nbad\nb.png, x, y\n")
    assert [tuple(r) for r in tables.pairs(spark, str(tmp_path / "k.txt")).collect()] == [("a.png", "12"), ("b.png", "x, y")]
    (tmp_path / "l.csv").write_text("filename,true_label\na.png, number\n")
    assert tables.checked_labels(spark, str(tmp_path / "l.csv"), "filename string, true_label string", "true_label", ["NUMBER", "OTHER"]).first()["true_label"] == "NUMBER"
    with pytest.raises(Exception, match="out of domain"):
        tables.checked_labels(spark, str(tmp_path / "l.csv"), "filename string, true_label string", "true_label", ["OTHER"]).collect()
    df = spark.createDataFrame([(1, "NUMBER"), (2, "OTHER")], "i int, route string")
    sinks.write_routed(df, str(tmp_path / "routed"), "route")
    assert sorted(p.name for p in (tmp_path / "routed").iterdir() if "=" in p.name) == ["route=NUMBER", "route=OTHER"]
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert tables.csv(spark, str(tmp_path / "csv"), "i int, route string").count() == 2
    sinks.write_report(df, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2


def test_stream_of_dropped_files(spark, tmp_path):
    from gridloom.streaming import drops

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("filename,predicted_class,confidence\ncell_r1_c2_blob_0_word_1_char_00.png,3,0.5\nnot a key,1,0.1\ncell_r1_c2_blob_0_word_1_char_01.png,4,0.7\n")
    q = drops.append_cells(drops.prediction_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_auc_and_scores_without_one_class(spark):
    df = spark.createDataFrame([(1, 5), (1, 3)], "y int, s int")
    assert evaluate.auc(df, "y", "s").first()["auc"] is None
    m = evaluate.confusion(spark.createDataFrame([(0, 0)], "t int, p int"), "t", "p", [0, 1])
    assert {tuple(r) for r in evaluate.class_scores(m, "t", "p").collect()} == {(0, 1.0, 1.0, 1.0, 1), (1, 0.0, 0.0, 0.0, 0)}


@pytest.mark.parametrize("scores", [[0.3, 0.9, 0.9, 0.1, None, float("nan"), float("inf"), float("-inf"), 0.3000001], [5.0, 5.0], [float("nan")], [None, None], [1e300, -1e300, 0.0]])
def test_roc_counts_every_score_above(spark, scores):
    rows = [(k % 2, s) for k, s in enumerate(scores * 3)]
    place = lambda s: (0, 0.0) if s is None else (2, 0.0) if s != s else (1, s)
    got = evaluate.roc(spark.createDataFrame(rows, "y int, s double"), "y", "s").collect()
    assert sorted(place(r["s"]) for r in got) == sorted({place(s) for s in scores})
    for r in got:
        above = [y for y, s in rows if place(s) >= place(r["s"])]
        assert (r["tp"], r["fp"]) == (sum(above), len(above) - sum(above))
