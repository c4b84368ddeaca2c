"""Queries of scans, of rows below a cell, of resampled profiles, and of measures over a whole set of images."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridloom.functions import signals, tokens
from gridloom.operators import augment, joins, scans, shapes, vision
from gridloom.plans import exact
from gridloom.plans.catalog import ORACLE, PX, QUERIES, glyphs, query, r6, t


def grey(a):
    return ((a + 0.6) / 1.2 * 255).clip(0, 255).round()


@query()
def projection_peaks(spark, d):
    """Peaks of the row and column sums of the ink (tested against plain loops over the table)."""
    run = lambda a: scans.projection_peaks((a > 0.1) * grey(a))
    return glyphs(spark, d).select("vec_id", vision.kernel_column(F.col("px"), 8, 8, scans.PEAKS, run).alias("f")).select("vec_id", "f.*")


@query()
def border_scan(spark, d):
    """Dark borders of each side, with the darkest pixels made black (tested against plain loops over the table)."""
    run = lambda a: scans.borders(grey(a) * (a > -0.1))
    return glyphs(spark, d).select("vec_id", vision.kernel_column(F.col("px"), 8, 8, scans.BORDERS, run).alias("f")).select("vec_id", "f.*")


@query("""WITH nd AS (SELECT c_custkey, c_nationkey AS img, CAST(floor(c_acctbal / 1000) AS BIGINT) AS r, CAST(c_custkey % 300 AS DOUBLE) AS x FROM customer),
p AS (SELECT a.c_custkey, min(b.r) AS below FROM nd a JOIN nd b ON b.img = a.img AND b.r > a.r AND abs(b.x - a.x) <= 8 WHERE EXISTS (SELECT 1 FROM nd c WHERE c.img = a.img AND c.r = b.r AND abs(c.x - (a.x + 40)) <= 8) GROUP BY a.c_custkey)
SELECT nd.c_custkey, below FROM nd LEFT JOIN p ON p.c_custkey = nd.c_custkey""")
def row_below_both(spark, d):
    """The first row below a cell that has nodes under both of its corners."""
    n = t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("img"), F.floor(F.col("c_acctbal") / 1000).alias("r"), (F.col("c_custkey") % 300).cast("double").alias("x"))
    cells = n.select("img", "c_custkey", "r", F.col("x").alias("x1"), (F.col("x") + 40).alias("x2"))
    return joins.first_row_below(cells, n, "img", "c_custkey", 8.0).select("c_custkey", "below")


@query("SELECT p_partkey, (p_size + p_size % 7) // 2 AS left_x, (p_partkey % 40 + p_partkey % 37) // 2 AS top_y, (100 + p_size + p_size % 9) // 2 AS right_x, (200 + p_partkey % 41 + p_partkey % 43) // 2 AS bottom_y FROM part")
def straightened_quads(spark, d):
    """Quadrilaterals made upright: each side where the mean of its two corners is, cut to a whole number."""
    size, k = F.col("p_size"), F.col("p_partkey")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    corners = {"tl": point(size, k % 40), "tr": point(size + 50, k % 37), "br": point(size % 9 + 50, k % 41 + 100), "bl": point(size % 7, k % 43 + 100)}
    p = t(spark, d, "part").select("p_partkey", *(c.alias(n) for n, c in corners.items()))
    between = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2).cast("long")
    return p.select("p_partkey", between("tl.x", "bl.x").alias("left_x"), between("tl.y", "tr.y").alias("top_y"), between("tr.x", "br.x").alias("right_x"), between("br.y", "bl.y").alias("bottom_y"))


SEGMENT = "g AS (SELECT vec_id, embedding, vec_id % 8 AS y0, vec_id % 5 AS y1, greatest(3, CAST(ceil(sqrt(49 + power(vec_id % 8 - vec_id % 5, 2))) AS BIGINT)) AS n FROM embeddings), s AS (SELECT *, unnest(range(0, n)) AS k FROM g)"


@query(f"WITH {SEGMENT} SELECT vec_id, n AS samples, count(*) FILTER (embedding[CAST(round_even(y0 + (y1 - y0) * k / (n - 1.0), 0) * 8 + round_even(7 * k / (n - 1.0), 0) AS BIGINT) + 1] > 0.05) AS hits FROM s GROUP BY vec_id, n")
def segment_scores(spark, d):
    """How many samples along a segment lie on the mask."""
    y0, y1 = F.col("vec_id") % 8, F.col("vec_id") % 5
    g = glyphs(spark, d).select("vec_id", "px", y0.alias("y0"), y1.alias("y1"), F.greatest(F.ceil(F.sqrt(49 + F.pow((y0 - y1).cast("double"), F.lit(2)))), F.lit(3)).alias("n"))
    place = lambda k: (F.bround(F.col("y0") + (F.col("y1") - F.col("y0")) * k / (F.col("n") - 1.0)) * 8 + F.bround(7 * k / (F.col("n") - 1.0))).cast("int")
    hits = F.filter(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda k: F.get("px", place(k)) > 0.05)
    return g.select("vec_id", F.col("n").cast("long").alias("samples"), F.size(hits).cast("long").alias("hits"))


@query(f"""WITH {PX}, c AS (SELECT vec_id, i, j, round(v, 6) AS v FROM px WHERE j < 4), rw AS (SELECT vec_id, i, avg(v) AS x FROM c GROUP BY ALL), cl AS (SELECT vec_id, j, avg(v) AS y FROM c GROUP BY ALL),
k AS (SELECT vec_id, j, y, j * 7 / 3.0 AS spot, CAST(least(floor(j * 7 / 3.0), 6) AS BIGINT) AS lo FROM cl), p AS (SELECT k.vec_id, a.x + (b.x - a.x) * (spot - lo) AS x, y FROM k JOIN rw a ON a.vec_id = k.vec_id AND a.i = lo JOIN rw b ON b.vec_id = k.vec_id AND b.i = lo + 1)
SELECT vec_id, round(corr(x, y), 6) AS r FROM p GROUP BY vec_id""")
def resampled_correlation(spark, d):
    """Correlation of a cell's row and column profiles, the longer resampled to the shorter."""
    cells = exact.cell_images(spark, d).where("cell = 0")
    p = cells.select("vec_id", signals.row_profile(F.col("px"), 8, 4).alias("r"), signals.column_profile(F.col("px"), 8, 4).alias("c")).withColumn("r", signals.resampled(F.col("r"), 4))
    return p.select("vec_id", r6(signals.pearson(F.col("r"), F.col("c")), "r"))


LAPLACE = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), u AS (SELECT vec_id, label, e, unnest(range(0, 64)) AS k FROM v),
l AS (SELECT vec_id, label, e[k + 1] AS x, e[(CASE WHEN k < 8 THEN k + 8 ELSE k - 8 END) + 1] + e[(CASE WHEN k >= 56 THEN k - 8 ELSE k + 8 END) + 1] + e[(CASE WHEN k % 8 = 0 THEN k + 1 ELSE k - 1 END) + 1] + e[(CASE WHEN k % 8 = 7 THEN k - 1 ELSE k + 1 END) + 1] - 4 * e[k + 1] AS q FROM u),
m AS (SELECT vec_id, label, avg(x) AS mean, stddev_pop(x) AS std, avg(CAST(x < 0 AS INT)) AS text, var_pop(q) AS blur FROM l GROUP BY ALL)"""


@query(f"WITH {LAPLACE}, f AS (SELECT label, unnest(['mean', 'std', 'text', 'blur']) AS measure, unnest([mean, std, text, blur]) AS x FROM m) SELECT label, measure, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS lo, round(max(x), 6) AS hi FROM f GROUP BY ALL")
def set_quality(spark, d):
    """Over each class: mean, deviation and range of brightness, contrast, share of text and sharpness (Laplacian variance)."""
    px, at = F.col("px"), lambda k: F.get("px", k.cast("int"))
    around = lambda k: at(F.when(k < 8, k + 8).otherwise(k - 8)) + at(F.when(k >= 56, k - 8).otherwise(k + 8)) + at(F.when(k % 8 == 0, k + 1).otherwise(k - 1)) + at(F.when(k % 8 == 7, k - 1).otherwise(k + 1))
    g = glyphs(spark, d).withColumn("q", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: around(k) - 4 * at(k)))
    m = {"mean": signals.mean(px), "std": F.sqrt(signals.variance(px)), "text": F.size(F.filter(px, lambda x: x < 0)) / 64, "blur": signals.variance(F.col("q"))}
    long = g.select("label", F.inline(F.array(*(F.struct(F.lit(n).alias("measure"), c.alias("x")) for n, c in m.items()))))
    return long.groupBy("label", "measure").agg(r6(F.avg("x"), "mean"), r6(F.stddev_pop("x"), "std"), r6(F.min("x"), "lo"), r6(F.max("x"), "hi"))


ALL = ("features_basic", "energy_spread", "profile_valleys", "column_entropy", "symmetry")


SIDE_BY_SIDE = " JOIN ".join(f"({ORACLE[n]}) a{i}" + (" USING (vec_id)" if i else "") for i, n in enumerate(ALL))


@query(f"SELECT * FROM {SIDE_BY_SIDE}")
def all_features(spark, d):
    """A raster's measures side by side."""
    out = None
    for n in ALL:
        part = QUERIES[n](spark, d)
        out = part if out is None else out.join(part, "vec_id")
    return out


@query("SELECT item_id, k AS sample, 'sample_' || lpad(CAST(item_id AS VARCHAR), 6, '0') || '_' || k || '.png' AS filename, text AS label FROM benchmark, LATERAL (SELECT unnest(range(1, 4)) AS k)")
def sample_plan(spark, d):
    """Three samples of each token: file name and label."""
    b = t(spark, d, "benchmark").select("item_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))).alias("sample"), F.col("text").alias("label"))
    return b.select("item_id", "sample", F.format_string("sample_%06d_%d.png", "item_id", "sample").alias("filename"), "label")


@query()
def model_input_fan(spark, d):
    """Five forms of each raster for a model, told by their mean (tested against plain versions over the table)."""
    fan = vision.kernel_column(F.col("px"), 8, 8, shapes.INPUTS, lambda a: shapes.model_inputs(grey(a), (4, 4)))
    return glyphs(spark, d).select("vec_id", F.inline(fan)).select("vec_id", "name", r6(signals.mean(F.col("px")), "mean"))


@query("SELECT * FROM (VALUES ('NUMBER', 'number', 200), ('WORD', 'word', 200), ('OTHER', 'other', 200)) v(kind, said, n)")
def generated_tokens(spark, d):
    """Generated tokens of each class are what the token rules say they are."""
    made = augment.class_tokens(spark, ["оп", "руб.", "word", "Итого:"], 200)
    return made.groupBy("kind", tokens.token_type(F.col("token")).alias("said")).agg(F.count("*").cast("int").alias("n"))


@query(f"""WITH {PX}, s AS (SELECT vec_id, (lead(v) OVER r - lag(v) OVER r) AS dx, (lead(v) OVER c - lag(v) OVER c) AS dy FROM px WINDOW r AS (PARTITION BY vec_id, i ORDER BY j), c AS (PARTITION BY vec_id, j ORDER BY i)),
o AS (SELECT vec_id, CAST(floor((atan2(dy, dx) + 2 * pi()) % (2 * pi()) * 9 / (2 * pi())) AS BIGINT) % 9 AS bin, sqrt(dx * dx + dy * dy) AS size FROM s WHERE dx IS NOT NULL AND dy IS NOT NULL),
b AS (SELECT vec_id, k AS bin, coalesce(sum(size), 0) AS w FROM (SELECT DISTINCT vec_id FROM o) x CROSS JOIN (SELECT unnest(range(0, 9)) AS k) n LEFT JOIN o USING (vec_id) WHERE o.bin = k GROUP BY ALL),
t AS (SELECT vec_id, w / sum(w) OVER (PARTITION BY vec_id) AS p FROM b) SELECT vec_id, round(max(p), 6) AS greatest, round(sum(p * p), 6) AS energy, round(sqrt(sum(p * p) / 9 - 1 / 81.0), 6) AS std FROM t GROUP BY vec_id""")
def orientation_stats(spark, d):
    """Nine directions round the circle, weighted by gradient size: greatest share, energy and deviation of the shares."""

    def gradient(k):
        at = (F.floor(k / 6).cast("int") + 1) * 8 + F.pmod(k, F.lit(6)) + 1
        return F.struct((F.get("px", at + 1) - F.get("px", at - 1)).alias("dx"), (F.get("px", at + 8) - F.get("px", at - 8)).alias("dy"))

    bin_of = lambda g: (F.floor(F.pmod(F.atan2(g["dy"], g["dx"]) + 2 * math.pi, F.lit(2 * math.pi)) * 9 / (2 * math.pi)) % 9).cast("int")
    size = lambda g: F.sqrt(g["dx"] * g["dx"] + g["dy"] * g["dy"])
    g = glyphs(spark, d).select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(35)), gradient).alias("g"))
    g = g.select("vec_id", F.transform("g", lambda x: F.struct(bin_of(x).alias("b"), size(x).alias("s"))).alias("g"))
    weights = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda b: F.aggregate("g", F.lit(0.0), lambda t, x: t + F.when(x["b"] == b, x["s"]).otherwise(0.0)))
    p = g.select("vec_id", weights.alias("w")).select("vec_id", F.transform("w", lambda w: w / signals.total(F.col("w"))).alias("p"))
    energy = signals.total(F.transform("p", lambda x: x * x))
    return p.select("vec_id", r6(F.array_max("p"), "greatest"), r6(energy, "energy"), r6(F.sqrt(signals.variance(F.col("p"))), "std"))
