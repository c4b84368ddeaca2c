"""Queries of the image kernels. Rasters are the 8 x 8 embeddings, as in the catalog, which these are added to."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import signals
from gridloom.operators import augment, vision
from gridloom.plans.catalog import PX, glyphs, pixels, query, r6

#: Grey levels 0..255 of a value, as SQL that both engines read.
LEVEL = "least(255, greatest(0, floor((v + 0.6) / 1.2 * 256)))"

#: Hu's seven invariants of normalised central moments (fixed formulas).
HU = {
    "h1": "n20 + n02",
    "h2": "power(n20 - n02, 2) + 4 * power(n11, 2)",
    "h3": "power(n30 - 3 * n12, 2) + power(3 * n21 - n03, 2)",
    "h4": "power(n30 + n12, 2) + power(n21 + n03, 2)",
    "h5": "(n30 - 3 * n12) * (n30 + n12) * (power(n30 + n12, 2) - 3 * power(n21 + n03, 2)) + (3 * n21 - n03) * (n21 + n03) * (3 * power(n30 + n12, 2) - power(n21 + n03, 2))",
    "h6": "(n20 - n02) * (power(n30 + n12, 2) - power(n21 + n03, 2)) + 4 * n11 * (n30 + n12) * (n21 + n03)",
    "h7": "(3 * n21 - n03) * (n30 + n12) * (power(n30 + n12, 2) - 3 * power(n21 + n03, 2)) - (n30 - 3 * n12) * (n21 + n03) * (3 * power(n30 + n12, 2) - power(n21 + n03, 2))",
}
ORDERS = [(2, 0), (0, 2), (1, 1), (3, 0), (0, 3), (2, 1), (1, 2)]
_NORMAL = ", ".join(f"sum(power(j - cx, {p}) * power(i - cy, {q}) * v) / power(any_value(m00), {1 + (p + q) / 2}) AS n{p}{q}" for p, q in ORDERS)
_INVARIANTS = ", ".join(f"round({e}, 6) + 0.0 AS {n}" for n, e in HU.items())


@query(f"""WITH {PX}, b AS (SELECT vec_id, i, j, greatest(v, 0) AS v FROM px), c AS (SELECT vec_id, sum(v) AS m00, sum(j * v) / sum(v) AS cx, sum(i * v) / sum(v) AS cy FROM b GROUP BY vec_id HAVING sum(v) > 0),
n AS (SELECT b.vec_id, {_NORMAL} FROM b JOIN c ON b.vec_id = c.vec_id GROUP BY b.vec_id) SELECT vec_id, {_INVARIANTS} FROM n""")
def hu_moments(spark, d):
    row, col = lambda k: F.floor(k / 8).cast("double"), lambda k: F.pmod(k, F.lit(8)).cast("double")
    g = glyphs(spark, d).withColumn("px", F.transform("px", lambda v: F.greatest(v, F.lit(0.0)))).withColumn("m00", signals.total(F.col("px"))).where("m00 > 0")
    g = g.withColumn("cx", signals.total(F.transform("px", lambda v, k: col(k) * v)) / F.col("m00")).withColumn("cy", signals.total(F.transform("px", lambda v, k: row(k) * v)) / F.col("m00"))
    moment = lambda p, q: signals.total(F.transform("px", lambda v, k: F.pow(col(k) - F.col("cx"), F.lit(p)) * F.pow(row(k) - F.col("cy"), F.lit(q)) * v)) / F.pow("m00", F.lit(1 + (p + q) / 2))
    g = g.select("vec_id", *(moment(p, q).alias(f"n{p}{q}") for p, q in ORDERS))
    return g.select("vec_id", *((F.round(F.expr(e), 6) + 0.0).alias(n) for n, e in HU.items()))  # no negative zero


@query(f"""WITH {PX}, s AS (SELECT vec_id, i, j, lead(v) OVER r - lag(v) OVER r AS dx, lead(v) OVER c - lag(v) OVER c AS dy FROM px WINDOW r AS (PARTITION BY vec_id, i ORDER BY j), c AS (PARTITION BY vec_id, j ORDER BY i)),
o AS (SELECT vec_id, CAST(least(8, floor((degrees(atan2(dy, dx)) + 360) % 180 / 20)) AS BIGINT) AS bin, sqrt(dx * dx + dy * dy) AS size FROM s WHERE dx IS NOT NULL AND dy IS NOT NULL) SELECT vec_id, bin, round(sum(size), 6) AS weight FROM o GROUP BY ALL""")
def orientation_histogram(spark, d):
    """Gradient size by direction (nine bins of 20 degrees) over the inner pixels."""

    def gradient(k):
        at = (F.floor(k / 6).cast("int") + 1) * 8 + F.pmod(k, F.lit(6)) + 1
        return F.struct((F.get("px", at + 1) - F.get("px", at - 1)).alias("dx"), (F.get("px", at + 8) - F.get("px", at - 8)).alias("dy"))

    g = glyphs(spark, d).select("vec_id", F.inline(F.transform(F.sequence(F.lit(0), F.lit(35)), gradient)))
    place = F.least(F.lit(8), F.floor((F.degrees(F.atan2("dy", "dx")) + 360) % 180 / 20)).cast("long")
    return g.groupBy("vec_id", place.alias("bin")).agg(r6(F.sum(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))), "weight"))


@query(f"""WITH {PX}, c AS (SELECT vec_id, j AS k, avg(v) AS x FROM px GROUP BY ALL), r AS (SELECT vec_id, i AS k, avg(v) AS y FROM px GROUP BY ALL)
SELECT c.vec_id, round(corr(x, y), 6) + 0.0 AS likeness FROM c JOIN r ON c.vec_id = r.vec_id AND c.k = r.k GROUP BY c.vec_id""")
def projection_correlation(spark, d):
    """Pearson's coefficient of the column profile and the row profile."""
    g = glyphs(spark, d).select("vec_id", signals.column_profile(F.col("px"), 8, 8).alias("x"), signals.row_profile(F.col("px"), 8, 8).alias("y"))
    x, y = F.col("x"), F.col("y")
    covariance = signals.mean(F.zip_with(x, y, lambda a, b: a * b)) - signals.mean(x) * signals.mean(y)
    return g.select("vec_id", (F.round(F.try_divide(covariance, F.sqrt(signals.variance(x) * signals.variance(y))), 6) + 0.0).alias("likeness"))


@query("""WITH p AS (SELECT vec_id, k, CAST(embedding[2 * k + 1] AS DOUBLE) AS x, CAST(embedding[2 * k + 2] AS DOUBLE) AS y FROM (SELECT *, unnest(range(0, 4)) AS k FROM embeddings))
SELECT vec_id, arg_min(k, (x + y, k)) AS tl, arg_min(k, (y - x, k)) AS tr, arg_min(k, (-(x + y), k)) AS br, arg_min(k, (-(y - x), k)) AS bl FROM p GROUP BY vec_id""")
def quad_order(spark, d):
    """The first eight values as four points: which is top left, top right, bottom right, bottom left."""
    first = lambda score: F.array_min(F.array(*(F.struct(score(F.get("px", F.lit(2 * k)), F.get("px", F.lit(2 * k + 1))).alias("s"), F.lit(k).cast("long").alias("k")) for k in range(4))))["k"]
    return glyphs(spark, d).select("vec_id", first(lambda x, y: x + y).alias("tl"), first(lambda x, y: y - x).alias("tr"), first(lambda x, y: -(x + y)).alias("br"), first(lambda x, y: -(y - x)).alias("bl"))


@query(f"""WITH {PX}, l AS (SELECT vec_id, i * 8 + j AS k, CAST({LEVEL} AS BIGINT) AS level FROM px), h AS (SELECT *, count(*) OVER (PARTITION BY vec_id ORDER BY level) AS upto FROM l), m AS (SELECT *, min(upto) OVER (PARTITION BY vec_id) AS low FROM h)
SELECT vec_id, CAST(sum((k + 1) * CASE WHEN low = 64 THEN level ELSE floor((upto - low) * 255.0::DOUBLE / (64 - low) + 0.5) END) AS BIGINT) AS told FROM m GROUP BY vec_id""")
def equalized_histogram(spark, d):
    """Levels spread along the cumulative histogram, told by a weighted sum over the raster."""
    levels = F.transform("px", lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((v + 0.6) / 1.2 * 256))))
    g = glyphs(spark, d).select("vec_id", levels.alias("a")).withColumn("upto", F.transform("a", lambda x: F.size(F.filter("a", lambda y: y <= x)))).withColumn("low", F.array_min("upto"))
    spread = F.zip_with("a", "upto", lambda x, u: F.when(F.col("low") == 64, x).otherwise(F.floor(F.try_divide((u - F.col("low")) * F.lit(255.0), 64 - F.col("low")) + 0.5)))
    told = F.aggregate(F.transform(spread, lambda x, k: (x * (k + 1)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return g.select("vec_id", told.alias("told"))


@query(f"""WITH {PX}, w AS (SELECT vec_id, i, j, max(v) OVER (PARTITION BY vec_id, j ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS top FROM px)
SELECT vec_id, i, count(*) FILTER (top > 0.1) / 8 AS share, count(*) FILTER (top > 0.1) >= 0.6 * 8 AS line FROM w GROUP BY vec_id, i""")
def line_rows(spark, d):
    """Whether a line runs along each row: enough columns have ink in the row or next to it."""
    hit = lambda i, j: F.greatest(*(F.when(F.lit(0 <= i + s < 8), F.get("px", F.lit(max(0, i + s) * 8 + j))) for s in (-1, 0, 1))) > 0.1
    rows = F.array(*(F.struct(F.lit(i).cast("long").alias("i"), sum((hit(i, j).cast("int") for j in range(8)), F.lit(0)).alias("n")) for i in range(8)))
    return glyphs(spark, d).select("vec_id", F.inline(rows)).select("vec_id", "i", (F.col("n") / 8).alias("share"), (F.col("n") >= 0.6 * 8).alias("line"))


@query(f"WITH {PX} SELECT vec_id, i // 2 AS y, j // 2 AS x, round(avg(v), 6) AS v FROM px GROUP BY ALL")
def area_resized(spark, d):
    p = pixels(spark, d).groupBy("vec_id", F.expr("cast(i div 2 as bigint)").alias("y"), F.expr("cast(j div 2 as bigint)").alias("x"))
    return p.agg(r6(F.avg("v"), "v"))


def _each(spark, d, kind, kernel):
    return glyphs(spark, d).select("vec_id", vision.kernel_column(F.col("px"), 8, 8, kind, kernel).alias("f")).select("vec_id", "f.*")


@query()
def outline_descriptors(spark, d):
    """Outlines of the ink: count, holes, and the largest one's shape."""
    return _each(spark, d, vision.OUTLINE, lambda a: vision.outline_features(a > 0.05))


@query()
def hog_descriptors(spark, d):
    return _each(spark, d, vision.HOG, lambda a: vision.hog_features(a, cell=4))


@query()
def fourier_descriptors(spark, d):
    return _each(spark, d, vision.FOURIER, lambda a: vision.fourier_features(a > 0.05))


@query()
def filtered_rasters(spark, d):
    """Each raster through the edge-keeping filter, straightened from a slanted quadrilateral, and its spectrum's share of fine detail."""
    grey = lambda a: (a + 0.6) / 1.2 * 255
    run = lambda a: {"kept": float(vision.bilateral(grey(a), 5).sum()), "straight": float(vision.warp(grey(a), [[0, 1], [7, 0], [6, 7], [1, 6]], 8, 8).sum()), "fine": vision.high_frequency_share(a)}
    return _each(spark, d, "struct<kept:double,straight:double,fine:double>", run)


@query()
def augmented_rasters(spark, d):
    """Two seeded variants of each raster."""
    g = glyphs(spark, d).withColumn("px", F.transform("px", lambda v: F.least(F.lit(255.0), F.greatest(F.lit(0.0), (v + 0.6) / 1.2 * 255))))
    return augment.variants(g, "vec_id", 8, 8, 2)
