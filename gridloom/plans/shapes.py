"""Queries of edge sums, bands, spans, character runs, thresholds and shape measures, added to the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import signals
from gridloom.operators import shapes, vision
from gridloom.plans.catalog import JUDGED, PX, glyphs, judged, query, r6, t


def _sum(a, keep):
    """Sum of the raster's values for which keep(value, row, column)."""
    return signals.total(F.transform(a, lambda v, k: F.when(keep(v, F.floor(k / 8), F.pmod(k, F.lit(8))), v).otherwise(0.0)))


@query(f"""WITH {PX} SELECT vec_id, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS low, round(max(v), 6) AS high, count(*) FILTER (v < 0) AS dark, count(*) FILTER (v >= 0) AS light,
count(*) FILTER (v < 0) > count(*) FILTER (v >= 0) AS inverted, round(avg(v) FILTER (v >= 0) - avg(v) FILTER (v < 0), 6) AS contrast FROM px GROUP BY vec_id""")
def image_stats(spark, d):
    px, dark, light = F.col("px"), F.filter("px", lambda v: v < 0), F.filter("px", lambda v: v >= 0)
    g = glyphs(spark, d).select("vec_id", "px", dark.alias("dark"), light.alias("light"))
    n = lambda c: F.size(c).cast("long")
    return g.select(
        "vec_id", (F.round(signals.mean(px), 6) + 0.0).alias("mean"), r6(F.sqrt(signals.variance(px)), "std"), r6(F.array_min(px), "low"), r6(F.array_max(px), "high"), n("dark").alias("dark"), n("light").alias("light"),
        (n("dark") > n("light")).alias("inverted"), r6(signals.mean(F.col("light")) - signals.mean(F.col("dark")), "contrast"),
    )


@query(f"""WITH {PX}, b AS (SELECT *, min(CASE WHEN v > 0 THEN j END) OVER (PARTITION BY vec_id) AS x, max(CASE WHEN v > 0 THEN j END) OVER (PARTITION BY vec_id) AS z FROM px)
SELECT vec_id, round(coalesce(sum(v) FILTER (i IN (1, 2)), 0), 6) + 0.0 AS top, round(sum(v) FILTER (i IN (6, 7)), 6) + 0.0 AS bottom, round(sum(v) FILTER (j IN (1, 2)), 6) + 0.0 AS near, round(sum(v) FILTER (j IN (6, 7)), 6) + 0.0 AS far,
round(sum(v) FILTER (v > 0 AND j IN (x, x + 1)), 6) AS first_ink, round(sum(v) FILTER (v > 0 AND j IN (z - 1, z)), 6) AS last_ink FROM b GROUP BY vec_id""")
def edge_sums(spark, d):
    """Sums along the four edges, and of the ink in the first and last two columns that its box has."""
    columns = F.array_distinct(F.filter(F.transform("px", lambda v, k: F.when(v > 0, F.pmod(k, F.lit(8)))), lambda k: k.isNotNull()))
    g = glyphs(spark, d).withColumn("x", F.array_min(columns)).withColumn("z", F.array_max(columns))
    side = lambda keep: F.round(_sum("px", keep), 6) + 0.0
    ink = lambda a, b: F.when(F.col("x").isNotNull(), F.round(_sum("px", lambda v, i, j: (v > 0) & j.between(a, b)), 6))
    return g.select(
        "vec_id", side(lambda v, i, j: i.between(1, 2)).alias("top"), side(lambda v, i, j: i.between(6, 7)).alias("bottom"), side(lambda v, i, j: j.between(1, 2)).alias("near"), side(lambda v, i, j: j.between(6, 7)).alias("far"),
        ink(F.col("x"), F.col("x") + 1).alias("first_ink"), ink(F.col("z") - 1, F.col("z")).alias("last_ink"),
    )


@query(f"""WITH {PX}, e AS (SELECT vec_id, sum(v * v) FILTER (i < 4) AS up, sum(v * v) FILTER (i >= 4) AS down, sum(v) FILTER (i = j) AS falling, sum(v) FILTER (i + j = 7) AS rising FROM px GROUP BY vec_id),
r AS (SELECT vec_id, var_pop(m) AS rv FROM (SELECT vec_id, i, avg(v) AS m FROM px GROUP BY ALL) GROUP BY vec_id), c AS (SELECT vec_id, var_pop(m) AS cv FROM (SELECT vec_id, j, avg(v) AS m FROM px GROUP BY ALL) GROUP BY vec_id)
SELECT e.vec_id, round(up / (down + 1e-9), 4) AS energy_ratio, round(rv / (cv + 1e-9), 4) AS variance_ratio, round(falling, 6) + 0.0 AS falling, round(rising, 6) + 0.0 AS rising FROM e JOIN r ON e.vec_id = r.vec_id JOIN c ON e.vec_id = c.vec_id""")
def band_ratios(spark, d):
    """Energy of the upper against the lower half, variance of rows against columns, and sums along both diagonals."""
    g = glyphs(spark, d).select("vec_id", "px", F.transform("px", lambda v: v * v).alias("sq"), signals.row_profile(F.col("px"), 8, 8).alias("r"), signals.column_profile(F.col("px"), 8, 8).alias("c"))
    return g.select(
        "vec_id", F.round(_sum("sq", lambda v, i, j: i < 4) / (_sum("sq", lambda v, i, j: i >= 4) + 1e-9), 4).alias("energy_ratio"), F.round(signals.variance(F.col("r")) / (signals.variance(F.col("c")) + 1e-9), 4).alias("variance_ratio"),
        (F.round(_sum("px", lambda v, i, j: i == j), 6) + 0.0).alias("falling"), (F.round(_sum("px", lambda v, i, j: i + j == 7), 6) + 0.0).alias("rising"),
    )


@query(f"""WITH {PX}, s AS (SELECT vec_id, i, j, min(CASE WHEN v > 0.15 THEN j END) OVER (PARTITION BY vec_id, i ORDER BY j ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS stop FROM px)
SELECT vec_id, i, j, coalesce(stop, 8) - j AS span FROM s""")
def span_growth(spark, d):
    """How many cells a span that starts here covers before the next separating line of its row."""
    stop = lambda k: F.array_min(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda m: (m > F.pmod(k, F.lit(8))) & (F.get("px", (F.floor(k / 8) * 8 + m).cast("int")) > 0.15)))
    one = lambda v, k: F.struct(F.floor(k / 8).alias("i"), F.pmod(k, F.lit(8)).cast("long").alias("j"), (F.coalesce(stop(k), F.lit(8)) - F.pmod(k, F.lit(8))).cast("long").alias("span"))
    return glyphs(spark, d).select("vec_id", F.inline(F.transform("px", one)))


@query(f"""WITH {PX}, p AS (SELECT vec_id, j, avg(v) AS c, max(v) FILTER (i IN (3, 4)) AS core FROM px GROUP BY ALL),
s AS (SELECT vec_id, j, c >= avg(c) FILTER (j BETWEEN 2 AND 5) OVER (PARTITION BY vec_id) OR core >= 0.2 AS ink FROM p), g AS (SELECT *, j - row_number() OVER (PARTITION BY vec_id, ink ORDER BY j) AS g FROM s)
SELECT vec_id, min(j) AS s, max(j) + 1 AS e, count(*) > 5 AS wide FROM g WHERE ink GROUP BY vec_id, g HAVING count(*) >= 2""")
def character_runs(spark, d):
    """Runs of columns as dark as the middle ones, or with a dark pixel in the centre band; wide ones are to be split again."""
    g = glyphs(spark, d).select("vec_id", "px", signals.column_profile(F.col("px"), 8, 8).alias("c")).withColumn("level", signals.mean(F.slice("c", 3, 4)))
    core = lambda j: F.greatest(F.get("px", 24 + j), F.get("px", 32 + j)) >= 0.2
    g = g.select("vec_id", F.inline(signals.intervals(F.transform("c", lambda c, j: (c >= F.col("level")) | core(j))))).where("e - s >= 2")
    return g.select("vec_id", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"), F.expr("e - s > 5").alias("wide"))


@query(f"""WITH {PX}, p AS (SELECT vec_id, j, avg(v) AS c FROM px GROUP BY ALL), g AS (SELECT *, j - row_number() OVER (PARTITION BY vec_id, c > 0 ORDER BY j) AS g FROM p),
r AS (SELECT vec_id, count(*) AS n FROM g WHERE c > 0 GROUP BY vec_id, g HAVING count(*) >= 2 AND max(j) < 7), w AS (SELECT vec_id, avg((n + 2) / 8) AS w FROM r GROUP BY vec_id)
SELECT p.vec_id, round(avg(CAST(c <= 0 AS INT)), 6) AS white, round(coalesce(any_value(w), 0), 6) AS peak_width FROM p LEFT JOIN w ON p.vec_id = w.vec_id GROUP BY p.vec_id""")
def peak_widths(spark, d):
    """Share of white columns, and the mean width of peaks; a run that touches the right edge isn't counted."""
    g = glyphs(spark, d).select("vec_id", F.transform(signals.column_profile(F.col("px"), 8, 8), lambda c: c > 0).alias("on"))
    peaks = F.filter(signals.intervals(F.col("on")), lambda r: (r["e"] - r["s"] >= 2) & (r["e"] < 8))
    widths = F.transform(peaks, lambda r: (r["e"] - r["s"] + 2) / 8)
    return g.select("vec_id", r6(F.size(F.filter("on", lambda x: ~x)) / 8, "white"), r6(F.coalesce(signals.mean(widths), F.lit(0.0)), "peak_width"))


@query(f"""WITH {PX}, p AS (SELECT vec_id, j, avg(greatest(v, 0)) AS c FROM px GROUP BY ALL), n AS (SELECT *, max(c) OVER w AS hi, min(c) OVER w AS lo, lag(c) OVER o AS l, lead(c) OVER o AS r FROM p WINDOW w AS (PARTITION BY vec_id), o AS (PARTITION BY vec_id ORDER BY j)),
e AS (SELECT *, (c - lo) / (hi - lo + 1e-12) AS x, coalesce(c > l AND c >= r, false) AS peak, coalesce(c < l AND c <= r, false) AS valley FROM n),
k AS (SELECT *, last_value(CASE WHEN peak THEN x END IGNORE NULLS) OVER (PARTITION BY vec_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pl, first_value(CASE WHEN peak THEN x END IGNORE NULLS) OVER (PARTITION BY vec_id ORDER BY j ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS pr FROM e)
SELECT vec_id, round(CASE WHEN max(hi - lo) <= 1e-8 THEN 0 WHEN count(*) FILTER (peak) < 2 OR count(*) FILTER (valley) = 0 THEN max((hi - lo) / (hi + 1e-9))
ELSE coalesce(avg(least(pl, pr) - x) FILTER (valley AND pl IS NOT NULL AND pr IS NOT NULL AND least(pl, pr) > x), 1) END, 5) AS depth FROM k GROUP BY vec_id""")
def gap_depth(spark, d):
    """How far the ink profile falls, on average, between the peaks next to each valley."""
    g = glyphs(spark, d).select("vec_id", signals.column_profile(F.transform("px", lambda v: F.greatest(v, F.lit(0.0))), 8, 8).alias("c"))
    return g.select("vec_id", F.round(signals.valley_depth(F.col("c")), 5).alias("depth"))


@query(f"""WITH {PX}, q AS (SELECT *, lead(v) OVER (PARTITION BY vec_id, i ORDER BY j) AS r FROM px) SELECT vec_id, i, count(*) FILTER (v < 0) AS dark, round(max(abs(r - v)), 6) AS step FROM q GROUP BY vec_id, i""")
def row_changes(spark, d):
    """Dark pixels of each row, and its greatest change between neighbours."""
    row = lambda i: F.slice("px", i * 8 + 1, 8)
    step = lambda a: F.array_max(F.zip_with(F.slice(a, 1, 7), F.slice(a, 2, 7), lambda x, y: F.abs(y - x)))
    rows = F.array(*(F.struct(F.lit(i).cast("long").alias("i"), row(i).alias("a")) for i in range(8)))
    return glyphs(spark, d).select("vec_id", F.inline(rows)).select("vec_id", "i", F.size(F.filter("a", lambda v: v < 0)).cast("long").alias("dark"), r6(step(F.col("a")), "step"))


@query(f"""WITH {PX}, m AS (SELECT vec_id, j, avg(v) AS c FROM px WHERE i BETWEEN 1 AND 6 GROUP BY ALL) SELECT vec_id, count(*) FILTER (c < 0.02) / 8 AS white FROM m GROUP BY vec_id HAVING count(*) FILTER (c < 0.02) / 8 <= 0.9""")
def not_white(spark, d):
    """Rasters that keep enough dark columns once their top and bottom rows are left out."""
    white = F.size(F.filter(signals.column_profile(F.slice("px", 9, 48), 6, 8), lambda c: c < 0.02)) / 8
    return glyphs(spark, d).select("vec_id", white.alias("white")).where("white <= 0.9")


@query(f"""WITH {PX} SELECT vec_id, count(*) FILTER (v > 0.1) AS fixed, round(coalesce(sum(v) FILTER (v > 0.1), 0), 6) AS to_zero, round(sum(least(1.0, greatest(0.0, 2 * v + 0.2))), 6) AS gain FROM px GROUP BY vec_id""")
def thresholds(spark, d):
    px = F.col("px")
    gain = F.transform(px, lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * v + 0.2)))
    return glyphs(spark, d).select("vec_id", F.size(F.filter(px, lambda v: v > 0.1)).cast("long").alias("fixed"), r6(signals.total(F.filter(px, lambda v: v > 0.1)), "to_zero"), r6(signals.total(gain), "gain"))


@query("SELECT vec_id FROM embeddings ORDER BY md5(CAST(vec_id AS VARCHAR) || '/42'), vec_id LIMIT 100")
def seeded_sample(spark, d):
    """A seeded sample without replacement: the rows that a hash puts first."""
    return t(spark, d, "embeddings").select("vec_id").orderBy(F.md5(F.concat(F.col("vec_id").cast("string"), F.lit("/42")).cast("binary")), "vec_id").limit(100)


@query(f"WITH {JUDGED}, n AS (SELECT truth, count(*) AS n FROM jd GROUP BY truth) SELECT jd.truth, predicted, count(*) AS times, round(count(*) / any_value(n), 6) AS share FROM jd JOIN n ON jd.truth = n.truth GROUP BY jd.truth, predicted")
def confusion_pairs(spark, d):
    """Directed pairs of truth and prediction, with their share of the truth's rows."""
    pairs = judged(spark, d).groupBy("truth", "predicted").agg(F.count("*").alias("times"))
    whole = pairs.groupBy("truth").agg(F.sum("times").alias("n"))
    return pairs.join(whole, "truth").select("truth", "predicted", "times", r6(F.col("times") / F.col("n"), "share"))


@query("""WITH m AS (SELECT user_id, event_type, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) / count(*) AS score FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_type) AS n FROM m)
SELECT user_id, event_type AS best, score FROM r WHERE n = 1""")
def best_of(spark, d):
    """Each user's kind of event with the greatest mean (in hundredths, so that sums are exact), the first by name among equals."""
    m = t(spark, d, "events").groupBy("user_id", "event_type").agg((F.sum(F.round(F.col("value") * 100).cast("long")) / F.count("*")).alias("score"))
    first = F.min(F.struct((-F.col("score")).alias("s"), F.col("event_type").alias("best")))
    return m.groupBy("user_id").agg(first.alias("f")).select("user_id", "f.best", (-F.col("f.s")).alias("score"))


# -- kernels


def _kernel(spark, d, kind, kernel):
    return glyphs(spark, d).select("vec_id", vision.kernel_column(F.col("px"), 8, 8, kind, kernel).alias("f"))


@query()
def stroke_counts(spark, d):
    return _kernel(spark, d, shapes.STROKES, lambda a: shapes.strokes(a > 0, 3)).select("vec_id", "f.*")


@query()
def component_spread(spark, d):
    return _kernel(spark, d, shapes.SPREAD, lambda a: shapes.spread(a > 0.05)).select("vec_id", "f.*")


@query()
def edge_features(spark, d):
    return _kernel(spark, d, shapes.EDGES, shapes.edge_features).select("vec_id", "f.*")


@query()
def straight_lines(spark, d):
    return _kernel(spark, d, shapes.LINES, lambda a: shapes.straight_lines(a > 0.05, 5, 5)).select("vec_id", F.inline("f"))


@query()
def variant_fan(spark, d):
    """Twelve binarised variants of each raster with their share of ink."""
    return _kernel(spark, d, shapes.FAN, lambda a: shapes.fan(((a + 0.6) / 1.2 * 255).clip(0, 255).round())).select("vec_id", F.inline("f"))
