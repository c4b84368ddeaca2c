"""Queries of rules that need data which tells them apart: runs and their growth, profiles, tokens, sets and columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.functions import keys, signals, tokens
from gridloom.operators import columns, evaluate, models, raster, runs, spectra, vision
from gridloom.plans.catalog import EV, JUDGED, MATRIX, PX, glyphs, judged, query, r6, t

# -- runs, with a signal for each user: 150 of them, whose greatest value is below or above 1

LEVELS = "lv AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value / (CASE WHEN user_id % 2 = 0 THEN 500 ELSE 150 END) AS v FROM events), mx AS (SELECT user_id, max(v) AS top, count(*) AS n FROM lv GROUP BY user_id)"


def levels(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t(spark, d, "events").select("user_id", (F.row_number().over(w) - 1).cast("long").alias("i"), (F.col("value") / F.when(F.col("user_id") % 2 == 0, 500).otherwise(150)).alias("value"))


DIPS = LEVELS.replace("value / (CASE WHEN user_id % 2 = 0 THEN 500 ELSE 150 END)", "(CASE WHEN user_id % 2 = 0 THEN 1.0 ELSE 1.1 END) - value / 500")


def dips(spark, d):
    """The same signal from the top down: light rows with dark ones between them."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t(spark, d, "events").select("user_id", (F.row_number().over(w) - 1).cast("long").alias("i"), (F.when(F.col("user_id") % 2 == 0, 1.0).otherwise(1.1) - F.col("value") / 500).alias("value"))


ROW_RUNS = f"""{DIPS}, st AS (SELECT lv.user_id, i, n, CASE WHEN top < 1 THEN v / top ELSE v END < 0.9 AS on_ FROM lv JOIN mx USING (user_id)),
g AS (SELECT user_id, n, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM st WHERE on_),
r AS (SELECT user_id, n, CASE WHEN min(i) > 2 THEN min(i) - 1 ELSE min(i) END AS s, CASE WHEN max(i) + 1 < n THEN max(i) + 2 ELSE n END AS e FROM g GROUP BY user_id, n, g),
k AS (SELECT * FROM r WHERE e - s >= 2), m AS (SELECT *, CASE WHEN s - lag(e) OVER w < 1 THEN 0 ELSE 1 END AS new FROM k WINDOW w AS (PARTITION BY user_id ORDER BY s)),
rr AS (SELECT user_id, n, min(s) AS s, max(e) AS e FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s) AS q FROM m) GROUP BY user_id, n, q)"""


@query(f"WITH {ROW_RUNS} SELECT user_id, s, e FROM rr")
def row_runs(spark, d):
    return runs.row_runs(dips(spark, d), ["user_id"], "i").select("user_id", "s", "e")


COLUMN_RUNS = f"""{LEVELS}, st AS (SELECT lv.user_id, i, n, CASE WHEN top > 1 THEN v / top ELSE v END > 0.1 AS on_ FROM lv JOIN mx USING (user_id)),
g AS (SELECT user_id, n, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM st WHERE on_), cr AS (SELECT user_id, n, min(i) AS s, max(i) + 1 AS e FROM g GROUP BY user_id, n, g HAVING count(*) >= 3)"""


@query(f"WITH {COLUMN_RUNS} SELECT user_id, s, e FROM cr")
def column_runs(spark, d):
    return runs.column_runs(levels(spark, d), ["user_id"], "i", 0.1).select("user_id", "s", "e")


GROWN = """a AS (SELECT *, CASE WHEN s > user_id % 4 THEN s - user_id % 4 ELSE s END AS s1, CASE WHEN n - e >= 2 THEN e + 2 WHEN n - e >= 1 THEN e + 1 ELSE e END AS e1 FROM {runs})"""


@query(f"WITH {COLUMN_RUNS}, {GROWN.format(runs='cr')} SELECT user_id, s1 AS s, CASE WHEN e1 - s1 <= 7 AND n - e1 >= 2 THEN e1 + 2 ELSE e1 END AS e FROM a WHERE CASE WHEN e1 - s1 <= 7 AND n - e1 >= 2 THEN e1 + 2 ELSE e1 END - s1 >= 3")
def grown_words(spark, d):
    """Column runs, moved by the removed rows (user_id mod 4 of them) and grown at their ends."""
    c = runs.column_runs(levels(spark, d), ["user_id"], "i", 0.1)
    grown = signals.grown_word(F.col("s"), F.col("e"), F.col("n"), F.col("user_id") % 4)
    return c.select("user_id", grown.alias("g")).where("g is not null").select("user_id", F.col("g.s").cast("long").alias("s"), F.col("g.e").cast("long").alias("e"))


@query(f"WITH {ROW_RUNS}, {GROWN.format(runs='rr')} SELECT user_id, s1 AS s, CASE WHEN e1 - s1 <= 5 AND n - e1 >= 2 THEN e1 + 2 ELSE e1 END AS e FROM a WHERE e1 - s1 >= 5")
def grown_blobs(spark, d):
    c = runs.row_runs(dips(spark, d), ["user_id"], "i")
    grown = signals.grown_blob(F.col("s"), F.col("e"), F.col("n"), F.col("user_id") % 4)
    return c.select("user_id", grown.alias("g")).where("g is not null").select("user_id", F.col("g.s").cast("long").alias("s"), F.col("g.e").cast("long").alias("e"))


# -- profiles


@query(f"""WITH {PX}, p AS (SELECT vec_id, j, avg(v) AS c FROM px GROUP BY ALL), sm AS (SELECT vec_id, j, round(sum(c) OVER (PARTITION BY vec_id ORDER BY j ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3, 9) AS c FROM p),
rg AS (SELECT vec_id, min(c) AS lo, CASE WHEN max(c) - min(c) > 1e-9 THEN max(c) - min(c) ELSE 1 END AS r FROM sm GROUP BY vec_id), nz AS (SELECT vec_id, j, (c - lo) / r AS x, r FROM sm JOIN rg USING (vec_id)),
z AS (SELECT *, lag(x) OVER w AS b, lead(x) OVER w AS a FROM nz WINDOW w AS (PARTITION BY vec_id ORDER BY j)), e AS (SELECT *, coalesce(x > b AND x >= a, false) AS peak, coalesce(x < b AND x <= a, false) AS valley FROM z),
n AS (SELECT *, last_value(CASE WHEN peak THEN x END IGNORE NULLS) OVER (PARTITION BY vec_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l, first_value(CASE WHEN peak THEN x END IGNORE NULLS) OVER (PARTITION BY vec_id ORDER BY j ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS rt FROM e),
dp AS (SELECT *, CASE WHEN valley AND l IS NOT NULL AND rt IS NOT NULL THEN greatest(least(l, rt) - x, 0) END AS depth FROM n)
SELECT vec_id, count(*) FILTER (peak) AS peaks, count(*) FILTER (valley) AS valleys, count(*) FILTER (depth >= 0.25) AS deep, round(count(*) FILTER (depth >= 0.25) / greatest(1, count(*) FILTER (peak)), 6) AS deep_ratio, round(coalesce(avg(depth), 0), 6) AS mean_depth, round(coalesce(avg(depth) FILTER (depth >= 0.25), 0), 6) AS mean_deep, round(max(r), 6) AS profile_range FROM dp GROUP BY vec_id""")
def profile_valleys(spark, d):
    """Peaks, valleys and deep valleys of the smoothed column profile."""
    smooth = signals.moving_average(signals.column_profile(F.col("px"), 8, 8), 3)
    got = glyphs(spark, d).select("vec_id", F.transform(smooth, lambda x: F.round(x, 9)).alias("p")).select("vec_id", signals.valley_counts(F.col("p"), 0.25).alias("f"))
    f = lambda n: r6(F.col(f"f.{n}"), n)
    return got.select("vec_id", "f.peaks", "f.valleys", "f.deep", f("deep_ratio"), f("mean_depth"), f("mean_deep"), f("profile_range"))


@query(f"""WITH {PX}, p AS (SELECT vec_id, j, round(avg(v), 9) + 0.5 AS c FROM px GROUP BY ALL), b AS (SELECT vec_id, least(31, floor(c * 32)) AS bin, count(*) AS n FROM p WHERE c BETWEEN 0 AND 1 GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY vec_id) AS q FROM b)
SELECT vec_id, round(-sum(q * log2(q)) / 5, 6) AS entropy FROM s GROUP BY vec_id""")
def column_entropy(spark, d):
    """32-bin entropy of the column intensities; the last bin is closed, values outside [0, 1] are dropped."""
    c = F.transform(signals.column_profile(F.col("px"), 8, 8), lambda x: F.round(x, 9) + 0.5)
    return glyphs(spark, d).select("vec_id", signals.histogram_entropy(c, 32).alias("h")).where("h is not null").select("vec_id", r6(F.col("h"), "entropy"))


@query(f"""WITH {PX}, q AS (SELECT vec_id, (i // 4) * 2 + j // 4 AS k, sum(v * v) AS e FROM px GROUP BY ALL), s AS (SELECT vec_id, e / sum(e) OVER (PARTITION BY vec_id) AS share FROM q), sv AS (SELECT vec_id, var_pop(share) AS qv FROM s GROUP BY vec_id),
r AS (SELECT vec_id, i, avg(v) + 0.6 + 1e-12 AS x FROM px GROUP BY ALL), c AS (SELECT vec_id, j, avg(v) + 0.6 + 1e-12 AS x FROM px GROUP BY ALL),
rp AS (SELECT vec_id, -sum(p * log2(p + 1e-12)) AS h FROM (SELECT vec_id, x / sum(x) OVER (PARTITION BY vec_id) AS p FROM r) GROUP BY vec_id), cp AS (SELECT vec_id, -sum(p * log2(p + 1e-12)) AS h FROM (SELECT vec_id, x / sum(x) OVER (PARTITION BY vec_id) AS p FROM c) GROUP BY vec_id)
SELECT sv.vec_id, round(qv, 6) AS quadrant_variance, round(rp.h, 6) AS row_entropy, round(cp.h, 6) AS col_entropy, round(rp.h / (cp.h + 1e-12), 6) AS entropy_ratio FROM sv JOIN rp USING (vec_id) JOIN cp USING (vec_id)""")
def energy_spread(spark, d):
    """Variance of the quadrants' energy shares, entropies of the row and column intensities and their ratio."""
    px = F.col("px")
    energy = lambda top, left: F.aggregate(F.sequence(F.lit(0), F.lit(15)), F.lit(0.0), lambda s, k: s + F.pow(F.get(px, (top + F.floor(k / 4)).cast("int") * 8 + left + k % 4), F.lit(2)))
    quads = F.array(*(energy(y, x) for y in (0, 4) for x in (0, 4)))
    g = glyphs(spark, d).select("vec_id", quads.alias("q"), *(F.transform(f(px, 8, 8), lambda x: x + 0.6).alias(n) for n, f in (("r", signals.row_profile), ("c", signals.column_profile))))
    g = g.withColumn("s", F.transform("q", lambda e: e / signals.total(F.col("q")))).withColumn("rh", signals.entropy(F.col("r"))).withColumn("ch", signals.entropy(F.col("c")))
    return g.select("vec_id", r6(signals.variance(F.col("s")), "quadrant_variance"), r6(F.col("rh"), "row_entropy"), r6(F.col("ch"), "col_entropy"), r6(F.col("rh") / (F.col("ch") + 1e-12), "entropy_ratio"))


@query(f"""WITH {PX} SELECT vec_id, count(*) AS mass, round(avg(j - 3.5), 6) AS center_x, round(avg(i - 3.5), 6) AS center_y FROM px WHERE v < 0.05 GROUP BY vec_id""")
def centred_mass(spark, d):
    """Dark pixels and their centroid, measured from the middle of the raster."""
    dark = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.get("px", k) < 0.05)
    g = glyphs(spark, d).select("vec_id", dark.alias("k")).where(F.size("k") > 0)
    centre = lambda f: signals.mean(F.transform("k", lambda k: f(k) - 3.5))
    return g.select("vec_id", F.size("k").cast("long").alias("mass"), r6(centre(lambda k: (k % 8).cast("double")), "center_x"), r6(centre(lambda k: F.floor(k / 8).cast("double")), "center_y"))


@query("SELECT vec_id, round(list_avg(list_sort(list_transform(embedding, lambda x: CAST(x AS DOUBLE)))[1:10]), 6) AS darkest FROM embeddings")
def darkest_ten(spark, d):
    return glyphs(spark, d).select("vec_id", r6(signals.mean(F.slice(F.array_sort("px"), 1, 10)), "darkest"))


# -- the image chain: cells of a raster, lines of a cell, words of a line, characters of a word

CHAIN = f"""{PX}, c AS (SELECT vec_id, j // 4 AS cell, i, j % 4 AS j, round(v, 6) AS v FROM px), rw AS (SELECT vec_id, cell, i, round(avg(v), 6) > -0.05 AS on_ FROM c GROUP BY ALL),
ln AS (SELECT vec_id, cell, min(i) AS y0, max(i) + 1 AS y1 FROM (SELECT *, i - row_number() OVER (PARTITION BY vec_id, cell ORDER BY i) AS g FROM rw WHERE on_) GROUP BY vec_id, cell, g HAVING count(*) >= 2),
cl AS (SELECT ln.vec_id, ln.cell, y0, y1, j, round(avg(v), 6) > -0.05 AS on_ FROM ln JOIN c ON c.vec_id = ln.vec_id AND c.cell = ln.cell AND i >= y0 AND i < y1 GROUP BY ALL),
wd AS (SELECT vec_id, cell, y0, y1, min(j) AS x0, max(j) + 1 AS x1 FROM (SELECT *, j - row_number() OVER (PARTITION BY vec_id, cell, y0 ORDER BY j) AS g FROM cl WHERE on_) GROUP BY vec_id, cell, y0, y1, g HAVING count(*) >= 2),
ch AS (SELECT wd.*, j, max(v) > 0.08 AS on_ FROM wd JOIN c ON c.vec_id = wd.vec_id AND c.cell = wd.cell AND i >= y0 AND i < y1 AND j >= x0 AND j < x1 GROUP BY ALL)"""


def cell_images(spark, d):
    """(vec_id, cell, px): each raster's two cells of 8 x 4."""
    g = glyphs(spark, d).select("vec_id", F.transform("px", lambda x: F.round(x, 6)).alias("px"))
    return g.select("vec_id", F.posexplode(F.array(raster.crop(F.col("px"), 8, 0, 0, 4, 8), raster.crop(F.col("px"), 8, 4, 0, 4, 8))).alias("cell", "px"))


def on(profile):
    return F.transform(profile, lambda x: F.round(x, 6) > -0.05)


def line_images(spark, d):
    cells = cell_images(spark, d)
    lines = cells.select("vec_id", "cell", "px", F.inline(signals.long_runs(on(signals.row_profile(F.col("px"), 8, 4)), 2))).withColumnsRenamed({"s": "y0", "e": "y1"})
    return lines.withColumn("px", F.slice("px", F.col("y0") * 4 + 1, (F.col("y1") - F.col("y0")) * 4))


def word_images(spark, d):
    height = F.col("y1") - F.col("y0")
    words = line_images(spark, d).select("vec_id", "cell", "y0", "y1", "px", F.inline(signals.long_runs(on(signals.column_profile(F.col("px"), height, 4)), 2))).withColumnsRenamed({"s": "x0", "e": "x1"})
    return words.withColumn("px", F.filter("px", lambda _, k: (k % 4 >= F.col("x0")) & (k % 4 < F.col("x1"))))


@query(f"WITH {CHAIN} SELECT vec_id, cell, y0, y1 FROM ln")
def cells_to_lines(spark, d):
    c = F.col
    return line_images(spark, d).select("vec_id", c("cell").cast("long").alias("cell"), c("y0").cast("long").alias("y0"), c("y1").cast("long").alias("y1"))


@query(f"WITH {CHAIN} SELECT vec_id, cell, y0, y1, x0, x1 FROM wd")
def lines_to_words(spark, d):
    return word_images(spark, d).select("vec_id", *(F.col(n).cast("long").alias(n) for n in ("cell", "y0", "y1", "x0", "x1")))


@query(f"""WITH {CHAIN}, r AS (SELECT vec_id, cell, y0, x0, min(j) AS s, max(j) + 1 AS e FROM (SELECT *, j - row_number() OVER (PARTITION BY vec_id, cell, y0, x0 ORDER BY j) AS g FROM ch WHERE on_) GROUP BY vec_id, cell, y0, x0, g),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id, cell, y0, x0 ORDER BY s) - 1 AS char FROM r) SELECT vec_id, cell, y0, x0, char, s, e, 'cell_r' || vec_id || '_c' || cell || '_blob_' || (y0 + 1) || '_word_' || (x0 + 1) || '_char_' || lpad(CAST(char AS VARCHAR), 2, '0') || '.png' AS name FROM k""")
def table_to_characters(spark, d):
    """From a raster to cells, lines, words and characters: bounds and key of each character."""
    w = word_images(spark, d).withColumn("n", F.col("x1") - F.col("x0"))
    column = lambda j: F.filter("px", lambda _, k: k % F.col("n") == j)
    states = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.array_max(column(j)) > 0.08)
    found = w.select("vec_id", "cell", "y0", "x0", F.posexplode(signals.long_runs(states, 1)).alias("char", "r"))
    name = keys.char_name(F.col("vec_id"), F.col("cell"), F.col("y0") + 1, F.col("x0") + 1, F.col("char"))
    whole = lambda c, n: F.col(c).cast("long").alias(n)
    at = F.col("x0")
    return found.select("vec_id", whole("cell", "cell"), whole("y0", "y0"), whole("x0", "x0"), whole("char", "char"), (at + F.col("r.s")).cast("long").alias("s"), (at + F.col("r.e")).cast("long").alias("e"), name.alias("name"))


@query(f"""WITH {PX}, q AS (SELECT vec_id, greatest(0, vec_id % 11 - 2) AS x0, least(8, vec_id % 11 + 3) AS x1, greatest(0, vec_id % 7 - 2) AS y0, least(8, vec_id % 7 + 3) AS y1 FROM embeddings)
SELECT q.vec_id, count(*) AS n, round(sum(v), 6) AS ink FROM q JOIN px ON px.vec_id = q.vec_id AND j >= x0 AND j < x1 AND i >= y0 AND i < y1 WHERE x1 - x0 >= 1 AND y1 - y0 >= 1 GROUP BY q.vec_id""")
def clamped_crops(spark, d):
    """A box with a margin of 2 pixels, clamped to the raster; boxes that are empty go."""
    g = glyphs(spark, d).select("vec_id", raster.clamped_crop(F.col("px"), 8, 8, F.col("vec_id") % 11, F.col("vec_id") % 7, F.lit(1), F.lit(1), 2).alias("px"))
    return g.where(F.size("px") > 0).select("vec_id", F.size("px").cast("long").alias("n"), r6(signals.total(F.col("px")), "ink"))


@query(f"""WITH {PX}, o AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 8 WHEN vec_id % 3 = 1 THEN 6 ELSE 4 END AS w FROM embeddings),
s AS (SELECT o.vec_id, o.w, CASE WHEN w > 6 THEN j - (w - 6) // 2 ELSE j + (6 - w) // 2 END AS j, v FROM o JOIN px ON px.vec_id = o.vec_id AND j < o.w AND i >= 1 AND i < 7)
SELECT vec_id, CAST(6 AS BIGINT) AS h, round(sum(v * (j + 1)), 6) AS weighted, CAST(max(greatest(6 - w, 0)) * 6 AS BIGINT) AS white FROM s WHERE j BETWEEN 0 AND 5 GROUP BY vec_id""")
def padded_or_cropped(spark, d):
    """Rasters of width 8, 6 or 4 to 6 x 6: both axes cropped about the middle, the width alone padded with white."""
    w = F.when(F.col("vec_id") % 3 == 0, 8).when(F.col("vec_id") % 3 == 1, 6).otherwise(4)
    g = glyphs(spark, d).withColumn("w", w).withColumn("px", F.filter("px", lambda _, k: k % 8 < F.col("w")))
    fit = g.select("vec_id", raster.pad_or_crop(F.col("px"), F.lit(8), F.col("w"), 6, 1.0).alias("f")).select("vec_id", "f.px", "f.h")
    ink = F.aggregate(F.transform("px", lambda x, k: F.when(x == 1.0, 0.0).otherwise(x * (k % 6 + 1))), F.lit(0.0), lambda s, x: s + x)
    return fit.select("vec_id", F.col("h").cast("long").alias("h"), r6(ink, "weighted"), F.size(F.filter("px", lambda x: x == 1.0)).cast("long").alias("white"))


@query(f"WITH {PX}, m AS (SELECT vec_id, k, v > 0.05 AS a, w > 0.05 AS b FROM (SELECT vec_id, i * 8 + j AS k, v, lead(v, 8) OVER (PARTITION BY vec_id ORDER BY i, j) AS w FROM px)) SELECT vec_id, count(*) FILTER (a OR b) AS either, count(*) FILTER (a AND b) AS crossings FROM m GROUP BY vec_id")
def mask_unions(spark, d):
    """A mask and the same one row up: what either holds, and where both cross."""
    mask = F.transform("px", lambda x: x > 0.05)
    up = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.coalesce(F.get("px", k + 8) > 0.05, F.lit(False)))
    g = glyphs(spark, d).select("vec_id", mask.alias("a"), up.alias("b"))
    on_ = lambda a: F.size(F.filter(a, lambda x: x)).cast("long")
    return g.select("vec_id", on_(raster.mask_or(F.col("a"), F.col("b"))).alias("either"), on_(raster.mask_and(F.col("a"), F.col("b"))).alias("crossings"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: least(greatest(CAST(x AS DOUBLE) * 255 + 128, 0), 255) / 255)) / 64, 6) AS mean_grey FROM embeddings")
def unit_greys(spark, d):
    grey = F.transform("px", lambda x: F.least(F.greatest(x * 255 + 128, F.lit(0.0)), F.lit(255.0)))
    return glyphs(spark, d).select("vec_id", r6(signals.mean(raster.unit(grey)), "mean_grey"))


@query("SELECT p_partkey, (p_size >= 7 OR p_partkey % 12 >= 7) AND p_size / nullif(p_partkey % 12, 0) > 1 AS oversized FROM part WHERE p_partkey % 12 > 0 UNION ALL SELECT p_partkey, false FROM part WHERE p_partkey % 12 = 0")
def oversized_glyphs(spark, d):
    return t(spark, d, "part").select("p_partkey", raster.oversized(F.col("p_partkey") % 12, F.col("p_size")).alias("oversized"))


# -- tokens

#: Tokens that tell the patterns apart; the driver's texts hold few of them.
TOKENS = ["+12.5", "1,234", "-7", "1.", ".5", "12a", "A1", "don't", "(abc)", "...", "ёлка", "Ёж!", "Итого:", "слово-слово", "a_b", "3)", "()", "-", "+", "é", "a b", "", "12,", "1,5", "007", "O'Neil;", "№5", "x2y", "Ab.Cd,ef!?"]


def quoted(values):
    return ", ".join("('" + v.replace("'", "''") + "')" for v in values)


@query(f"""SELECT token, CASE WHEN regexp_full_match(token, '[+-]?\\d+([.,]\\d+)*') THEN 'number' WHEN regexp_full_match(token, '[A-Za-zА-Яа-яЁё.,!?;:()\\-'']+') THEN 'word' ELSE 'other' END AS kind, regexp_full_match(trim(token), '\\d+[.,]?\\d*') AS pure, length(regexp_replace(token, '[^0-9]', '', 'g')) AS digits FROM (VALUES {quoted(TOKENS)}) v(token)""")
def token_rules(spark, d):
    k = F.col("token")
    rows = spark.createDataFrame([(x,) for x in TOKENS], "token string")
    return rows.select(k, tokens.token_type(k).alias("kind"), F.trim(k).rlike(tokens.PURE_NUMBER).alias("pure"), F.length(F.regexp_replace(k, "[^0-9]", "")).cast("long").alias("digits"))


@query("SELECT conv_id, turn, CASE WHEN any_ THEN 'NUMBER' ELSE 'OTHER' END AS label, CASE WHEN any_ THEN 1.0 ELSE p END AS confidence FROM (SELECT conv_id, turn, round(length(text) % 100 / 100.0, 6) AS p, bool_or(contains(lower(text), 'the')) OVER (PARTITION BY conv_id) AS any_ FROM conversations)")
def group_promote_scores(spark, d):
    """If any of a group is a number, all are, with confidence 1."""
    c = t(spark, d, "conversations").select("conv_id", "turn", r6(F.length("text") % 100 / 100.0, "p"), F.lower("text").contains("the").alias("number"))
    return columns.promoted(c, ["conv_id"], F.col("number"), "p").select("conv_id", "turn", "label", F.col("p").alias("confidence"))


# -- evaluation


@query(f"""WITH {MATRIX}, k AS (SELECT c, (SELECT sum(n) FROM cm WHERE truth = c AND predicted = c) AS tp, (SELECT sum(n) FROM cm WHERE truth = c) AS support, (SELECT sum(n) FROM cm WHERE predicted = c) AS said FROM (VALUES (0), (1), (2)) v(c)),
s AS (SELECT *, coalesce(tp / nullif(said, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS r FROM k), f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM s)
SELECT 'macro' AS average, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(f1), 6) AS f1 FROM f UNION ALL SELECT 'weighted', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6) FROM f""")
def report_averages(spark, d):
    s = evaluate.class_scores(evaluate.confusion(judged(spark, d), "truth", "predicted", [0, 1, 2]), "truth", "predicted")
    return evaluate.averages(s).select("average", *(r6(F.col(n), n) for n in ("precision", "recall", "f1")))


@query(f"WITH {JUDGED} SELECT truth, score % 3 IN (0, 2) AS subset, round(avg(CAST(truth = predicted AS INT)), 6) AS accuracy, count(*) AS n FROM jd GROUP BY ALL")
def subset_accuracy(spark, d):
    right = (F.col("truth") == F.col("predicted")).cast("int")
    return judged(spark, d).groupBy("truth", (F.col("score") % 3).isin(0, 2).alias("subset")).agg(r6(F.avg(right), "accuracy"), F.count("*").alias("n"))


@query("SELECT p_brand, CASE WHEN m < 1 THEN 10.0 ELSE m END AS median_width FROM (SELECT p_brand, median(p_size % 3 * (CASE WHEN p_brand LIKE '%1' THEN 0 ELSE 1 END)) AS m FROM part GROUP BY p_brand)")
def median_width_or_ten(spark, d):
    w = F.col("p_size") % 3 * F.when(F.col("p_brand").endswith("1"), 0).otherwise(1)
    m = t(spark, d, "part").groupBy("p_brand").agg(F.median(w).alias("m"))
    return m.select("p_brand", F.when(F.col("m") < 1, 10.0).otherwise(F.col("m")).alias("median_width"))


@query("WITH r AS (SELECT c_nationkey, round(avg(c_acctbal), 6) AS y FROM customer GROUP BY 1) SELECT c_nationkey, y, row_number() OVER (ORDER BY y, c_nationkey) AS place FROM r")
def ordered_by_mean(spark, d):
    """Rows in the order of their points' mean coordinate."""
    r = t(spark, d, "customer").groupBy("c_nationkey").agg(r6(F.avg("c_acctbal"), "y"))
    return r.select("c_nationkey", "y", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("y", "c_nationkey")).cast("long").alias("place"))


NUMERIC = "l_quantity, l_extendedprice, l_discount, l_tax"


@query("""WITH v AS (SELECT l_quantity AS a, l_extendedprice AS b, l_discount AS c, l_tax AS d FROM lineitem),
m AS (SELECT 'l_extendedprice' AS x, 'l_quantity' AS y, corr(a, b) AS r FROM v UNION ALL SELECT 'l_discount', 'l_quantity', corr(a, c) FROM v UNION ALL SELECT 'l_quantity', 'l_tax', corr(a, d) FROM v UNION ALL
SELECT 'l_discount', 'l_extendedprice', corr(b, c) FROM v UNION ALL SELECT 'l_extendedprice', 'l_tax', corr(b, d) FROM v UNION ALL SELECT 'l_discount', 'l_tax', corr(c, d) FROM v) SELECT x, y, round(abs(r), 6) AS r FROM m ORDER BY 3 DESC, 1, 2 LIMIT 4""")
def top_correlations(spark, d):
    """The four pairs of columns that go together most, of all pairs."""
    return columns.correlations(t(spark, d, "lineitem"), NUMERIC.split(", ")).select("x", "y", r6(F.abs("r"), "r")).orderBy(F.desc("r"), "x", "y").limit(4)


@query("""WITH v AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b, rank() OVER (ORDER BY p_partkey) + 0.0 AS c FROM part)
SELECT 'p_retailprice' AS x, 'p_size' AS y, round(corr(a, b), 6) AS r FROM v UNION ALL SELECT 'p_partkey', 'p_size', round(corr(a, c), 6) FROM v UNION ALL SELECT 'p_partkey', 'p_retailprice', round(corr(b, c), 6) FROM v""")
def rank_correlations(spark, d):
    """Spearman: the correlation of ranks, ties sharing their mean rank."""
    return columns.correlations(t(spark, d, "part"), ["p_partkey", "p_retailprice", "p_size"], ranks=True).select("x", "y", r6(F.col("r"), "r"))


# -- columns and sets


@query("SELECT label, k - 1 AS k, round(avg(CAST(embedding[k] AS DOUBLE)), 6) AS mean FROM (SELECT *, unnest(range(1, 65)) AS k FROM embeddings) GROUP BY ALL")
def class_means(spark, d):
    """The mean raster of each class, by place."""
    return glyphs(spark, d).select("label", F.posexplode("px").alias("k", "v")).groupBy("label", F.col("k").cast("long").alias("k")).agg(r6(F.avg("v"), "mean"))


@query("SELECT vec_id, " + ", ".join(f"round(CAST(embedding[{i}] AS DOUBLE), 6) AS avg_{i}" for i in range(1, 9)) + " FROM embeddings")
def array_columns(spark, d):
    return glyphs(spark, d).select("vec_id", *(r6(c, n) for n, c in columns.array_members("px", "avg", 8).items()))


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_partkey, l_suppkey FROM lineitem")
def varying_columns(spark, d):
    """Numeric columns alone, without those that hardly vary."""
    item = t(spark, d, "lineitem").withColumn("same", F.lit(3.0)).withColumn("nearly", F.when(F.col("l_linenumber") == 99, 1.0).otherwise(1.0 + 1e-9))
    return columns.varying(columns.numeric(item))


@query("SELECT event_id, CASE WHEN user_id % 10 IN (0, 1) THEN 0 ELSE value END AS value, user_id % 10 <> 2 AS whole FROM events WHERE user_id % 10 <> 3")
def cleaned_numbers(spark, d):
    """NaN and infinities become 0; rows that lack a value of some columns go."""
    u = F.col("user_id") % 10
    e = t(spark, d, "events").withColumn("x", F.when(u == 0, float("nan")).when(u == 1, float("inf")).otherwise(F.col("value"))).withColumn("y", F.when(u != 3, F.col("value")))
    return columns.finite(e.dropna(subset=["y"]), ["x"]).select("event_id", F.col("x").alias("value"), (u != 2).alias("whole"))


@query("SELECT event_id, " + ", ".join(f"CAST(event_type = '{x}' AS INT) AS is_{x}" for x in ("error", "purchase", "signup", "view")) + " FROM events")
def one_hot(spark, d):
    """A column for each value of a text column but the first."""
    return columns.one_hot(t(spark, d, "events").select("event_id", "event_type"), "event_type", "is")


@query("SELECT DISTINCT n_regionkey AS r, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS child, 'cell_r' || n_regionkey || '_c0_blob_' || row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) || '.png' AS name FROM nation")
def child_numbers(spark, d):
    """Numbers of children within their parent, and the key of each."""
    place = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    n = t(spark, d, "nation").select(F.col("n_regionkey").alias("r"), (place - 1).cast("long").alias("child"))
    return n.select("r", "child", keys.child_name(F.concat(F.lit("cell_r"), F.col("r"), F.lit("_c0.png")), "blob", F.col("child") + 1).alias("name"))


@query("SELECT p_partkey, round_even(p_retailprice * 0.5, 0) AS x, round_even(p_retailprice, 1) AS y, CASE WHEN length(p_name) >= 12 THEN p_name[1:12] || '...' ELSE p_name END AS shown, sqrt(CAST(p_size AS DOUBLE) ^ 2 + CAST(p_partkey AS DOUBLE) ^ 2) AS length FROM part")
def half_even_points(spark, d):
    """Points rounded half to even, and names cut for display."""
    name, x = F.col("p_name"), F.col("p_retailprice")
    return t(spark, d, "part").select("p_partkey", F.bround(x * 0.5, 0).alias("x"), F.bround(x, 1).alias("y"), F.when(F.length(name) >= 12, F.concat(F.left(name, F.lit(12)), F.lit("..."))).otherwise(name).alias("shown"), F.hypot("p_size", "p_partkey").alias("length"))


@query("SELECT vec_id, label, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) % 5 AS fold FROM embeddings")
def stratified_folds(spark, d):
    """Five folds, each class dealt round them."""
    return columns.folds(t(spark, d, "embeddings").select("vec_id", "label"), "label", ["vec_id"], 5)


@query("SELECT c_nationkey, string_agg(seg, ',' ORDER BY first) AS segments FROM (SELECT c_nationkey, c_mktsegment AS seg, min(c_custkey) AS first FROM customer GROUP BY ALL) GROUP BY c_nationkey")
def first_seen(spark, d):
    """Distinct values in the order in which they first come."""
    seen = F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", "c_mktsegment"))), lambda x: x["c_mktsegment"])
    return t(spark, d, "customer").groupBy("c_nationkey").agg(F.array_join(F.array_distinct(seen), ",").alias("segments"))


@query("SELECT p_size AS size, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM part WHERE NOT starts_with(p_name, 'a') GROUP BY p_size")
def size_histogram(spark, d):
    kept = t(spark, d, "part").where(~F.col("p_name").startswith("a"))
    n = kept.groupBy(F.col("p_size").alias("size")).agg(F.count("*").alias("n"))
    return n.select("size", "n", r6(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), "share"))


@query("SELECT a.n_nationkey AS id, b.n_name AS found FROM nation a LEFT JOIN nation b ON b.n_nationkey = a.n_nationkey + 20")
def lookup_by_id(spark, d):
    """The row of an id, or null."""
    a, b = t(spark, d, "nation").select(F.col("n_nationkey").alias("id")), t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("found"))
    return a.join(b, F.col("k") == F.col("id") + 20, "left").select("id", "found")


@query("SELECT DISTINCT l_orderkey AS r, l_linenumber AS c FROM lineitem")
def key_set(spark, d):
    """The distinct (r, c) of keys."""
    name = keys.char_name(F.col("l_orderkey"), F.col("l_linenumber"), F.lit("1"), F.lit("1"), F.lit("0"))
    return keys.cell_set(t(spark, d, "lineitem").select(name.alias("filename"))).select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"))


@query("SELECT x_min, x_max, y_min, y_max FROM (SELECT l_linenumber AS x_min, CAST(l_quantity AS INT) % 13 AS x_max, l_suppkey % 9 AS y_min, l_partkey % 17 AS y_max FROM lineitem) WHERE x_max - x_min >= 5 AND y_max - y_min >= 5")
def sound_boxes(spark, d):
    """Boxes that aren't degenerate and have 5 pixels each way."""
    b = t(spark, d, "lineitem").select(F.col("l_linenumber").alias("x_min"), (F.col("l_quantity").cast("int") % 13).alias("x_max"), (F.col("l_suppkey") % 9).alias("y_min"), (F.col("l_partkey") % 17).alias("y_max"))
    return b.where(raster.sound_box(5))


PIVOT = "WITH best AS (SELECT c_nationkey AS r, c_mktsegment AS c, max(c_acctbal) AS best FROM customer GROUP BY ALL), grid AS (SELECT n_nationkey AS r, c.c, CASE WHEN best IS NULL THEN '' WHEN best > 9000 THEN CAST(CAST(trunc(best) AS INT) AS VARCHAR) ELSE 'WORD' END AS content FROM nation CROSS JOIN (SELECT DISTINCT c_mktsegment AS c FROM customer) c LEFT JOIN best ON best.r = n_nationkey AND best.c = c.c)"


@query(PIVOT + " SELECT 'Row ' || r AS row_label, " + ", ".join(f"max(content) FILTER (c = '{x}') AS {x}" for x in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM grid GROUP BY r")
def whole_grid(spark, d):
    """The whole reconstructed table, a label for each row first: every segment is a column."""
    from gridloom.plans.catalog import grid

    wide = grid(spark, d).groupBy("r").pivot("c").agg(F.max("content"))
    return wide.select(F.concat(F.lit("Row "), F.col("r")).alias("row_label"), *(c for c in wide.columns if c != "r"))


@query("SELECT event_type, map_keys(m)[1] AS some, element_at(m, 'hi')[1] AS hi, CAST(json_extract(to_json({'n': n}), '$.n') AS BIGINT) AS n FROM (SELECT event_type, count(*) AS n, MAP {'hi': round(max(value), 2)} AS m FROM events GROUP BY event_type)")
def maps_and_json(spark, d):
    """A map's keys and values, and a number read back from JSON."""
    g = t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.create_map(F.lit("hi"), F.round(F.max("value"), 2)).alias("m"))
    back = F.from_json(F.to_json(F.struct("n")), "n long")
    return g.select("event_type", F.get(F.map_keys("m"), F.lit(0)).alias("some"), F.col("m")["hi"].alias("hi"), back["n"].alias("n"))


@query("SELECT l_returnflag, count(*) AS n, round(avg(CAST(hash_ AS DOUBLE)), 6) AS mean FROM (SELECT l_returnflag, (l_orderkey * 31 + l_partkey * 17 + 42) % 1000 AS hash_ FROM lineitem) GROUP BY l_returnflag")
def seeded_order(spark, d):
    """The key by which rows are shuffled, the same in every run."""
    return t(spark, d, "lineitem").withColumn("k", columns.shuffle_key(["l_orderkey", "l_partkey"], [31, 17], 42, 1000)).groupBy("l_returnflag").agg(F.count("*").alias("n"), r6(F.avg(F.col("k").cast("double")), "mean"))


@query(f"WITH {EV}, z AS (SELECT user_id, pos, value, lag(value) OVER (PARTITION BY user_id ORDER BY pos) AS b FROM ev) SELECT user_id, count(*) FILTER (b IS NOT NULL AND (value > 50) <> (b > 50)) AS changes FROM z GROUP BY user_id")
def state_changes(spark, d):
    a = F.col("v")
    changes = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.size(a) - 1, F.lit(1))), lambda i: (F.get(a, i) > 50) != (F.get(a, i - 1) > 50)))
    e = t(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))).alias("s"))
    return e.select("user_id", F.col("s.value").alias("v")).select("user_id", changes.cast("long").alias("changes"))


# -- kernels and models


@query()
def edge_densities(spark, d):
    """Canny and Sobel measures of each raster (tested against plain loops over the table)."""
    kernel = lambda a: spectra.edge_density(((a + 0.6) / 1.2).clip(0, 1))
    return glyphs(spark, d).select("vec_id", vision.kernel_column(F.col("px"), 8, 8, spectra.EDGE_DENSITY, kernel).alias("f")).select("vec_id", "f.*")


@query()
def contour_fourier(spark, d):
    """Spectrum of the largest contour's corners (tested against the transform by definition)."""
    return glyphs(spark, d).select("vec_id", vision.kernel_column(F.col("px"), 8, 8, spectra.CONTOUR, lambda a: spectra.contour_spectrum(a > 0.02)).alias("f")).select("vec_id", "f.*")


@query("""WITH u AS (SELECT vec_id, label, k, CAST(embedding[k] AS DOUBLE) AS v FROM (SELECT *, unnest(range(1, 65)) AS k FROM embeddings)), m AS (SELECT label, k, avg(v) AS m FROM u GROUP BY ALL),
s AS (SELECT u.vec_id, m.label AS c, round(sum(u.v * m - m * m / 2), 9) AS s FROM u JOIN m ON u.k = m.k GROUP BY ALL), b AS (SELECT vec_id, CAST(arg_min(c, (-s, c)) AS INT) AS predicted, max(s) AS best FROM s WHERE vec_id % 10 <> 3 GROUP BY vec_id)
SELECT e.vec_id, predicted, round(coalesce(best, 0), 5) AS confidence, CASE WHEN e.vec_id % 10 = 3 THEN '63 values' END AS error FROM embeddings e LEFT JOIN b ON b.vec_id = e.vec_id""")
def batch_scores(spark, d):
    """A linear model (the class means) over batches of rasters; rasters of a wrong size give error rows."""
    means = glyphs(spark, d).groupBy("label").agg(F.array(*(F.avg(F.get("px", F.lit(k))) for k in range(64))).alias("m")).orderBy("label").collect()  # ten classes
    w = np.array([r["m"] for r in means]).T
    df = glyphs(spark, d).select("vec_id", F.when(F.col("vec_id") % 10 == 3, F.slice("px", 1, 63)).otherwise(F.col("px")).alias("px"))
    out = models.scored_batches(df, [(w, -(w * w).sum(0) / 2, "none")], "px", 64)
    return out.select("vec_id", "predicted", F.round("confidence", 5).alias("confidence"), "error")
