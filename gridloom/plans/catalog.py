"""All queries of the library, and the SQL that each is held against.

The driver's tables have no images, so they stand in for them: an embedding is an 8 x 8 raster with its class, line
items are characters of words of cells, events are an ordered signal, documents are token streams, labels are truth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import keys, signals, tokens
from gridloom.operators import evaluate, joins, raster, runs

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def glyphs(spark, d) -> DataFrame:
    return t(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("px"))


def pixels(spark, d) -> DataFrame:
    """(vec_id, label, i, j, v): a row for each pixel."""
    one = glyphs(spark, d).select("vec_id", "label", F.posexplode("px").alias("k", "v"))
    return one.select("vec_id", "label", F.floor(F.col("k") / 8).cast("int").alias("i"), (F.col("k") % 8).cast("int").alias("j"), "v")


PX = "px AS (SELECT vec_id, label, (k - 1) // 8 AS i, (k - 1) % 8 AS j, CAST(embedding[k] AS DOUBLE) AS v FROM (SELECT *, unnest(range(1, 65)) AS k FROM embeddings))"
EV = "ev AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, value > 50 AS state FROM events)"


def r6(c, name):
    return F.round(c, 6).alias(name)


# -- cells from characters

CHARS = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate", "l_tax"]


def cells(spark, d) -> DataFrame:
    item = t(spark, d, "lineitem").withColumn("digit", (F.col("l_quantity").cast("int") % 10).cast("string"))
    words = item.groupBy("l_orderkey", "l_linenumber").agg(F.sort_array(F.collect_list(F.struct(*CHARS, "digit"))).alias("c"), F.avg("l_discount").alias("conf"), F.count("*").alias("n_chars"))
    words = words.withColumn("word", F.array_join(F.col("c.digit"), ""))
    by_cell = words.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "word"))), lambda w: w["word"]), " ").alias("text"), F.round(F.avg("conf"), 6).alias("confidence"), F.count("*").alias("word_count"))
    return by_cell


@query("""WITH w AS (SELECT l_orderkey, l_linenumber, string_agg(CAST(CAST(l_quantity AS INT) % 10 AS VARCHAR), '' ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_shipdate, l_tax) AS word, avg(l_discount) AS conf FROM lineitem GROUP BY ALL)
SELECT l_orderkey, string_agg(word, ' ' ORDER BY l_linenumber) AS text, round(avg(conf), 6) AS confidence, count(*) AS word_count FROM w GROUP BY l_orderkey""")
def reconstruct_cells(spark, d):
    return cells(spark, d)


def grid(spark, d) -> DataFrame:
    """Nation x market segment: the richest customer's balance, WORD where nobody is above 9000, empty where no row is."""
    segments = t(spark, d, "customer").select(F.col("c_mktsegment").alias("c")).distinct()
    full = t(spark, d, "nation").select(F.col("n_nationkey").alias("r")).crossJoin(F.broadcast(segments))
    best = t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("r"), F.col("c_mktsegment").alias("c")).agg(F.max("c_acctbal").alias("best"))
    content = F.when(F.col("best").isNull(), "").when(F.col("best") > 9000, F.col("best").cast("int").cast("string")).otherwise("WORD")
    return full.join(best, ["r", "c"], "left").select("r", "c", content.alias("content"))


GRID = """best AS (SELECT c_nationkey AS r, c_mktsegment AS c, max(c_acctbal) AS best FROM customer GROUP BY ALL),
grid AS (SELECT n_nationkey AS r, c.c, CASE WHEN best IS NULL THEN '' WHEN best > 9000 THEN CAST(CAST(trunc(best) AS INT) AS VARCHAR) ELSE 'WORD' END AS content
FROM nation CROSS JOIN (SELECT DISTINCT c_mktsegment AS c FROM customer) c LEFT JOIN best ON best.r = n_nationkey AND best.c = c.c)"""


@query(f"WITH {GRID} SELECT r, max(content) FILTER (c = 'AUTOMOBILE') AS col_0, max(content) FILTER (c = 'BUILDING') AS col_1, max(content) FILTER (c = 'FURNITURE') AS col_2 FROM grid GROUP BY r")
def reconstruct_grid(spark, d):
    names = ["AUTOMOBILE", "BUILDING", "FURNITURE"]
    wide = grid(spark, d).groupBy("r").pivot("c", names).agg(F.max("content"))
    return wide.select("r", *(F.col(n).alias(f"col_{i}") for i, n in enumerate(names)))


@query(f"""WITH {GRID} SELECT count(*) AS total, count(*) FILTER (content = '') AS empty, count(*) FILTER (content = 'WORD') AS words, count(*) FILTER (content NOT IN ('', 'WORD')) AS numbers,
round(100.0 * count(*) FILTER (content = 'WORD') / count(*), 4) AS word_percent FROM grid""")
def table_statistics(spark, d):
    g, c = grid(spark, d), F.col("content")
    return g.agg(F.count("*").alias("total"), F.count_if(c == "").alias("empty"), F.count_if(c == "WORD").alias("words"), F.count_if(~c.isin("", "WORD")).alias("numbers"), F.round(100.0 * F.count_if(c == "WORD") / F.count("*"), 4).alias("word_percent"))


@query(f"WITH {GRID} SELECT r, c, CASE WHEN content = '' THEN 0 WHEN content = 'WORD' THEN 1 ELSE 2 END AS code, CASE WHEN length(c) >= 9 THEN c[1:6] || '...' ELSE c END AS shown FROM grid")
def cell_codes(spark, d):
    return grid(spark, d).select("r", "c", F.when(F.col("content") == "", 0).when(F.col("content") == "WORD", 1).otherwise(2).alias("code"), F.when(F.length("c") >= 9, F.concat(F.left("c", F.lit(6)), F.lit("..."))).otherwise(F.col("c")).alias("shown"))


@query("""WITH n AS (SELECT 'cell_r' || l_orderkey || '_c' || l_linenumber || '_blob_' || (l_suppkey % 3) || CASE WHEN l_partkey % 2 = 0 THEN '_blob_1' ELSE '' END || '_word_' || (l_partkey % 9) || '_char_' || lpad(CAST(l_suppkey % 20 AS VARCHAR), 2, '0') || '.png' AS name FROM lineitem)
SELECT name, CAST(regexp_extract(name, '^cell_r(\\d+)_', 1) AS INT) AS r, CAST(regexp_extract(name, '_c(\\d+)_blob', 1) AS INT) AS c, replace(regexp_extract(name, '_blob_(\\d+(_blob_\\d+)?)_word', 1), '_blob_', '_') AS blob,
CAST(regexp_extract(name, '_word_(\\d+)_', 1) AS INT) AS word, CAST(regexp_extract(name, '_char_(\\d+)', 1) AS INT) AS ch, split_part(name, '_word', 1) || '.png' AS parent, replace(name, '.png', '') AS stem FROM n""")
def key_parse(spark, d):
    c = F.col
    blob = F.concat((c("l_suppkey") % 3).cast("string"), F.when(c("l_partkey") % 2 == 0, "_blob_1").otherwise(""))
    named = t(spark, d, "lineitem").select(keys.char_name(c("l_orderkey"), c("l_linenumber"), blob, c("l_partkey") % 9, c("l_suppkey") % 20).alias("name"))
    k = named.withColumn("k", keys.parse_key(c("name")))
    return k.select("name", "k.r", "k.c", "k.blob", "k.word", F.col("k.char").alias("ch"), keys.parent_key(c("name")).alias("parent"), keys.stem(c("name")).alias("stem"))


@query("SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base FROM pages")
def basenames(spark, d):
    return t(spark, d, "pages").select("page_id", keys.basename(F.col("url")).alias("base"))


# -- filters, routing, joins


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def semi_numbers(spark, d):
    numbers = t(spark, d, "orders").where("o_orderstatus = 'F'")
    return t(spark, d, "lineitem").join(numbers, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def anti_numbers(spark, d):
    bad = t(spark, d, "lineitem").where("l_returnflag = 'R'")
    return t(spark, d, "orders").join(bad, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey", "o_totalprice")


@query("SELECT event_type, CASE WHEN value > 50 THEN 'NUMBER' ELSE 'OTHER' END AS route, count(*) AS n, round(avg(CASE WHEN value > 50 THEN value ELSE 100 - value END), 6) AS confidence FROM events GROUP BY ALL")
def routed_split(spark, d):
    e = t(spark, d, "events").withColumn("route", tokens.number_or_other(F.col("value"), 50))
    return e.groupBy("event_type", "route").agg(F.count("*").alias("n"), r6(F.avg(F.when(F.col("route") == "NUMBER", F.col("value")).otherwise(100 - F.col("value"))), "confidence"))


@query("SELECT o.o_orderkey, l.l_linenumber, l.l_partkey, l.l_shipdate >= o.o_orderdate AS correct FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey")
def predictions_join_truth(spark, d):
    return t(spark, d, "orders").join(t(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_linenumber", "l_partkey", (F.col("l_shipdate") >= F.col("o_orderdate")).alias("correct"))


@query("""WITH a AS (SELECT l_partkey, l_suppkey, l_quantity FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT l_partkey, l_suppkey, l_quantity FROM lineitem WHERE l_returnflag = 'R')
SELECT a.* FROM a JOIN b ON a.l_partkey IS NOT DISTINCT FROM b.l_partkey AND a.l_suppkey IS NOT DISTINCT FROM b.l_suppkey AND a.l_quantity IS NOT DISTINCT FROM b.l_quantity""")
def leakage_rows(spark, d):
    cols = ["l_partkey", "l_suppkey", "l_quantity"]
    item = t(spark, d, "lineitem")
    a, b = item.where("l_returnflag = 'A'").select(*cols), item.where("l_returnflag = 'R'").select(*(F.col(c).alias(f"b_{c}") for c in cols))
    on = [F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in cols]
    return a.join(b, on[0] & on[1] & on[2]).select(*cols)


@query("""WITH p AS (SELECT c_custkey, c_nationkey, s_suppkey, abs(c_acctbal - s_acctbal) AS dist FROM customer JOIN supplier ON c_nationkey = s_nationkey AND abs(c_acctbal - s_acctbal) <= 2000)
SELECT c_custkey, CAST(arg_min(s_suppkey, (dist, s_suppkey)) AS BIGINT) AS s_suppkey, round(min(dist), 6) AS distance FROM p GROUP BY c_custkey""")
def nearest_band(spark, d):
    c = t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), "c_acctbal")
    s = t(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), "s_acctbal")
    return joins.nearest(c, s, ["nation"], "c_custkey", "s_suppkey", "c_acctbal", "s_acctbal", 2000.0).select("c_custkey", "s_suppkey", r6(F.col("distance"), "distance"))


@query("""SELECT a.o_orderkey, coalesce(m.o_orderkey, f.o_orderkey, -1) AS below FROM orders a
LEFT JOIN LATERAL (SELECT o_orderkey FROM orders b WHERE b.o_custkey = a.o_custkey AND (b.o_orderdate, b.o_orderkey) > (a.o_orderdate, a.o_orderkey) AND b.o_orderstatus = 'F' ORDER BY o_orderdate, o_orderkey LIMIT 1) m ON true
LEFT JOIN LATERAL (SELECT o_orderkey FROM orders b WHERE b.o_custkey = a.o_custkey AND (b.o_orderdate, b.o_orderkey) > (a.o_orderdate, a.o_orderkey) ORDER BY o_orderdate, o_orderkey LIMIT 1) f ON true""")
def first_below(spark, d):
    """The first later order of the customer that is finished; if there is none, the next one."""
    o = joins.first_after(t(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], F.col("o_orderstatus") == "F", "match", "o_orderkey")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.withColumn("next", F.lead("o_orderkey").over(w)).select("o_orderkey", F.coalesce("match", "next", F.lit(-1)).alias("below"))


SPANS = "sp AS (SELECT o_custkey, o_orderkey, epoch(o_orderdate) // 86400 AS y, 30 + CAST(floor(o_totalprice) AS BIGINT) % 300 AS h, CAST(floor(o_totalprice) AS BIGINT) % 977 AS x, o_orderkey % 120 AS w FROM orders)"
PAIRS = """md AS (SELECT o_custkey, CASE WHEN median(w) < 1 THEN 10 ELSE median(w) END AS m FROM sp GROUP BY o_custkey),
pr AS (SELECT a.o_custkey, a.o_orderkey AS a, b.o_orderkey AS b FROM sp a JOIN sp b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey JOIN md ON md.o_custkey = a.o_custkey
WHERE greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) >= 0.45 * least(a.h, b.h) AND CASE WHEN a.x <= b.x THEN b.x - (a.x + a.w) ELSE a.x - (b.x + b.w) END <= 1.5 * m)"""


def spans(spark, d) -> DataFrame:
    """Orders as components: days are heights, the price says where on the line a component stands."""
    day = F.floor(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) / 86400)
    price = F.floor("o_totalprice")
    return t(spark, d, "orders").select("o_custkey", "o_orderkey", day.alias("y"), (30 + price % 300).alias("h"), (price % 977).alias("x"), (F.col("o_orderkey") % 120).alias("w"))


@query(f"WITH {SPANS}, {PAIRS} SELECT * FROM pr")
def overlap_pairs(spark, d):
    return joins.same_line(spans(spark, d), "o_custkey", "o_orderkey", 128.0)


REACH = """ed AS (SELECT o_custkey, a AS x, b AS y FROM pr UNION ALL SELECT o_custkey, b, a FROM pr),
reach(c, x, y) AS (SELECT o_custkey, o_orderkey, o_orderkey FROM sp UNION SELECT r.c, r.x, ed.y FROM reach r JOIN ed ON ed.o_custkey = r.c AND ed.x = r.y)"""


@query(f"WITH RECURSIVE {SPANS}, {PAIRS}, {REACH} SELECT CAST(c AS BIGINT) AS o_custkey, x AS o_orderkey, min(y) AS component FROM reach GROUP BY ALL")
def overlap_components(spark, d):
    s = spans(spark, d)
    return joins.group_components(s, joins.same_line(s, "o_custkey", "o_orderkey", 128.0), "o_custkey", "o_orderkey")


@query(f"""WITH RECURSIVE {SPANS}, {PAIRS}, {REACH}, comp AS (SELECT c, x AS id, min(y) AS component FROM reach GROUP BY ALL)
SELECT component, CAST(min(y) AS BIGINT) AS s, CAST(max(y + h) AS BIGINT) AS e, CAST(min(x) AS BIGINT) AS x0, CAST(max(x + w) AS BIGINT) AS x1, count(*) AS n FROM comp JOIN sp ON id = o_orderkey GROUP BY component""")
def cluster_boxes(spark, d):
    s = spans(spark, d)
    comp = joins.group_components(s, joins.same_line(s, "o_custkey", "o_orderkey", 128.0), "o_custkey", "o_orderkey")
    box = [F.min("y").alias("s"), F.max(F.col("y") + F.col("h")).alias("e"), F.min("x").alias("x0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.count("*").alias("n")]
    return s.join(comp.select("o_orderkey", "component"), "o_orderkey").groupBy("component").agg(*box)


@query("SELECT l_orderkey, l_linenumber, l_partkey, rr, cc FROM lineitem, LATERAL (SELECT unnest(range(l_linenumber, l_linenumber + CAST(l_quantity AS INT) % 3 + 1)) AS rr), LATERAL (SELECT unnest(range(0, CAST(l_suppkey % 2 AS INT) + 1)) AS cc)")
def span_expand(spark, d):
    q = t(spark, d, "lineitem").withColumn("rr", F.explode(F.sequence(F.col("l_linenumber").cast("long"), F.col("l_linenumber") + F.col("l_quantity").cast("long") % 3)))
    return q.withColumn("cc", F.explode(F.sequence(F.lit(0).cast("long"), F.col("l_suppkey") % 2))).select("l_orderkey", "l_linenumber", "l_partkey", "rr", "cc")


@query("""WITH p AS (SELECT p_partkey, p_size AS w, CASE WHEN p_size / 20.0 <= 1 THEN 1 WHEN p_size / 20.0 <= 1.8 THEN 2 ELSE 3 END AS n FROM part)
SELECT p_partkey, i, i * (w // n) AS x0, CASE WHEN i = n - 1 THEN w ELSE (i + 1) * (w // n) END AS x1 FROM (SELECT *, unnest(range(0, n)) AS i FROM p)""")
def glyph_split(spark, d):
    ratio = F.col("p_size") / 20.0
    p = t(spark, d, "part").withColumn("n", F.when(ratio <= 1, 1).when(ratio <= 1.8, 2).otherwise(3).cast("long")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    step = F.expr("p_size div n")
    return p.select("p_partkey", "i", (F.col("i") * step).alias("x0"), F.when(F.col("i") == F.col("n") - 1, F.col("p_size").cast("long")).otherwise((F.col("i") + 1) * step).alias("x1"))


@query("""SELECT s_suppkey, n_nationkey, round((s_acctbal / 1000 + n_nationkey) / 2, 6) AS mid FROM supplier JOIN nation ON s_nationkey % 5 = n_regionkey AND sqrt(power(s_acctbal / 1000 - n_nationkey, 2) + power(s_suppkey % 7 - n_regionkey, 2)) <= 5""")
def distance_join(spark, d):
    s, n = t(spark, d, "supplier"), t(spark, d, "nation")
    x, y = F.col("s_acctbal") / 1000 - F.col("n_nationkey"), F.col("s_suppkey") % 7 - F.col("n_regionkey")
    return s.join(n, (F.col("s_nationkey") % 5 == F.col("n_regionkey")) & (F.sqrt(x * x + y * y) <= 5)).select("s_suppkey", "n_nationkey", r6((F.col("s_acctbal") / 1000 + F.col("n_nationkey")) / 2, "mid"))


@query("SELECT a.n_nationkey AS h, b.n_nationkey AS v, round(CAST(b.n_nationkey - a.n_nationkey AS DOUBLE) / nullif(a.n_regionkey - b.n_regionkey, 0), 6) AS x FROM nation a JOIN nation b ON a.n_regionkey <= b.n_regionkey")
def line_crossings(spark, d):
    """Where y = m1 x + k1 and y = m2 x + k2 meet (region is the slope, nation the offset); null when parallel."""
    a = t(spark, d, "nation").select(F.col("n_nationkey").alias("h"), F.col("n_regionkey").alias("m1"))
    b = t(spark, d, "nation").select(F.col("n_nationkey").alias("v"), F.col("n_regionkey").alias("m2"))
    return a.join(b, F.col("m1") <= F.col("m2")).select("h", "v", r6(F.try_divide((F.col("v") - F.col("h")).cast("double"), F.col("m1") - F.col("m2")), "x"))


# -- runs and clusters


def signal(spark, d) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t(spark, d, "events").withColumn("pos", F.row_number().over(w).cast("long"))


@query(f"""WITH {EV}, g AS (SELECT user_id, pos, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS g FROM ev WHERE state)
SELECT user_id, min(pos) AS s, max(pos) + 1 AS e FROM g GROUP BY user_id, g HAVING count(*) >= 2""")
def islands_runs(spark, d):
    return runs.runs(signal(spark, d), ["user_id"], "pos", F.col("value") > 50, 2)


@query(f"""WITH {EV}, g AS (SELECT user_id, pos, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS g FROM ev WHERE state),
r AS (SELECT user_id, min(pos) AS s, max(pos) + 1 AS e FROM g GROUP BY user_id, g), m AS (SELECT *, CASE WHEN s - lag(e) OVER w < 2 THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY user_id ORDER BY s)),
q AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s) AS k FROM m) SELECT user_id, min(s) AS s, max(e) AS e FROM q GROUP BY user_id, k""")
def merged_runs(spark, d):
    return runs.runs(signal(spark, d), ["user_id"], "pos", F.col("value") > 50, 1, 2)


@query("""WITH l AS (SELECT *, coalesce(CAST(p_retailprice - lag(p_retailprice) OVER w > 5 AS INT), 1) AS new FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey)),
c AS (SELECT *, sum(new) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS cluster FROM l)
SELECT p_brand, CAST(cluster AS BIGINT) AS cluster, count(*) AS n, round(min(p_retailprice), 6) AS lo, round(max(p_retailprice), 6) AS hi FROM c GROUP BY ALL HAVING count(*) >= 3""")
def chain_cluster(spark, d):
    c = runs.chained_clusters(t(spark, d, "part"), ["p_brand"], "p_retailprice", ["p_partkey"], 5.0)
    return c.groupBy("p_brand", "cluster").agg(F.count("*").alias("n"), r6(F.min("p_retailprice"), "lo"), r6(F.max("p_retailprice"), "hi")).where("n >= 3")


def _folded(spark, d, fold):
    sorted_prices = F.array_sort(F.collect_list("p_retailprice"))
    each = t(spark, d, "part").groupBy("p_brand").agg(fold(sorted_prices, 20.0).alias("c")).select("p_brand", F.inline("c"))
    return each.groupBy("p_brand", F.col("g").cast("long").alias("cluster")).agg(F.count("*").alias("n"), r6(F.min("x"), "lo"))


def _fold_sql(moved):
    return f"""WITH RECURSIVE o AS (SELECT p_brand, p_retailprice AS x, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice) AS k FROM part),
f(p_brand, k, x, anchor, n, g) AS (SELECT p_brand, k, x, x, 1.0::DOUBLE, 1::BIGINT FROM o WHERE k = 1 UNION ALL
SELECT o.p_brand, o.k, o.x, CASE WHEN abs(o.x - f.anchor) > 20 THEN o.x ELSE {moved} END, CASE WHEN abs(o.x - f.anchor) > 20 THEN 1.0 ELSE f.n + 1 END, CASE WHEN abs(o.x - f.anchor) > 20 THEN f.g + 1 ELSE f.g END
FROM f JOIN o ON o.p_brand = f.p_brand AND o.k = f.k + 1) SELECT p_brand, g AS cluster, count(*) AS n, round(min(x), 6) AS lo FROM f GROUP BY ALL"""


@query(_fold_sql("f.anchor"))
def anchor_cluster(spark, d):
    return _folded(spark, d, signals.anchored_clusters)


@query(_fold_sql("(f.anchor * f.n + o.x) / (f.n + 1)"))
def mean_cluster(spark, d):
    return _folded(spark, d, signals.running_mean_clusters)


@query(f"""WITH {EV}, z AS (SELECT *, lag(state) OVER w AS before, lead(state) OVER w AS after FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
g AS (SELECT user_id, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS g FROM ev WHERE state), m AS (SELECT user_id, max(n) AS longest FROM (SELECT user_id, g, count(*) AS n FROM g GROUP BY ALL) GROUP BY user_id)
SELECT z.user_id, CAST(count(*) FILTER (state) - count(*) FILTER (NOT state AND NOT coalesce(before, false)) AS INT) AS score, CAST(coalesce(max(longest), 0) AS INT) AS longest, coalesce(max(longest), 0) <= 2 OR (count(*) FILTER (state) - count(*) FILTER (NOT state AND NOT coalesce(before, false)) < 0.3 * count(*) AND coalesce(max(longest), 0) <= 4) AS dropped
FROM z LEFT JOIN m ON z.user_id = m.user_id GROUP BY z.user_id""")
def run_score(spark, d):
    """The clean-cell rule: a signal without a long run of light columns goes."""
    s = t(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", (F.col("value") > 50).alias("on")))).alias("a"))
    s = s.withColumn("r", signals.run_score(F.col("a.on")))
    drop = (F.col("r.longest") <= 2) | ((F.col("r.score") < 0.3 * F.size("a")) & (F.col("r.longest") <= 4))
    return s.select("user_id", "r.score", "r.longest", drop.alias("dropped"))


DAYS = "dd AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1), s AS (SELECT *, 1 AS one FROM dd)"


def days(spark, d) -> DataFrame:
    return t(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("v")).withColumn("one", F.lit(1))


@query(f"""WITH {DAYS}, z AS (SELECT *, lag(v) OVER w AS b, lead(v) OVER w AS a FROM s WINDOW w AS (ORDER BY day)), e AS (SELECT *, coalesce(v > b AND v >= a, false) AS peak, coalesce(v < b AND v <= a, false) AS valley FROM z),
n AS (SELECT *, last_value(CASE WHEN peak THEN v END IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l, first_value(CASE WHEN peak THEN v END IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r FROM e)
SELECT day, peak, valley, CASE WHEN valley AND l IS NOT NULL AND r IS NOT NULL THEN round(greatest(least(l, r) - v, 0), 4) END AS depth FROM n""")
def peaks_valleys(spark, d):
    peak, valley = runs.extrema(["one"], "day", "v")
    w = Window.partitionBy("one").orderBy("day")
    e = days(spark, d).withColumn("peak", peak).withColumn("valley", valley)
    height = F.when(F.col("peak"), F.col("v"))
    left, right = F.last(height, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.first(height, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    between = F.col("valley") & left.isNotNull() & right.isNotNull()  # a valley without a peak on either side has no depth
    return e.select("day", "peak", "valley", F.when(between, F.round(F.greatest(F.least(left, right) - F.col("v"), F.lit(0.0)), 4)).alias("depth"))


@query(f"WITH {DAYS} SELECT day, round(sum(v) OVER (ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 3) AS smooth, round(abs(v - lag(v) OVER (ORDER BY day)), 3) AS change FROM s")
def smoothed_signal(spark, d):
    w = Window.partitionBy("one").orderBy("day")
    return days(spark, d).select("day", F.round(runs.smoothed(None, ["one"], "day", "v", 2), 3).alias("smooth"), F.round(F.abs(F.col("v") - F.lag("v").over(w)), 3).alias("change"))


# -- rasters


@query(f"WITH {PX} SELECT vec_id, j, round(avg(v), 6) AS ink FROM px GROUP BY ALL")
def ink_profile_cols(spark, d):
    return glyphs(spark, d).select("vec_id", F.posexplode(signals.column_profile(F.col("px"), 8, 8)).alias("j", "ink")).select("vec_id", F.col("j").cast("long").alias("j"), r6(F.col("ink"), "ink"))


@query(f"WITH {PX} SELECT vec_id, i, round(avg(v), 6) AS ink FROM px GROUP BY ALL")
def ink_profile_rows(spark, d):
    return glyphs(spark, d).select("vec_id", F.posexplode(signals.row_profile(F.col("px"), 8, 8)).alias("i", "ink")).select("vec_id", F.col("i").cast("long").alias("i"), r6(F.col("ink"), "ink"))


@query(f"""WITH {PX}, p AS (SELECT vec_id, j, avg(v) AS c FROM px GROUP BY ALL), dd AS (SELECT vec_id, c, abs(c - lag(c) OVER (PARTITION BY vec_id ORDER BY j)) AS dc FROM p),
f AS (SELECT vec_id, var_pop(c) AS pv, avg(dc) / (avg(abs(c)) + 1e-9) AS fl, sum(dc) AS l1 FROM dd GROUP BY vec_id)
SELECT px.vec_id, round(avg(CAST(v < 0 AS INT)), 6) AS dark, round(avg(v), 6) AS m1, round(var_pop(v), 6) AS m2, round(sqrt(sum(v * v)), 6) AS magnitude, round(max(pv), 6) AS profile_variance, round(max(fl), 4) AS fluctuation, round(max(l1), 6) AS gradient FROM px JOIN f ON px.vec_id = f.vec_id GROUP BY px.vec_id""")
def features_basic(spark, d):
    px, p = F.col("px"), F.col("p")
    g = glyphs(spark, d).withColumn("p", signals.column_profile(px, 8, 8))
    steps = F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.abs(F.get(p, i) - F.get(p, i - 1)))
    return g.select(
        "vec_id", r6(F.size(F.filter(px, lambda x: x < 0)) / F.size(px), "dark"), r6(signals.mean(px), "m1"), r6(signals.variance(px), "m2"), r6(F.sqrt(signals.total(F.transform(px, lambda x: x * x))), "magnitude"),
        r6(signals.variance(p), "profile_variance"), F.round(signals.fluctuation(p), 4).alias("fluctuation"), r6(signals.total(steps), "gradient"),
    )


@query(f"WITH {PX}, q AS (SELECT vec_id, (i // 4) * 2 + j // 4 AS k, sum(v * v) AS e FROM px GROUP BY ALL) SELECT vec_id, k AS quadrant, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS share FROM q")
def quadrants(spark, d):
    px = F.col("px")
    energy = lambda y, x: signals.total(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.pow(F.get(px, ((F.floor(k / 4) + y) * 8 + k % 4 + x).cast("int")), F.lit(2))))
    e = glyphs(spark, d).select("vec_id", F.array(*(energy(y, x) for y in (0, 4) for x in (0, 4))).alias("e")).withColumn("all", signals.total(F.col("e")))
    return e.select("vec_id", "all", F.posexplode("e").alias("q", "x")).select("vec_id", F.col("q").cast("long").alias("quadrant"), r6(F.col("x") / F.col("all"), "share"))


@query(f"""WITH {PX}, a AS (SELECT vec_id, j // 4 AS half, i // 2 AS q, round(avg(v), 4) AS m FROM px GROUP BY ALL), s AS (SELECT *, coalesce(sign(m - lag(m) OVER w), 1) AS up FROM a WINDOW w AS (PARTITION BY vec_id, half ORDER BY q))
SELECT vec_id, half, q, CAST(sum(up) OVER (PARTITION BY vec_id, half ORDER BY q) AS BIGINT) AS code FROM s""")
def eight_area_code(spark, d):
    area = lambda half, q: F.round(signals.total(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.get(F.col("px"), ((F.floor(k / 4) + 2 * q) * 8 + k % 4 + 4 * half).cast("int")))) / 8, 4)
    halves = F.array(*(F.array(*(area(h, q) for q in range(4))) for h in range(2)))
    g = glyphs(spark, d).select("vec_id", F.posexplode(halves).alias("half", "m"))
    step = lambda i: F.when(i == 0, 1.0).otherwise(F.signum(F.get("m", i) - F.get("m", i - 1)))
    codes = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda q: F.aggregate(F.sequence(F.lit(0), q), F.lit(0.0), lambda s, i: s + step(i)).cast("long"))
    return g.select("vec_id", F.col("half").cast("long").alias("half"), F.posexplode(codes).alias("q", "code")).withColumn("q", F.col("q").cast("long"))


@query(f"""WITH {PX}, b AS (SELECT vec_id, i, j, greatest(v, 0) AS v FROM px), m AS (SELECT vec_id, sum(v) AS m00, sum(j * v) AS m10, sum(i * v) AS m01, sum(j * j * v) AS m20, sum(i * i * v) AS m02, sum(i * j * v) AS m11 FROM b GROUP BY vec_id)
SELECT vec_id, round(m00, 6) AS m00, round(m10 / m00, 6) AS cx, round(m01 / m00, 6) AS cy, round(m20 - m10 * m10 / m00, 5) AS mu20, round(m02 - m01 * m01 / m00, 5) AS mu02, round(m11 - m10 * m01 / m00, 5) AS mu11 FROM m WHERE m00 > 0""")
def moments(spark, d):
    ink = F.transform("px", lambda v: F.greatest(v, F.lit(0.0)))
    j, i = lambda k: k % 8, lambda k: F.floor(k / 8)
    parts = {"m00": lambda k: F.lit(1), "m10": j, "m01": i, "m20": lambda k: j(k) * j(k), "m02": lambda k: i(k) * i(k), "m11": lambda k: i(k) * j(k)}
    g = glyphs(spark, d).select("vec_id", ink.alias("v"))
    weighed = lambda f: signals.total(F.transform("v", lambda v, k: v * f(k)))
    m = g.select("vec_id", *(weighed(f).alias(n) for n, f in parts.items())).where("m00 > 0")
    e = lambda s, n, k=6: F.round(F.expr(s), k).alias(n)
    return m.select("vec_id", e("m00", "m00"), e("m10 / m00", "cx"), e("m01 / m00", "cy"), e("m20 - m10 * m10 / m00", "mu20", 5), e("m02 - m01 * m01 / m00", "mu02", 5), e("m11 - m10 * m01 / m00", "mu11", 5))


@query(f"""WITH {PX} SELECT a.vec_id, round((1 - sum(abs(a.v - b.v)) / 64 + 1 - sum(abs(a.v - c.v)) / 64) / 2, 6) AS symmetry FROM px a JOIN px b ON a.vec_id = b.vec_id AND a.i = b.i AND b.j = 7 - a.j JOIN px c ON a.vec_id = c.vec_id AND a.j = c.j AND c.i = 7 - a.i GROUP BY a.vec_id""")
def symmetry(spark, d):
    return glyphs(spark, d).select("vec_id", r6(raster.flip_symmetry(F.col("px"), 8, 8), "symmetry"))


@query(f"""WITH {PX}, c AS (SELECT unnest(range(2, 6)) AS cy), cc AS (SELECT cy, cx FROM c, (SELECT unnest(range(2, 6)) AS cx)),
e AS (SELECT a.vec_id, cy, cx, round(0.5 * sum(power(a.v - b.v, 2)), 6) AS err FROM cc, px a JOIN px b ON a.vec_id = b.vec_id AND b.i = 2 * cy - a.i AND b.j = 2 * cx - a.j GROUP BY ALL)
SELECT vec_id, arg_min(cy, (err, cy, cx)) AS cy, arg_min(cx, (err, cy, cx)) AS cx, min(err) AS err FROM e GROUP BY vec_id""")
def symmetry_center(spark, d):
    """The centre about which a half turn changes the raster least; first in row order among equals."""
    at = F.sequence(F.lit(0), F.lit(63))

    def error(cy, cx):
        def add(s, k):
            i, j = 2 * cy - F.floor(k / 8).cast("int"), 2 * cx - F.pmod(k, F.lit(8))
            gap = F.get("px", k) - F.get("px", i * 8 + j)
            return s + F.when(i.between(0, 7) & j.between(0, 7), gap * gap).otherwise(0.0)

        return F.round(0.5 * F.aggregate(at, F.lit(0.0), add), 6)

    tries = F.array(*(F.struct(error(cy, cx).alias("err"), F.lit(cy).cast("long").alias("cy"), F.lit(cx).cast("long").alias("cx")) for cy in range(2, 6) for cx in range(2, 6)))
    return glyphs(spark, d).select("vec_id", F.array_min(tries).alias("b")).select("vec_id", "b.cy", "b.cx", "b.err")


@query(f"""WITH {PX}, b AS (SELECT vec_id, least(15, floor((v + 0.6) / 1.2 * 16)) AS bin, count(*) AS n FROM px WHERE v BETWEEN -0.6 AND 0.6 GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY vec_id) AS p FROM b) SELECT vec_id, round(-sum(p * log2(p)) / log2(16), 6) AS entropy FROM s GROUP BY vec_id""")
def entropy_hist(spark, d):
    shares = F.transform("px", lambda v: (v + 0.6) / 1.2)
    return glyphs(spark, d).select("vec_id", signals.histogram_entropy(shares, 16).alias("h")).where("h is not null").select("vec_id", r6(F.col("h"), "entropy"))


@query("""WITH u AS (SELECT vec_id, k - 1 AS c, embedding[k] AS s FROM (SELECT *, unnest(range(1, 65)) AS k FROM embeddings)), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, c) AS n FROM u)
SELECT vec_id, max(c) FILTER (n = 1) AS best, max(c) FILTER (n = 2) AS second, max(c) FILTER (n = 3) AS third, round(CAST(max(s) AS DOUBLE), 4) AS score FROM r GROUP BY vec_id""")
def argmax_top3(spark, d):
    top = signals.top_classes(F.col("px"))
    g = glyphs(spark, d).withColumn("top", top)
    return g.select("vec_id", signals.argmax(F.col("px")).alias("best"), F.get("top", F.lit(1)).cast("long").alias("second"), F.get("top", F.lit(2)).cast("long").alias("third"), F.round(F.array_max("px"), 4).alias("score"))


@query(f"""WITH {PX} SELECT vec_id, min(j) AS x, min(i) AS y, max(j) - min(j) + 1 AS w, max(i) - min(i) + 1 AS h, count(*) AS area, round(count(*) / ((max(j) - min(j) + 1) * (max(i) - min(i) + 1)), 6) AS filled, round(sum(v) FILTER (j < 2), 6) AS left_ink, round(sum(v) FILTER (i > 5), 6) AS bottom_ink FROM px WHERE v > 0 GROUP BY vec_id""")
def ink_box(spark, d):
    at = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.get("px", k) > 0)
    g = glyphs(spark, d).select("vec_id", "px", at.alias("k")).where(F.size("k") > 0)
    g = g.withColumn("xs", F.transform("k", lambda k: k % 8)).withColumn("ys", F.transform("k", lambda k: F.floor(k / 8)))
    low, span = lambda c: F.array_min(c).cast("long"), lambda c: (F.array_max(c) - F.array_min(c) + 1).cast("long")
    some = lambda keep, n: r6(F.when(F.exists("k", keep), signals.total(F.transform(F.filter("k", keep), lambda k: F.get("px", k)))), n)
    w, h, n = span("xs"), span("ys"), F.size("k").cast("long")
    return g.select("vec_id", low("xs").alias("x"), low("ys").alias("y"), w.alias("w"), h.alias("h"), n.alias("area"), r6(n / (w * h), "filled"), some(lambda k: k % 8 < 2, "left_ink"), some(lambda k: k >= 48, "bottom_ink"))


@query(f"""WITH {PX}, r AS (SELECT vec_id, list(round(v, 4) ORDER BY j, 7 - i) AS turned, list(round(CASE WHEN round(v, 4) > 0.2 THEN 1 ELSE v END, 4) ORDER BY i, j) AS masked, list(round(v, 4) ORDER BY i, j) FILTER (i BETWEEN 2 AND 4 AND j BETWEEN 1 AND 5) AS part FROM px GROUP BY vec_id)
SELECT vec_id, round(list_sum(list_transform(turned, lambda x, k: x * k)), 4) AS turned, round(list_sum(list_transform(masked, lambda x, k: x * k)), 4) AS masked, round(list_sum(list_transform(part, lambda x, k: x * k)), 4) AS part FROM r""")
def raster_ops(spark, d):
    """Rotation, masking and cropping, each told by a weighted sum over its result."""
    px = F.transform("px", lambda x: F.round(x, 4))
    told = lambda a, n: F.round(F.aggregate(F.transform(a, lambda x, k: x * (k + 1)), F.lit(0.0), lambda s, x: s + x), 4).alias(n)
    g = glyphs(spark, d).withColumn("px", px)
    return g.select("vec_id", told(raster.rotate_clockwise(F.col("px"), 8, 8), "turned"), told(raster.mask_light(F.col("px"), 0.2), "masked"), told(raster.crop(F.col("px"), 8, 1, 2, 5, 3), "part"))


@query()
def ink_components(spark, d):
    """Connected components of each raster's ink (tested against a plain search)."""
    g = glyphs(spark, d).select("vec_id", raster.components_of(F.col("px"), 8, 8, 0.05, 2).alias("b"))
    return g.select("vec_id", F.inline("b"))


# -- text


def token_list():
    """The tokens of a text, in its row: no shuffle is needed to count them."""
    return F.filter(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "), lambda k: k != "")


def words(spark, d) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", F.explode(token_list()).alias("token"))


TOK = "tk AS (SELECT doc_id, unnest(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS token FROM documents), ty AS (SELECT doc_id, token, CASE WHEN regexp_full_match(token, '[+-]?\\d+([.,]\\d+)*') THEN 'number' WHEN regexp_full_match(token, '[A-Za-zА-Яа-яЁё.,!?;:()\\-'']+') THEN 'word' ELSE 'other' END AS kind FROM tk WHERE token <> '')"


@query(f"WITH {TOK} SELECT kind, count(*) AS n FROM ty GROUP BY kind")
def token_types(spark, d):
    return words(spark, d).groupBy(tokens.token_type(F.col("token")).alias("kind")).agg(F.count("*").alias("n"))


@query(f"""WITH {TOK}, c AS (SELECT d.doc_id, count(kind) FILTER (kind = 'word') AS w, count(kind) FILTER (kind = 'number') AS n, count(kind) FILTER (kind = 'other') AS o FROM documents d LEFT JOIN ty ON d.doc_id = ty.doc_id GROUP BY d.doc_id)
SELECT doc_id, w, n, o, CASE WHEN w + n + o = 0 THEN 'none' WHEN w > n AND w >= o THEN 'words' WHEN n > w AND n >= o THEN 'numbers' WHEN w = 0 AND n = 0 AND o > 0 THEN 'other' ELSE 'mixed' END AS dominant FROM c""")
def dominant_type(spark, d):
    kinds = F.transform(token_list(), tokens.token_type)
    count = lambda k: F.size(F.filter("k", lambda x: x == k)).cast("long")
    n = t(spark, d, "documents").select("doc_id", F.coalesce(kinds, F.array().cast("array<string>")).alias("k")).select("doc_id", count("word").alias("w"), count("number").alias("n"), count("other").alias("o"))
    return n.withColumn("dominant", tokens.dominant(F.col("w"), F.col("n"), F.col("o")))


@query(f"""WITH {TOK}, e AS (SELECT doc_id, token, regexp_replace(token, '[^\\d.,]', '', 'g') AS cl FROM ty),
c AS (SELECT doc_id, count(*) FILTER (regexp_matches(cl, '\\d')) AS cn, count(*) FILTER (regexp_matches(token, '[a-zA-Zа-яА-Я]{{4,}}') OR length(token) >= 5 AND regexp_matches(token, '[a-zA-Zа-яА-Я]{{3,}}')) AS mw, count(*) FILTER (regexp_full_match(trim(token), '\\d+[.,]?\\d*')) AS pure, count(*) AS n, round(sum(length(regexp_replace(token, '[^0-9]', '', 'g'))) / sum(length(token)), 6) AS ratio FROM e GROUP BY doc_id),
x AS (SELECT doc_id, count(DISTINCT dg) AS dist FROM (SELECT doc_id, unnest(regexp_extract_all(token, '[0-9]')) AS dg FROM ty) GROUP BY doc_id)
SELECT c.doc_id, cn, coalesce(dist, 0) AS digits, mw, pure, CASE WHEN n = 0 THEN 'EMPTY' WHEN cn >= 5 THEN 'NUMBER' WHEN mw >= 3 THEN 'TEXT' WHEN coalesce(dist, 0) = 1 AND cn >= 3 THEN 'NUMBER' WHEN mw >= 2 AND cn <= 2 THEN 'TEXT' WHEN cn >= 3 AND mw = 0 THEN 'NUMBER' WHEN mw >= 1 AND cn <= 2 THEN 'TEXT' WHEN pure >= 2 AND mw = 0 THEN 'NUMBER' WHEN ratio >= .6 AND mw = 0 THEN 'NUMBER' WHEN ratio <= .3 AND mw >= 1 THEN 'TEXT' WHEN cn >= 2 AND mw = 0 THEN 'NUMBER' ELSE 'TEXT' END AS kind
FROM c LEFT JOIN x ON c.doc_id = x.doc_id""")
def cell_types(spark, d):
    x = F.col("k")
    letters = lambda k: k.rlike(tokens.LONG_LETTERS) | ((F.length(k) >= 5) & k.rlike(tokens.SOME_LETTERS))
    n = lambda test: F.size(F.filter(x, test)).cast("long")
    total = lambda f: F.aggregate(x, F.lit(0).cast("long"), lambda s, k: s + f(k))
    digits = F.size(F.array_distinct(F.flatten(F.transform(x, lambda k: F.regexp_extract_all(k, F.lit("([0-9])")))))).cast("long")
    counted = t(spark, d, "documents").select("doc_id", token_list().alias("k")).where(F.size("k") > 0).select(
        "doc_id", n(lambda k: tokens.clean_number(k).rlike(r"\d")).alias("cn"), digits.alias("digits"), n(letters).alias("mw"), n(lambda k: F.trim(k).rlike(tokens.PURE_NUMBER)).alias("pure"),
        F.size(x).alias("__n"), F.round(total(lambda k: F.length(F.regexp_replace(k, "[^0-9]", ""))) / total(F.length), 6).alias("__r"),
    )
    c = F.col
    return counted.select("doc_id", "cn", "digits", "mw", "pure", tokens.cell_type(c("cn"), c("digits"), c("mw"), c("pure"), c("__r"), c("__n")).alias("kind"))


@query("SELECT conv_id, turn, role, bool_or(contains(lower(text), 'the')) OVER (PARTITION BY conv_id) AS promoted FROM conversations")
def group_promote(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", "role", F.bool_or(F.lower("text").contains("the")).over(Window.partitionBy("conv_id")).alias("promoted"))


@query("SELECT count(*) FILTER (regexp_matches(text, '[A-Z]')) AS upper, count(DISTINCT upper(lang)) AS langs, CAST(sum(length(trim(text))) AS BIGINT) AS chars, max(length(replace(text, ' ', ''))) AS longest FROM documents")
def string_functions(spark, d):
    return t(spark, d, "documents").agg(F.count_if(F.col("text").rlike("[A-Z]")).alias("upper"), F.count_distinct(F.upper("lang")).alias("langs"), F.sum(F.length(F.trim("text"))).alias("chars"), F.max(F.length(F.replace("text", F.lit(" "), F.lit("")))).cast("long").alias("longest"))


@query("SELECT b.item_id, count(*) AS n FROM benchmark b JOIN (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM documents) v ON list_contains(string_split(b.text, ' '), v.word) GROUP BY b.item_id")
def vocabulary_hits(spark, d):
    vocabulary = t(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("word")).distinct()
    asked = t(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
    return asked.join(vocabulary, "word", "left_semi").groupBy("item_id").agg(F.count("*").alias("n"))


# -- evaluation and statistics


def judged(spark, d) -> DataFrame:
    """Truth, and a made-up prediction from the text's length and id."""
    doc = t(spark, d, "documents").select("doc_id", "n_chars")
    return t(spark, d, "labels").join(doc, "doc_id").select("doc_id", F.col("quality").cast("int").alias("truth"), (F.col("n_chars") % 5 > 0).cast("int").alias("predicted"), (F.col("n_chars") % 101).alias("score"))


JUDGED = "jd AS (SELECT doc_id, quality AS truth, CAST(n_chars % 5 > 0 AS INT) AS predicted, n_chars % 101 AS score FROM labels JOIN documents USING (doc_id))"
MATRIX = f"{JUDGED}, cm AS (SELECT a.c AS truth, b.c AS predicted, count(jd.doc_id) AS n FROM (VALUES (0), (1), (2)) a(c) CROSS JOIN (VALUES (0), (1), (2)) b(c) LEFT JOIN jd ON truth = a.c AND predicted = b.c GROUP BY ALL)"


@query(f"WITH {MATRIX} SELECT * FROM cm")
def confusion(spark, d):
    return evaluate.confusion(judged(spark, d), "truth", "predicted", [0, 1, 2])


@query(f"""WITH {MATRIX}, k AS (SELECT c, (SELECT sum(n) FROM cm WHERE truth = c AND predicted = c) AS tp, (SELECT sum(n) FROM cm WHERE truth = c) AS support, (SELECT sum(n) FROM cm WHERE predicted = c) AS said FROM (VALUES (0), (1), (2)) v(c)),
s AS (SELECT *, coalesce(tp / nullif(said, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS r FROM k) SELECT c AS class, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1, CAST(support AS BIGINT) AS support FROM s""")
def class_report(spark, d):
    s = evaluate.class_scores(evaluate.confusion(judged(spark, d), "truth", "predicted", [0, 1, 2]), "truth", "predicted")
    return s.select("class", r6(F.col("precision"), "precision"), r6(F.col("recall"), "recall"), r6(F.col("f1"), "f1"), "support")


@query(f"WITH {JUDGED} SELECT count(*) AS total, round(avg(CAST(truth = predicted AS INT)), 6) AS accuracy, round(avg(score), 6) AS mean_score, round(stddev_pop(score), 6) AS std_score, round(avg(score) FILTER (truth = predicted), 6) AS mean_right, round(avg(score) FILTER (truth <> predicted), 6) AS mean_wrong, count(*) FILTER (truth = 1 AND predicted = 0) AS one_as_zero FROM jd")
def summary(spark, d):
    right, s = F.col("truth") == F.col("predicted"), F.col("score")
    return judged(spark, d).agg(F.count("*").alias("total"), r6(F.avg(right.cast("int")), "accuracy"), r6(F.avg(s), "mean_score"), r6(F.stddev_pop(s), "std_score"), r6(F.avg(F.when(right, s)), "mean_right"), r6(F.avg(F.when(~right, s)), "mean_wrong"), F.count_if((F.col("truth") == 1) & (F.col("predicted") == 0)).alias("one_as_zero"))


@query(f"WITH {JUDGED}, g AS (SELECT score, sum(truth) AS p, sum(1 - truth) AS q FROM jd GROUP BY score) SELECT score, CAST(sum(p) OVER (ORDER BY score DESC) AS BIGINT) AS tp, CAST(sum(q) OVER (ORDER BY score DESC) AS BIGINT) AS fp FROM g")
def roc_points(spark, d):
    return evaluate.roc(judged(spark, d), "truth", "score")


@query(f"WITH {JUDGED}, r AS (SELECT truth, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM jd) SELECT round((sum(rk) FILTER (truth = 1) - sum(truth) * (sum(truth) + 1) / 2.0) / (sum(truth) * (count(*) - sum(truth))), 6) AS auc FROM r")
def roc_auc(spark, d):
    return evaluate.auc(judged(spark, d), "truth", "score").select(r6(F.col("auc"), "auc"))


@query("SELECT l_returnflag, f.name AS feature, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, min(x) AS lo, max(x) AS hi FROM (UNPIVOT (SELECT l_returnflag, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME name VALUE x) f GROUP BY ALL")
def feature_stats(spark, d):
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    long = t(spark, d, "lineitem").select("l_returnflag", *cols).unpivot(["l_returnflag"], cols, "feature", "x")
    return long.groupBy("l_returnflag", "feature").agg(F.round(F.avg("x"), 4).alias("mean"), F.round(F.stddev_samp("x"), 4).alias("std"), F.min("x").alias("lo"), F.max("x").alias("hi"))


@query("SELECT round(abs(corr(l_quantity, l_extendedprice)), 6) AS quantity_price, round(abs(corr(l_quantity, l_discount)), 6) AS quantity_discount, round(abs(corr(l_extendedprice, l_tax)), 6) AS price_tax FROM lineitem")
def corr_pairs(spark, d):
    c = lambda a, b, n: r6(F.abs(F.corr(a, b)), n)
    return t(spark, d, "lineitem").agg(c("l_quantity", "l_extendedprice", "quantity_price"), c("l_quantity", "l_discount", "quantity_discount"), c("l_extendedprice", "l_tax", "price_tax"))


@query(f"WITH {PX}, c AS (SELECT i * 8 + j AS k, round(corr(v, label), 6) AS r FROM px GROUP BY ALL) SELECT k, r FROM c ORDER BY abs(r) DESC, k LIMIT 10")
def label_corr(spark, d):
    """The ten pixels that go with the class most closely."""
    c = pixels(spark, d).groupBy((F.col("i") * 8 + F.col("j")).cast("long").alias("k")).agg(r6(F.corr("v", F.col("label").cast("double")), "r"))
    return c.orderBy(F.desc(F.abs("r")), "k").limit(10)


@query("SELECT l_returnflag, median(l_quantity) AS median_width, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def median_width(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.median("l_quantity").alias("median_width"), F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice AS area FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS k FROM lineitem) WHERE k = 1")
def largest_component(spark, d):
    best = F.max_by(F.struct("l_linenumber", "l_extendedprice"), F.struct("l_extendedprice", -F.col("l_linenumber")))
    return t(spark, d, "lineitem").groupBy("l_orderkey").agg(best.alias("b")).select("l_orderkey", "b.l_linenumber", F.col("b.l_extendedprice").alias("area"))


@query("SELECT event_type, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM events GROUP BY event_type")
def value_counts(spark, d):
    n = t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return n.select("event_type", "n", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias("share"))


@query("SELECT count(*) FILTER (text IS NULL) AS text, count(*) FILTER (lang IS NULL) AS lang, count(DISTINCT lang) < 2 AS lang_constant, count(DISTINCT source) < 2 AS source_constant, stddev_samp(n_chars) > 1e-6 AS n_chars_varies FROM documents")
def column_checks(spark, d):
    return t(spark, d, "documents").agg(F.count_if(F.col("text").isNull()).alias("text"), F.count_if(F.col("lang").isNull()).alias("lang"), (F.count_distinct("lang") < 2).alias("lang_constant"), (F.count_distinct("source") < 2).alias("source_constant"), (F.stddev_samp("n_chars") > 1e-6).alias("n_chars_varies"))


@query("SELECT max(p_size) AS widest, arg_max(p_partkey, (p_size, -p_partkey)) AS widest_part, round(avg(p_size), 6) AS mean_width, count(DISTINCT p_size) AS sizes FROM part")
def size_census(spark, d):
    return t(spark, d, "part").agg(F.max("p_size").alias("widest"), F.max_by("p_partkey", F.struct("p_size", -F.col("p_partkey"))).alias("widest_part"), r6(F.avg("p_size"), "mean_width"), F.count_distinct("p_size").alias("sizes"))


@query("SELECT label, round(avg(m), 6) AS mean_of_means, round(stddev_pop(m), 6) AS std_of_means, round(min(m), 6) AS lo, round(max(m), 6) AS hi FROM (SELECT label, list_avg(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS m FROM embeddings) GROUP BY label")
def set_stats(spark, d):
    m = glyphs(spark, d).select("label", signals.mean(F.col("px")).alias("m"))
    return m.groupBy("label").agg(r6(F.avg("m"), "mean_of_means"), r6(F.stddev_pop("m"), "std_of_means"), r6(F.min("m"), "lo"), r6(F.max("m"), "hi"))


# -- order, sampling, sets


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def drop_duplicate_rows(spark, d):
    return t(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").dropDuplicates()


@query("SELECT vec_id, label, k <= 0.8 * n AS train FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM embeddings)")
def stratified_split(spark, d):
    w = Window.partitionBy("label")
    return t(spark, d, "embeddings").select("vec_id", "label", (F.row_number().over(w.orderBy("vec_id")) <= 0.8 * F.count("*").over(w)).alias("train"))


@query("SELECT label, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k, min(n) OVER () AS least FROM (SELECT *, count(*) OVER (PARTITION BY label) AS n FROM embeddings)) WHERE k <= least")
def trim_groups(spark, d):
    return runs.trimmed_groups(t(spark, d, "embeddings"), "label", ["vec_id"]).select("label", "vec_id")


@query("SELECT label, vec_id, copy FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings), LATERAL (SELECT unnest(range(1, CASE WHEN label IN (0, 3, 5, 8) AND k <= 50 THEN 4 ELSE 2 END)) AS copy)")
def boosted_classes(spark, d):
    """The first 50 of each class that is often confused count three times."""
    k = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    e = t(spark, d, "embeddings").select("label", "vec_id", k.alias("k"))
    times = F.when(F.col("label").isin(0, 3, 5, 8) & (F.col("k") <= 50), 3).otherwise(1).cast("long")
    return e.select("label", "vec_id", F.explode(F.sequence(F.lit(1).cast("long"), times)).alias("copy"))


@query("SELECT name, row_number() OVER (ORDER BY name) AS place FROM (SELECT 'cell_r' || n_nationkey || '_c' || n_regionkey || '.png' AS name FROM nation)")
def lexical_order(spark, d):
    n = t(spark, d, "nation").select(F.concat(F.lit("cell_r"), F.col("n_nationkey"), F.lit("_c"), F.col("n_regionkey"), F.lit(".png")).alias("name"))
    return n.select("name", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("name")).cast("long").alias("place"))


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def top_rows(spark, d):
    return t(spark, d, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(10)


@query("SELECT 'customer' AS kind, c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_nationkey, s_acctbal FROM supplier")
def union_rows(spark, d):
    c = t(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    return c.unionByName(t(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance")))


@query("SELECT row_number() OVER (ORDER BY n_name) AS k, n_name AS expected, r.r_name AS got FROM nation LEFT JOIN (SELECT row_number() OVER (ORDER BY r_name) AS k, r_name FROM region) r ON r.k = (SELECT count(*) FROM nation m WHERE m.n_name <= nation.n_name)")
def positional_zip(spark, d):
    place = lambda c: F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(c)).cast("long").alias("k")
    a, b = t(spark, d, "nation").select(place("n_name"), F.col("n_name").alias("expected")), t(spark, d, "region").select(place("r_name"), F.col("r_name").alias("got"))
    return a.join(b, "k", "left")


@query("SELECT event_type, to_json({'n': count(*), 'hi': round(max(value), 2)}) AS report FROM events GROUP BY event_type")
def json_report(spark, d):
    g = t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.max("value"), 2).alias("hi"))
    return g.select("event_type", F.to_json(F.struct("n", "hi")).alias("report"))


# -- learning


def _vectors(spark, d):
    from pyspark.ml.functions import array_to_vector

    return glyphs(spark, d).select("vec_id", F.col("label").cast("double").alias("label"), array_to_vector("px").alias("features"))


@query("""WITH u AS (SELECT vec_id, k, CAST(embedding[k] AS DOUBLE) AS v FROM (SELECT *, unnest(range(1, 65)) AS k FROM embeddings)), s AS (SELECT k, avg(v) AS m, stddev_pop(v) AS sd FROM u GROUP BY k)
SELECT vec_id, round(sum((v - m) / sd), 4) AS z FROM u JOIN s ON u.k = s.k GROUP BY vec_id""")
def standard_scaler(spark, d):
    """Each pixel less its mean, over its population deviation; told by the sum over the raster."""
    p = pixels(spark, d).withColumn("k", F.col("i") * 8 + F.col("j"))
    s = p.groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"))
    return p.join(F.broadcast(s), "k").groupBy("vec_id").agg(F.round(F.sum((F.col("v") - F.col("m")) / F.col("sd")), 4).alias("z"))


@query("SELECT event_id, dense_rank() OVER (ORDER BY event_type) - 1 AS code FROM events")
def label_encoder(spark, d):
    e = t(spark, d, "events")
    codes = e.select("event_type").distinct().withColumn("code", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("event_type")) - 1).cast("long"))
    return e.join(codes, "event_type").select("event_id", "code")  # distinct values may be many: the planner broadcasts them if they are few


@query()
def logistic_regression(spark, d):
    from pyspark.ml.classification import LogisticRegression

    df = _vectors(spark, d)
    return LogisticRegression(maxIter=30).fit(df).transform(df).select("vec_id", "label", "prediction")


@query()
def random_forest(spark, d):
    from pyspark.ml.classification import RandomForestClassifier

    df = _vectors(spark, d)
    return RandomForestClassifier(numTrees=20, seed=42).fit(df).transform(df).select("vec_id", "label", "prediction")
