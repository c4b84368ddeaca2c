"""Mixing sources to target weights. DataFrame functions only.

Sizes are word counts. Targets are shares of all words by weight, stopped at ``most`` times a source's size, with the
excess shared anew by weight until no target is above its stop. Documents get a hash-random key and are range-sorted
by it within their source: the key's range is cut into as many ranges as the source needs, each range is a window of
its own, and a prefix sum over the ranges' totals gives every document the words before it. Whole epochs are taken
first; the rest of the budget is cut out of that order exactly, through the middle of a document if need be.

Defined results: a null text has size 0; sources go by code point (UTF-8 order), null last as one source; size-0
documents take 0; with no words at all every target is 0. Rows that repeat a doc_id are rows of their own; ties of
the key go by doc_id and size, and rows equal in those are equal in what they may take, one after the other. The key
is a hash of doc_id and text, so reruns agree. Budgets are targets rounded to whole words. Other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import WORD_RE, join_skewed, materialize, sheltered, small_enough

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
RANGE_ROWS = 1_000
COARSE = 1_024
SOURCES_AT_ONCE = 50_000


def n_words(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def in_order(rows: DataFrame, order: list, sums: list) -> DataFrame:
    """rows, and as __before_<c> the sum of column c over the rows before. Rows are dealt to ranges of the order, so that no
    window holds more than a range, or one row for each range."""
    parts = -(-rows.count() // SOURCES_AT_ONCE) or 1
    dealt = rows.repartitionByRange(parts, *order) if parts > 1 else rows.coalesce(1)
    dealt = materialize(dealt.withColumn("__part", F.spark_partition_id()))
    up = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("__part").agg(*(F.sum(c).alias(f"__sum_{c}") for c in sums))
    offsets = totals.select("__part", *(F.coalesce(F.sum(f"__sum_{c}").over(up), F.lit(0)).alias(f"__up_{c}") for c in sums))
    inner = dealt.select("*", *(F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"__in_{c}") for c in sums))
    return inner.join(offsets, "__part").select(*rows.columns, *((F.col(f"__up_{c}") + F.col(f"__in_{c}")).alias(f"__before_{c}") for c in sums))


def targets(sources: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, docs) -> the same with target (double). sources: materialised.

    Stops are reached in the order of size over weight: with s and w summed over the sources from one on, and the
    stops before it met in full, that source and all after it share what remains, (all - most * sizes before) / w for
    each weight, if this doesn't exceed most * size / weight. The first source for which it holds sets the share."""
    name = [F.col("source").isNull(), F.col("source")]
    placed = in_order(sources.withColumn("__one", F.lit(1)), name, ["__one"])
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("__before___one") % len(weights) + 1).cast("int"))
    weighed = materialize(placed.withColumn("__w", weight).withColumn("__full", F.col("source_size") / weight).drop("__one", "__before___one"))
    whole = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("s"), F.coalesce(F.sum("__w"), F.lit(0.0)).alias("w")).first()  # two numbers
    shared = in_order(weighed, [F.col("__full"), *name], ["source_size", "__w"])
    share = (F.lit(whole["s"]) - most * F.col("__before_source_size")) / (F.lit(whole["w"]) - F.col("__before___w"))
    free = shared.withColumn("__share", share).where(F.col("__share") <= most * F.col("__full"))
    level = free.agg(F.min_by("__share", F.struct("__full", F.col("source").isNull().alias("n"), "source"))).first()[0]  # one number
    stop = (most * F.col("source_size")).cast("double")
    return weighed.select("source", "source_size", "docs", F.least(stop, F.lit(level) * F.col("__w") if level is not None else stop).alias("target"))


def prefix_sums(totals: DataFrame) -> DataFrame:
    """(__source, __range, __n) -> (__source, __range, __start): the sum of __n before each range, in two levels, so
    that no window holds more than COARSE ranges, or more than one row for each COARSE of them."""
    totals = materialize(totals.withColumn("__coarse", F.expr(f"__range div {COARSE}")))
    fine = Window.partitionBy("__source", "__coarse").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    wide = Window.partitionBy("__source").orderBy("__coarse").rowsBetween(Window.unboundedPreceding, -1)
    coarse = totals.groupBy("__source", "__coarse").agg(F.sum("__n").alias("__n"))
    coarse = coarse.select(F.col("__source").alias("__s"), F.col("__coarse").alias("__c"), F.coalesce(F.sum("__n").over(wide), F.lit(0)).alias("__up"))
    inner = totals.withColumn("__in", F.coalesce(F.sum("__n").over(fine), F.lit(0)))
    both = inner.join(coarse, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__coarse") == F.col("__c")))
    return both.select("__source", "__range", (F.col("__up") + F.col("__in")).alias("__start"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """(doc_id, __key, source, size, source_size, target, taken), one row for each row of docs (doc_id, text, source)."""
    key = F.xxhash64(F.lit(seed), "doc_id", F.xxhash64(F.coalesce("text", F.lit("")))).alias("__key")
    sized = materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    aims = targets(materialize(sources), weights, most).withColumn("__budget", F.round("target").cast("long"))
    aims = materialize(aims.withColumn("__ranges", F.ceil(F.col("docs") / RANGE_ROWS).cast("long")).withColumnRenamed("source", "__s"))
    # the key's upper 32 bits, spread over the source's ranges in order; a source with many documents is joined by broadcast
    dealt = join_skewed(sized, aims, {"source": "__s"}, "docs", sized.count()).withColumnRenamed("source", "__source").withColumn("__range", F.expr("((shiftright(__key, 32) + 2147483648) * __ranges) div 4294967296"))
    totals = dealt.groupBy("__source", "__range").agg(F.sum("size").alias("__n"))
    starts = materialize(prefix_sums(totals)).withColumnsRenamed({"__source": "__s", "__range": "__r"})
    within = Window.partitionBy("__source", "__range").orderBy("__key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("__before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(
        small_enough(starts, 50_000), F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__range") == F.col("__r"))
    )
    epochs = F.when(F.col("source_size") > 0, F.expr("__budget div source_size")).otherwise(0)
    rest = F.col("__budget") - epochs * F.col("source_size")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("__start") - F.col("__before")))
    return placed.select("doc_id", "__key", F.col("__source").alias("source"), "size", "source_size", "target", (epochs * F.col("size") + cut).cast("long").alias("taken"))


def numbered(rows: DataFrame, keys: list) -> DataFrame:
    """rows with __place: 0, 1, ... among the rows that are equal in keys. No window holds more than the rows of one
    written partition, or one row for each partition, so that keys may be hot."""
    rows = materialize(rows.withColumn("__part", F.shiftrightunsigned(F.monotonically_increasing_id(), 33)).withColumn("__row", F.monotonically_increasing_id()))
    counts = rows.groupBy(*keys, "__part").agg(F.count("*").alias("__c"))
    before = counts.withColumn("__up", F.coalesce(F.sum("__c").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__c")
    inner = rows.withColumn("__in", F.row_number().over(Window.partitionBy(*keys, "__part").orderBy("__row")) - 1)
    on = inner["__part"] == before["__part"]
    for k in keys:
        on = on & inner[k].eqNullSafe(before[k])
    return inner.join(before, on).select(*(inner[c] for c in rows.columns if c not in ("__part", "__row")), (F.col("__up") + F.col("__in")).alias("__place"))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """docs as the mix takes them: a document for each whole or part epoch it is in, the part cut after its words.

    Columns are those of docs; n_chars, if there is one, is counted anew for a cut text. Of rows equal in doc_id, text
    and source each takes all epochs, and one after the other, as they are numbered, what the cut leaves them."""
    own = ("__key", "__taken", "__size", "__rows", "__id", "__k", "__s", "__copy", "__place", "__part", "__row", "__in", "__up", "__c")
    taken = materialize(mix_sources(docs, weights, most, seed).groupBy("doc_id", "__key", "source").agg(F.sum("taken").alias("__taken"), F.max("size").alias("__size"), F.count("*").alias("__rows")))
    away, back = sheltered(docs, own)
    key = F.xxhash64(F.lit(seed), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))))
    right = taken.where("__taken > 0").withColumnsRenamed({"doc_id": "__id", "__key": "__k", "source": "__s"})
    joined = away.withColumn("__key", key).join(right, (F.col("__key") == F.col("__k")) & F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__s")))
    if taken.where("__taken > 0 and __rows > 1").limit(1).count():
        again = numbered(joined.where("__rows > 1"), ["__k", "__id", "__s"])
        whole = F.expr("__taken div (__rows * __size)")  # epochs that all of the equal rows take
        left = F.col("__taken") - whole * F.col("__rows") * F.col("__size")
        mine = whole * F.col("__size") + F.greatest(F.lit(0), F.least(F.col("__size"), left - F.col("__place") * F.col("__size")))
        joined = joined.where("__rows = 1").unionByName(again.withColumn("__taken", mine).where("__taken > 0").drop("__place"))
    copies = joined.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.expr("(__taken + __size - 1) div __size"))))
    left = F.expr("least(__size, __taken - (__copy - 1) * __size)")
    words = F.regexp_extract_all("text", F.lit(WORD_RE), F.lit(0))
    text = F.when(left == F.col("__size"), F.col("text")).otherwise(F.array_join(F.slice(words, F.lit(1), left.cast("int")), " "))
    out = copies.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull() & (left < F.col("__size")), F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return back(out)
