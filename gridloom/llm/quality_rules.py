"""Quality rules with thresholds that adapt to each language and source.

Each text is measured once. Per (lang, source) a mergeable quantile sketch is kept of each ratio: counts of integer
buckets (tenths of a percent), which merge by addition, give the same quantile in any order and have a fixed
number of buckets. A document is rejected by its group's fences: a ratio above
median + max(slack, spread * (q75 - q25)), read from the sketch, joined back by (lang, source).

The query's ratios are those of its SQL, where the fence of repeats is never below the base rule's and repeated lines
are counted by words. A pipeline's are STAGE_RATIOS: the query's and two more, each of which can reject what the base
rule passes. A stage keeps nothing that the query rejects.

Defined results: a null text has no words (and fails the base rule); null lang or source is a group of its own; a
group of one document judges it by its own value, which is never above the fence; equal rows get equal verdicts;
an empty table gives an empty result; other columns are passed on, and a column of a result's name is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import SPACES, materialize, mix, raw_texts, schema_with, sheltered, ship, small_enough, with_columns

ship(__name__)

SYMBOLS = "#*$%&|<>"
MEASURES = {"n_words": T.LongType(), "word_chars": T.LongType(), "n_symbols": T.LongType(), "n_dup_lines": T.LongType(), "n_repeat_words": T.LongType(), "n_lines": T.LongType()}
#: ratio: (expression in tenths of a percent, slack, spread)
RATIOS = {
    "symbols": ("n_symbols * 1000 div greatest(word_chars, 1)", 30, 4),
    "dup_lines": ("n_dup_lines * 1000 div greatest(n_words, 1)", 100, 4),
    "repeats": ("n_repeat_words * 1000 div greatest(n_words, 1)", 200, 4),
}
#: The query's, and repeated lines by non-blank lines, and repeats with a slack below the base rule's MAX_REPEAT_PERCENT.
STAGE_RATIOS = RATIOS | {
    "dup_lines_of_lines": ("n_dup_lines * 1000 div greatest(n_lines, 1)", 300, 4),
    "repeats_below_base": ("n_repeat_words * 1000 div greatest(n_words, 1)", 150, 4),
}
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
_B = np.uint64(0x9E3779B97F4A7C15)


def repeat_words(words: list, k: int = 5) -> int:
    """Words covered by k-word windows that the text holds twice or more."""
    n = len(words)
    if n < k + 1:
        return 0
    ids: dict = {}
    # ids are exact within the text; 64-bit mixes of five of them collide with a chance of about n * n / 2**65
    w = mix(np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.uint64, n) + _B)
    if len(ids) == n:
        return 0
    g = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        g = g * _B + w[i : n - k + 1 + i]
    order = np.argsort(g)
    eq = g[order][1:] == g[order][:-1]
    if not eq.any():
        return 0
    at = order[np.concatenate([[False], eq]) | np.concatenate([eq, [False]])]
    edge = np.zeros(n + 1, np.int64)
    edge[at] += 1
    edge[at + k] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure_text(data: bytes | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (not blank) of a whole text."""
    if not data:
        return 0, 0, 0, 0, 0, 0
    words, text = data.split(), data.decode()
    seen: set = set()
    dup = 0
    for line in data.split(b"\n"):
        if line.strip():
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    return len(words), len(text) - sum(text.count(c) for c in SPACES), sum(text.count(c) for c in SYMBOLS), dup, repeat_words(words), dup + len(seen)


def _measure(drop: tuple):
    def run(batches):
        for batch in batches:
            got = np.array([measure_text(t) for t in raw_texts(batch.column(batch.schema.names.index("text")))], np.int64).reshape(-1, len(MEASURES))
            yield with_columns(batch, drop, **{n: pa.array(got[:, i]) for i, n in enumerate(MEASURES)})

    return run


def measure(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    drop = () if keep_text else ("text",)
    return docs.mapInArrow(_measure(drop), schema_with(docs, drop, **MEASURES))


def sketches(measured: DataFrame, ratios: dict = RATIOS) -> DataFrame:
    """(lang, source, ratio, bucket, n): merge two by adding n; as a ratio's parts are among its whole, at most 1001
    buckets (0 to 1000) a group and ratio."""
    pairs = F.explode(F.array(*(F.struct(F.lit(r).alias("ratio"), F.expr(e).cast("int").alias("bucket")) for r, (e, _, _) in ratios.items())))
    return measured.where("n_words > 0").select("lang", "source", pairs.alias("p")).groupBy("lang", "source", F.col("p.ratio").alias("ratio"), F.col("p.bucket").alias("bucket")).agg(F.count("*").alias("n"))


def quantile(q: float) -> Column:
    """The least bucket that at least the share q of the counts doesn't exceed; needs columns __upto and __all."""
    return F.min(F.when(F.col("__upto") >= q * F.col("__all"), F.col("bucket")))


def thresholds(sketch: DataFrame, ratios: dict = RATIOS) -> DataFrame:
    """(lang, source, one fence for each ratio)."""
    group = Window.partitionBy("lang", "source", "ratio")
    running = sketch.withColumn("__upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("__all", F.sum("n").over(group))
    q = running.groupBy("lang", "source", "ratio").agg(quantile(0.25).alias("q25"), quantile(0.5).alias("q50"), quantile(0.75).alias("q75"))

    def fence(ratio):
        slack, spread = ratios[ratio][1:]
        return F.max(F.when(F.col("ratio") == ratio, F.col("q50") + F.greatest(F.lit(slack), F.lit(spread) * (F.col("q75") - F.col("q25"))))).alias(f"__{ratio}")

    return q.groupBy(F.col("lang").alias("__lang"), F.col("source").alias("__source")).agg(*(fence(r) for r in ratios))


def judge(measured: DataFrame, fences: DataFrame, ratios: dict = RATIOS) -> DataFrame:
    """measured with base_failed and kept. fences: materialised; broadcast only while it has few rows."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    within = F.lit(True)
    for r, (e, _, _) in ratios.items():
        within = within & (F.expr(e) <= F.col(f"__{r}"))
    joined = measured.drop("base_failed", "kept").join(small_enough(fences, 50_000), F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    names = [c for c in measured.columns if c not in ("base_failed", "kept")]
    return joined.select(*names, base.alias("base_failed"), (~base & F.coalesce(within, F.lit(False))).alias("kept"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """(columns of docs but text, the measures, base_failed, kept)."""
    measured = materialize(measure(docs, keep_text=False))
    return judge(measured, materialize(thresholds(sketches(measured))))


def keep_quality(docs: DataFrame, ratios: dict = RATIOS) -> DataFrame:
    """The rows of docs that the rules keep. Measures are taken twice rather than carry whole texts through a join."""
    fences = materialize(thresholds(sketches(measure(docs.select("lang", "source", "text"), keep_text=False), ratios), ratios))
    away, back = sheltered(docs, (*MEASURES, "base_failed", "kept"))
    return back(judge(measure(away), fences, ratios).where("kept"))
