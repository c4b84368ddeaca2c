"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join. DataFrame functions only.

A listed entry is (host, path, verdict): it fits its host and all subdomains where the URL's path starts with its
path. Its canonical form is host, a newline, path. Each distinct (host, path) of the pages gives as candidates the
canonical forms of its host suffixes and path prefixes (of the lengths that the list holds). The filter is a table of
256-bit blocks (four longs); one hash of a canonical form picks the block, another two bits in each long. Candidates whose bits are all set are possible hits; the exact join on host and path drops
the false ones; the longest entry wins (host and path together, then the longer host).

Defined results: a null url, or one without ``://``, has an empty host and path and no rule; only A-Z of the host
are lower-cased; a url that no entry fits gets ``otherwise``; of entries equal in host and path the least verdict
holds; entries that are null in host, path or verdict are left out; equal rows get equal verdicts; a url of any length is
read whole; other columns of pages are passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import join_skewed, materialize, small_enough

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS_PER_ENTRY = 16
LANES = 4


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def lane_bits(key: Column) -> list[Column]:
    """One mask for each lane: two bits of its 64, from a second hash."""
    h = F.xxhash64(F.lit("lane"), key)
    return [_two_bits(h, i) for i in range(LANES)]


def _two_bits(h: Column, lane: int) -> Column:
    def bit(shift):
        place = F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(63).cast("long")).cast("int")
        return F.call_function("shiftleft", F.lit(1).cast("long"), place)

    return bit(12 * lane).bitwiseOR(bit(12 * lane + 6))


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """(__block, __w0.. __w3) of a table of keys (__key)."""
    lanes = [c.alias(f"__w{i}") for i, c in enumerate(lane_bits(F.col("__key")))]
    return keys.select(block_of(F.col("__key"), blocks).alias("__block"), *lanes).groupBy("__block").agg(*(F.bit_or(f"__w{i}").alias(f"__w{i}") for i in range(LANES)))


def suffixes(host: Column) -> Column:
    """host, and what follows each of its dots."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def filter_urls(pages: DataFrame, listed: DataFrame, otherwise: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict. listed: (host, path, verdict)."""
    own = ("host", "path", "rule", "verdict")
    rest = [c for c in pages.columns if c not in own]
    parsed = pages.select(*rest, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rules = materialize(listed.dropna(subset=["host", "path", "verdict"]).groupBy(F.col("host").alias("__h"), F.col("path").alias("__p")).agg(F.min("verdict").alias("__verdict")).withColumn("__key", F.concat("__h", F.lit("\n"), "__p")))
    n, lengths = rules.agg(F.count("*"), F.sort_array(F.collect_set(F.length("__p")))).first()  # lengths: no more than the longest path has characters
    if not n:
        return parsed.select(*rest, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    blocks = max(1, -(-n * BITS_PER_ENTRY // (64 * LANES)))
    table = small_enough(materialize(bloom(rules, blocks)), 1 << 18)
    exact = small_enough(rules, 1 << 17)

    counted = materialize(parsed.groupBy("host", "path").agg(F.count("*").alias("__n")))
    distinct = counted.where("host <> ''").select("host", "path")
    prefixes = F.transform(F.filter(F.array(*(F.lit(int(x)) for x in lengths)), lambda x: x <= F.length("path")), lambda x: F.substring(F.col("path"), F.lit(1), x))
    candidates = (
        distinct.withColumn("__h", F.explode(suffixes(F.col("host"))))
        .withColumn("__p", F.explode(prefixes))
        .withColumn("__key", F.concat("__h", F.lit("\n"), "__p"))
        .withColumn("__block", block_of(F.col("__key"), blocks))
    )
    passes = F.lit(True)
    for i, bits in enumerate(lane_bits(F.col("__key"))):
        passes = passes & (F.col(f"__w{i}").bitwiseAND(bits) == bits)
    possible = candidates.join(table, "__block").where(passes).select("host", "path", "__h", "__p")
    best = F.max_by(F.struct(F.concat("__h", "__p").alias("rule"), F.col("__verdict").alias("verdict")), F.struct(F.length("__h") + F.length("__p"), F.length("__h"))).alias("__best")
    decided = possible.join(exact, ["__h", "__p"]).groupBy("host", "path").agg(best)
    # every (host, path) with its count, so that those of many pages, ruled or not, are joined by broadcast
    named = counted.join(decided, ["host", "path"], "left").select(F.col("host").alias("__host"), F.col("path").alias("__path"), "__n", "__best")
    out = join_skewed(parsed, materialize(named), {"host": "__host", "path": "__path"}, "__n", parsed.count())
    return out.select(*rest, "host", "path", F.col("__best.rule").alias("rule"), F.coalesce("__best.verdict", F.lit(otherwise)).alias("verdict"))
