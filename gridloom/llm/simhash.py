"""SimHash near-duplicates with BK-trees.

Each document gets a 64-bit fingerprint of its word shingles. Distinct fingerprints are dealt to shards of some hundreds
by bands of bits: two fingerprints within ``radius`` bits agree on at least ``blocks - radius`` of ``blocks`` bit blocks,
so every linked pair meets in some shard. A band uses no more bits than give shards of about TARGET values, so that a
shard's BK-tree, not the band, finds the links: its values go down the tree together and follow only the edges whose key
is within the radius. A shard of more than ``shard_limit`` values is dealt anew by further bits: of its pairs within the
radius each agrees on one of ``radius + 1`` blocks of the bits not yet used. A shard returns a spanning star of each
component it sees, never all pairs.

Trees are built in the task that asks them and travel with the shuffle. To broadcast the trees of all fingerprints
would mean to collect these in the driver, in blocks as it may be, which no size bounds and which isn't allowed.

Defined results: a null or wordless text has fingerprint 0; a text of any length is taken whole; equal rows get equal
fingerprints and one component; a null doc_id is larger than any other id, so a component_id is null only if all its
ids are; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from gridloom.llm.common import delete_table, join_skewed, materialize, raw_texts, schema_with, ship, task_count, with_columns

ship(__name__)

SHARD_LIMIT = 2048
TARGET = 512
LEAF = 16
#: Shards that differ in no more than so many bits are never dealt anew: they hold 64 values at most.
LAST_BITS = 6
CHUNK = 255 * 64


def shingle_hashes(words: list, k: int, seed: int, at: int = 0, upto: int | None = None) -> list:
    """XXH64 of the k-word shingles that start in [at, upto); a shorter sequence is one shingle."""
    if len(words) <= k:
        return [xxh64_intdigest(b" ".join(words), seed)]
    part = words[at : (len(words) if upto is None else upto + k - 1)]
    joined, starts, p = b" ".join(part), [], 0
    for w in part:
        starts.append(p)
        p += len(w) + 1
    starts.append(p)
    return [xxh64_intdigest(joined[a : b - 1], seed) for a, b in zip(starts, starts[k:])]


def fingerprint(text: bytes | None, k: int = 3, seed: int = 42) -> int:
    """Bit b is 1 if more than half of the shingle hashes have it; shingles are taken in chunks, so memory is bounded."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    total = max(1, len(words) - k + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, total, CHUNK):
        hashes = np.array(shingle_hashes(words, k, seed, at, min(at + CHUNK, total)), np.uint64)
        lanes = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
        for i in range(0, len(lanes), 255):  # eight counters to a word, none of which can overflow
            ones += lanes[i : i + 255].sum(axis=0).view(np.uint8)
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.uint64)[0])


def _add_fingerprints(k: int, seed: int):
    def run(batches):
        for batch in batches:
            texts = raw_texts(batch.column(batch.schema.get_field_index("text")))
            fps = np.fromiter((fingerprint(t, k, seed) for t in texts), np.uint64, len(texts))
            yield with_columns(batch, ("text",), __fp=pa.array(fps.view(np.int64)))

    return run


def fingerprints(docs: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """Columns of docs without text, and __fp (the fingerprint's bits as a long)."""
    return docs.mapInArrow(_add_fingerprints(k, seed), schema_with(docs, ("text",), __fp=T.LongType()))


class BKTree:
    """A BK-tree over distinct 64-bit values; children are keyed by their integer distance to the parent, and
    a subtree of no more than LEAF values is kept as one array. Queries go through it a whole array at a time."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.asked = 0  # inner nodes that queries have come to
        self.nodes: list = []  # (pivot index, {distance: child}) or an index array
        stack = [(np.arange(len(values)), None, 0)]
        while stack:
            members, parent, key = stack.pop()
            if parent is not None:
                self.nodes[parent][1][key] = len(self.nodes)
            if len(members) <= LEAF:
                self.nodes.append(members)
                continue
            at, rest = len(self.nodes), members[1:]
            self.nodes.append((int(members[0]), {}))
            d = np.bitwise_count(values[rest] ^ values[members[0]])
            order = np.argsort(d, kind="stable")
            cuts = np.flatnonzero(np.diff(d[order])) + 1
            for part in np.split(order, cuts):
                stack.append((rest[part], at, int(d[part[0]])))

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query index, value index) of every pair within the radius."""
        found, stack = [], [(0, np.arange(len(queries)))]
        while stack:
            at, active = stack.pop()
            node = self.nodes[at]
            if isinstance(node, np.ndarray):
                for lo in range(0, len(active), 4096):
                    q = active[lo : lo + 4096]
                    a, b = np.nonzero(np.bitwise_count(queries[q][:, None] ^ self.values[node][None, :]) <= radius)
                    found.append((q[a], node[b]))
                continue
            pivot, children = node
            self.asked += 1
            d = np.bitwise_count(queries[active] ^ self.values[pivot]).astype(np.int64)
            near = active[d <= radius]
            found.append((near, np.full(len(near), pivot)))
            for key, child in children.items():
                go = active[np.abs(d - key) <= radius]
                if len(go):
                    stack.append((child, go))
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of n nodes reaches over the edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if np.array_equal(new, label):
            return label
        label = new


def link_shard(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Star edges (least member, member) of the components that a shard's pairs make, and how many inner nodes of its
    tree were asked."""
    tree = BKTree(values)
    label = least_labels(len(values), *tree.within(values, radius))
    members = np.flatnonzero(label != np.arange(len(values)))
    return values[label[members]], values[members], tree.asked


def _link(radius: int):
    """Shards, whose rows (__m, __v, __fp) come one after the other, to edges (src, dst)."""
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def run(batches):
        held: list = []  # the fingerprints of the shard that may go on in the next batch
        key = None
        for batch in batches:
            mask, value, fps = (np.asarray(batch.column(batch.schema.get_field_index(n))) for n in ("__m", "__v", "__fp"))
            if not len(fps):
                continue
            starts = np.concatenate([[0], np.flatnonzero((mask[1:] != mask[:-1]) | (value[1:] != value[:-1])) + 1, [len(fps)]])
            found = []
            for lo, hi in zip(starts, starts[1:]):
                if key != (mask[lo], value[lo]):
                    found.append(_edges(held, radius))
                    held, key = [], (mask[lo], value[lo])
                held.append(fps[lo:hi])
            src, dst = (np.concatenate([x[i] for x in found] or [fps[:0]]) for i in (0, 1))
            if len(src):
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], schema=schema)
        src, dst = _edges(held, radius)
        if len(src):
            yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], schema=schema)

    return run


def _edges(parts: list, radius: int) -> tuple[np.ndarray, np.ndarray]:
    values = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    if len(values) < 2:
        return values[:0], values[:0]
    src, dst, _ = link_shard(values.view(np.uint64), radius)
    return src.view(np.int64), dst.view(np.int64)


def band_masks(n: int, radius: int, expected: int = 256) -> list[int]:
    """Bit masks such that two 64-bit values within the radius agree under one of them; the fewest blocks for which
    n random values give shards of about ``expected``."""
    blocks = radius + 1
    while blocks < 2 * radius + 1 and n / 2 ** (64 * (blocks - radius) / blocks) > expected:
        blocks += 1
    cut = [64 * i // blocks for i in range(blocks + 1)]
    part = [((1 << (b - a)) - 1) << a for a, b in zip(cut, cut[1:])]
    return [sum(x) for x in combinations(part, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def narrowed(mask: int, n: int, target: int = TARGET) -> int:
    """The mask's highest bits, no more of them than deal n random values into shards of about ``target``."""
    bits = max(0, (max(n, 1) - 1).bit_length() - max(target, 1).bit_length() + 1)
    kept = [b for b in range(63, -1, -1) if mask >> b & 1][:bits]
    return sum(1 << b for b in kept)


def further_masks(mask: int, radius: int) -> list[int]:
    """mask with each of radius + 1 blocks of the other bits: two values that agree under mask and are within the radius
    agree under one of these. None if too few bits are left to part many values."""
    free = [b for b in range(64) if not mask >> b & 1]
    if len(free) <= max(LAST_BITS, radius + 1):
        return []
    cut = [len(free) * i // (radius + 1) for i in range(radius + 2)]
    return [mask | sum(1 << b for b in free[lo:hi]) for lo, hi in zip(cut, cut[1:])]


def shards(values: DataFrame, radius: int = 3, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """(__m, __v, __fp): the shards, each a mask of bits and what its values hold there. Any two values within the
    radius are in some shard together. values: a materialised table of distinct ``__fp``."""
    spark = values.sparkSession
    n = values.count()
    masks = sorted({narrowed(m, n, min(TARGET, max(1, shard_limit // 4))) for m in band_masks(n, radius)})
    dealt = values.select("__fp", F.explode(F.array(*(F.lit(_signed(m)) for m in masks))).alias("__m"))
    done = None
    while True:
        dealt = dealt.withColumn("__v", F.col("__fp").bitwiseAND(F.col("__m")))
        sizes = dealt.groupBy(F.col("__m").alias("m"), F.col("__v").alias("v")).agg(F.count("*").alias("__n"))
        hot = materialize(sizes.where(F.col("__n") > shard_limit))
        used = [r["m"] for r in hot.select("m").distinct().collect()]  # masks, not values: a few for each round
        pairs = [(m, _signed(f)) for m in used for f in further_masks(m % (1 << 64), radius)]
        if not pairs:
            return (dealt if done is None else done.unionByName(dealt)).select("__m", "__v", "__fp")
        splits = spark.createDataFrame(sorted({m for m, _ in pairs}), "long").withColumnRenamed("value", "m")
        hot = materialize(hot.join(F.broadcast(splits), "m", "left_semi").withColumn("__again", F.lit(True)))
        marked = materialize(join_skewed(dealt, hot, {"__m": "m", "__v": "v"}, "__n", dealt.count()))
        stay = marked.where("__again is null").select("__m", "__v", "__fp")
        done = stay if done is None else done.unionByName(stay)
        further = spark.createDataFrame(pairs, "__m long, further long")
        dealt = marked.where("__again").join(F.broadcast(further), "__m").select("__fp", F.col("further").alias("__m"))


def links(values: DataFrame, radius: int = 3, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """(src, dst) edges whose components are those of the graph of all pairs within the radius.

    values: a materialised table of distinct ``__fp``."""
    units = shards(values, radius, shard_limit).repartition(task_count(values, 4 << 20), "__m", "__v")
    return units.sortWithinPartitions("__m", "__v", "__fp").mapInArrow(_link(radius), "src long, dst long")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): comp is the least node of the component. edges: (src, dst) longs, materialised.

    Rounds of neighbour minima and pointer jumps; each round is written to the shared folder, the one before it
    deleted, and only a count comes to the driver. A node has few edges, but a component may hold most nodes, so the jump
    goes by a join for hot keys."""
    both = materialize(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    label = materialize(both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("node"), F.least("src", "m").alias("comp")))
    nodes = label.count()
    while True:
        near = both.join(label.select(F.col("node").alias("dst"), F.col("comp").alias("near")), "dst").groupBy(F.col("src").alias("node")).agg(F.min("near").alias("near"))
        new = materialize(label.join(near, "node").select("node", F.least("comp", "near").alias("comp"), F.col("comp").alias("old")))
        jump = new.groupBy(F.col("comp").alias("at")).agg(F.count("*").alias("__n")).join(label.select(F.col("node").alias("at"), F.col("comp").alias("far")), "at")
        jumped = join_skewed(new, materialize(jump), {"comp": "at"}, "__n", nodes)
        after = materialize(jumped.select("node", F.coalesce("far", "comp").alias("comp"), "old"))
        changed = after.where(F.col("comp") != F.col("old")).limit(1).count()
        delete_table(label)
        delete_table(new)
        label = after.select("node", "comp")
        if not changed:
            return label


def near_duplicates(docs: DataFrame, k: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, __fp, component_id), one row for each row of docs (doc_id, text; other columns are not read)."""
    marked = materialize(fingerprints(docs.select("doc_id", "text"), k, seed))
    values = materialize(marked.groupBy("__fp").agg(F.min("doc_id").alias("__least"), F.count("*").alias("__n")))
    edges = materialize(links(values.select("__fp"), radius))
    if edges.limit(1).count():
        comp = components(edges).select(F.col("node").alias("__fp"), "comp")
        named = materialize(values.join(comp, "__fp", "left").select("__fp", F.coalesce("comp", "__fp").alias("comp"), "__least", "__n"))
        least = materialize(named.groupBy(F.col("comp").alias("__c")).agg(F.min("__least").alias("component_id"), F.count("*").alias("__m")))
        values = materialize(join_skewed(named, least, {"comp": "__c"}, "__m", named.count()).select("__fp", "__n", "component_id"))
    else:
        values = values.select("__fp", "__n", F.col("__least").alias("component_id"))
    return join_skewed(marked, values.withColumnRenamed("__fp", "__f"), {"__fp": "__f"}, "__n", marked.count()).select("doc_id", "__fp", "component_id")


def drop_near_duplicates(docs: DataFrame, k: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """docs with one document of each component: the one with the least doc_id. Rows that repeat that doc_id are
    the same document, of which one row stays, that of the least fingerprint and text (null ids: likewise one row, where
    no other id is in the component)."""
    found = near_duplicates(docs, k, radius, seed)
    stay = materialize(found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id", "__fp").agg(F.count("*").alias("__n")))
    again = stay.where((F.col("__n") > 1) | F.col("doc_id").isNull()).limit(1).count() or stay.groupBy("doc_id").count().where("count > 1").limit(1).count()
    if not again:
        # a merge join at every size: the ids that stay grow with the corpus, so they are never broadcast
        return docs.join(stay.select("doc_id").hint("merge"), "doc_id", "left_semi").select(*docs.columns)
    one = fingerprints(docs.withColumn("__text", F.col("text")), k, seed).withColumnRenamed("__text", "text")
    pick = stay.groupBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("__fp")).alias("__z")).agg(F.min("__fp").alias("__fp")).select(F.col("doc_id").alias("__id"), F.col("__fp").alias("__f"))
    kept = one.join(pick, one["doc_id"].eqNullSafe(pick["__id"]) & (one["__fp"] == pick["__f"]), "left_semi")
    row = F.struct(*docs.columns)
    least = kept.groupBy("doc_id", "__fp").agg(F.min_by(row, F.struct("text", F.xxhash64(*docs.columns))).alias("__row"))
    return least.select("__row.*")
