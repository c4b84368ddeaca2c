"""The links that shard trees find, against all pairs, on the query's own table and in crowded bands."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import common, simhash

SF = Path("/root/testdata/sf0.1")


def all_pairs(values, radius=3):
    a, b = [], []
    for lo in range(0, len(values), 1024):
        q, t = np.nonzero(np.bitwise_count(values[lo : lo + 1024, None] ^ values[None, :]) <= radius)
        a.append(q + lo)
        b.append(t)
    return np.concatenate(a), np.concatenate(b)


def test_inner_nodes_find_the_query_s_links(spark):
    """The registered query's table: every shard's tree has inner nodes that are asked, and no link is missed."""
    if not SF.exists():
        pytest.skip("no tables")
    docs = common.table(spark, str(SF), "documents").select("doc_id", "text").repartition(8)
    values = common.materialize(simhash.fingerprints(docs).select("__fp").distinct())
    units = simhash.shards(values).toPandas()
    asked, large, src, dst = 0, 0, [], []
    for _, shard in units.groupby(["__m", "__v"]):
        fps = np.sort(shard["__fp"].to_numpy()).view(np.uint64)
        a, b, n = simhash.link_shard(fps, 3)
        large += len(fps) > simhash.LEAF
        assert n > 0 or len(fps) <= simhash.LEAF
        asked += n
        src.append(a)
        dst.append(b)
    assert large > 50 and asked > 1000
    every = np.sort(values.toPandas()["__fp"].to_numpy().view(np.uint64))
    at = {int(v): i for i, v in enumerate(every)}
    src, dst = np.concatenate(src), np.concatenate(dst)
    got = simhash.least_labels(len(every), np.array([at[int(x)] for x in src]), np.array([at[int(x)] for x in dst]))
    assert np.array_equal(got, simhash.least_labels(len(every), *all_pairs(every)))
    assert len(src) > 10


@pytest.mark.parametrize("limit", [16, 40])
def test_crowded_bands_are_dealt_by_further_bits(spark, limit):
    """Thousands of values that agree on half of their bits, and a ball around one value: no shard stays large."""
    rng = np.random.default_rng(limit)
    half = rng.integers(0, 2**32, 1500, dtype=np.uint64)
    ball = np.uint64(0x123456789ABCDEF0) ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (4, 300)).astype(np.uint64))
    values = np.unique(np.concatenate([half, half[:200] ^ np.uint64(0b1001), ball, rng.integers(0, 2**63, 300, dtype=np.uint64)]))
    df = common.materialize(spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "__fp long"))
    units = simhash.shards(df, 3, limit)
    sizes = units.groupBy("__m", "__v").count().select(F.max("count"), F.sum("count")).first()
    assert sizes[0] <= max(limit, 2**simhash.LAST_BITS)
    at = {int(v): i for i, v in enumerate(values.view(np.int64))}
    edges = simhash.links(df, 3, limit).collect()
    got = simhash.least_labels(len(values), np.array([at[e["src"]] for e in edges]), np.array([at[e["dst"]] for e in edges]))
    assert np.array_equal(got, simhash.least_labels(len(values), *all_pairs(values)))


@pytest.mark.parametrize("radius", [1, 3, 7])
def test_further_masks_part_no_close_pair(radius):
    rng = np.random.default_rng(radius)
    mask = 0xFF00FF0000000000
    for _ in range(200):
        a = int(rng.integers(0, 2**63))
        b = a
        for bit in rng.choice([k for k in range(64) if not mask >> k & 1], radius, replace=False):
            b ^= 1 << int(bit)
        assert any((a ^ b) & m == 0 for m in simhash.further_masks(mask, radius))
    assert simhash.further_masks((1 << 64) - 1, radius) == []


def test_rows_of_one_id_and_fingerprint_leave_the_least_text(spark):
    rows = [(1, "One two three", "x"), (1, "one TWO three", "y"), (1, "one two three", "z"), (None, "A b c", "p"), (None, "a b c", "q")]
    want = {(1, "One two three", "x"), (None, "A b c", "p")}
    for parts in (1, 4):
        got = simhash.drop_near_duplicates(spark.createDataFrame(rows * 2, "doc_id long, text string, own string").repartition(parts)).collect()
        assert set(map(tuple, got)) == want and len(got) == 2
