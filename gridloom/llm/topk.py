"""Exact top-k search by exhaustive term-at-a-time accumulation.

A query block becomes postings: for each term (dimension), the queries with a non-zero weight there. Candidate rows
arrive in blocks; for each term the weights are scattered, multiplied by the block's values, into a dense score array
(queries x candidates). A partition selection keeps each query's k best of a block, a merge those of a task, and a
ranked window (limited before its shuffle) those of all tasks.

The queries are read in blocks of at most ``block`` rows, each sent to the executors on its own, so what is
broadcast is bounded whatever their number; each block takes one pass over the candidates, and its answers, which are
final, are appended to one table.

Defined results: a component x counts as floor(256 * x) of x as double, exactly, whatever its size; rows that are null, or
hold a null or non-finite component, or have no vec_id, take no part; missing trailing components count as 0; all
rows with a query's vec_id are its own; rows that repeat a vec_id are candidates each (so ranks may hold it twice),
and a query that is repeated is asked once, by its least vector; scores are exact, and a score that no 64-bit integer
holds is an error, not a wrong rank; other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import append_to, materialize, new_path, ship

ship(__name__)

CELLS = 1 << 21


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, __v: array of double that are whole numbers) of the rows that take part."""
    x = F.col("embedding")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    # a double times 256 is exact, and so is the whole number below it: adding 0.0 makes -0.0 0.0
    whole = F.transform(x, lambda c: F.when(F.abs(c.cast("double")) < float(1 << 44), F.floor(c.cast("double") * 256).cast("double")).otherwise(c.cast("double") * 256) + F.lit(0.0))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull()).where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("__v"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a dense matrix, short rows filled with 0."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes, sizes)] = flat
    return out


def as_integers(values: np.ndarray, other: float) -> np.ndarray:
    """Whole-numbered doubles as 64-bit integers if no sum of products with numbers up to ``other`` can pass 2**62,
    else as Python's integers, which have no bound."""
    most = float(np.abs(values).max(initial=0.0))
    if max(most, 1.0) * max(other, 1.0) * max(values.shape[1], 1) < 2.0**62:
        return values.astype(np.int64)
    out = np.empty(values.shape, object)
    out[:] = [[int(x) for x in row] for row in values.tolist()]
    return out


def accumulate(queries: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Scores (queries x candidates), term at a time over the terms that occur on both sides."""
    scores = np.zeros((len(queries), len(block)), np.int64 if queries.dtype == block.dtype == np.int64 else object)
    for term in range(min(queries.shape[1], block.shape[1])):
        hits, values = np.flatnonzero(queries[:, term]), block[:, term]
        posted = np.flatnonzero(values)
        if len(hits) and len(posted):
            if len(hits) == len(queries) and len(posted) == len(block):
                scores += queries[:, term, None] * values[None, :]
            else:
                scores[np.ix_(hits, posted)] += queries[hits, term, None] * values[None, posted]
    return scores


def select(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's k best (score descending, id ascending): (row, column) pairs. Ties at the cut are all looked at."""
    if scores.shape[1] > k:
        cut = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        row, col = np.nonzero(scores >= cut[:, None])
    else:
        row, col = np.nonzero(np.ones(scores.shape, bool))
    order = np.lexsort((ids[col], -scores[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def scored(queries: np.ndarray, block: np.ndarray, own: np.ndarray, none: int) -> np.ndarray:
    """64-bit scores of whole-numbered doubles, ``none`` where own; an OverflowError if another score isn't 64-bit."""
    most = float(np.abs(block).max(initial=0.0))
    asked = as_integers(queries, most)
    if asked.dtype == np.int64:
        scores = accumulate(asked, as_integers(block, float(np.abs(queries).max(initial=0.0))))
    else:
        wide = np.empty(block.shape, object)
        wide[:] = [[int(x) for x in row] for row in block.tolist()]
        scores = accumulate(asked, wide)
    if scores.dtype != np.int64:
        scores[own] = 0
        if scores.size and (max(scores.max(), -scores.min()) >= 1 << 63):
            raise OverflowError("an inner product doesn't fit a 64-bit integer")
        scores = scores.astype(np.int64)
    scores[own] = none
    return scores


def _search(query_ids: np.ndarray, queries: np.ndarray, k: int):
    none = np.iinfo(np.int64).min + 1  # the least value that has a negative: select() sorts by it

    def run(batches):
        best_q, best_id, best_s = (np.zeros(0, np.int64) for _ in range(3))
        step = max(1, CELLS // max(1, len(query_ids)))
        for batch in batches:
            all_ids, matrix = batch.column(0).to_numpy(), _matrix(batch.column(1))
            for lo in range(0, len(all_ids), step):
                ids = all_ids[lo : lo + step]
                own = query_ids[:, None] == ids[None, :]
                scores = scored(queries, matrix[lo : lo + step], own, none)
                row, col = select(scores, ids, k)
                real = ~own[row, col]
                row, col = row[real], col[real]
                q, i, s = (np.concatenate(x) for x in ((best_q, row), (best_id, ids[col]), (best_s, scores[row, col])))
                order = np.lexsort((i, -s, q))
                q, i, s = q[order], i[order], s[order]
                top = np.arange(len(q)) - np.searchsorted(q, q) < k
                best_q, best_id, best_s = q[top], i[top], s[top]
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[best_q]), pa.array(best_id), pa.array(best_s)], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries, k: int = 5, block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows for which the Column ``queries`` holds."""
    rows = materialize(quantised(vectors))
    asked = materialize(rows.where(queries).groupBy("vec_id").agg(F.min("__v").alias("__v")).orderBy("vec_id"))
    path = after = found = None
    while True:
        part = asked if after is None else asked.where(F.col("vec_id") > after)
        some = part.orderBy("vec_id").limit(block).collect()  # a block: bounded
        if not some:
            break
        after = some[-1]["vec_id"]
        width = max(len(r["__v"]) for r in some)
        matrix = np.zeros((len(some), width))
        for i, r in enumerate(some):
            matrix[i, : len(r["__v"])] = r["__v"]
        ids = np.array([r["vec_id"] for r in some], np.int64)
        found = _ranked(rows.mapInArrow(_search(ids, matrix, k), "query_id long, vec_id long, score long"), k)
        if path or len(some) == block:  # more may follow
            path = path or new_path(rows.sparkSession)
            found = append_to(path, found)
        if len(some) < block:
            break
    return found if found is not None else _ranked(rows.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
