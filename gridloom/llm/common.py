"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of every contract: runs of characters outside this class. ``bytes.split()`` splits on exactly these.
SPACES = "\x20\t\n\x0b\x0c\r"
WORD_RE = r"[^\x20\x09-\x0D]+"
_MASK = 0xFFFFFFFFFFFFFFFF


def ship(name: str) -> None:
    """Pickle a module's functions by value, so that executors need no copy of this repository."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


ship(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only on a local master (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir() or path
    return path.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage and survives lost executors."""
    return append_to(new_path(df.sparkSession), df)


def new_path(spark: SparkSession) -> str:
    """The name of a table that isn't there yet."""
    return f"{shared_dir(spark)}/gridloom-{uuid.uuid4().hex}"


def append_to(path: str, df: DataFrame) -> DataFrame:
    """Add df's rows to the table at path, and read all of it."""
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_table(df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing reads any more."""
    spark = df.sparkSession
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/gridloom-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(hadoop).delete(path, True)


def task_count(df: DataFrame, bytes_per_task: int = 16 << 20) -> int:
    """Shuffle partitions for df: the session's number, or more where the input's size asks for it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = size // bytes_per_task if size < 1 << 55 else 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(wanted), 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), elementwise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw_texts(column: pa.Array) -> list:
    """UTF-8 bytes (or None) of each value of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def with_columns(batch: pa.RecordBatch, drop: tuple = (), **new: pa.Array) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n not in drop and n not in new]
    return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), *new.values()], names=[*names, *new])


def schema_with(df: DataFrame, drop: tuple = (), **new: T.DataType) -> T.StructType:
    """df's schema without ``drop``, then the new columns; a new name replaces a column of that name."""
    return T.StructType([*(f for f in df.schema.fields if f.name not in drop and f.name not in new), *(T.StructField(n, t) for n, t in new.items())])


def sheltered(df: DataFrame, names) -> tuple:
    """df with its columns of these names under other names, and a function that selects df's columns again."""
    other = {c: f"__own_{c}" for c in df.columns if c in names}
    return df.withColumnsRenamed(other), lambda out: out.select(*(F.col(other.get(c, c)).alias(c) for c in df.columns))


def small_enough(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast df if it has no more than ``rows`` rows (counted now; df should be materialised); else leave the join to shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


HOT_SHARE = 4096


def join_skewed(left: DataFrame, right: DataFrame, keys: dict, count: str, rows: int) -> DataFrame:
    """left with right's other columns (null where no row of right fits), where many rows of left may hold one key.

    keys: {column of left: column of right}, compared null-safely; right has each key once, with the number of left's rows
    that hold it in ``count``, and is materialised. Keys that hold more than one in HOT_SHARE of the ``rows`` rows of left
    are fewer than HOT_SHARE, so their part of right is broadcast; rows of all other keys meet by a shuffle."""

    def fits(a, b):
        on = None
        for x, y in keys.items():
            on = a[x].eqNullSafe(b[y]) if on is None else on & a[x].eqNullSafe(b[y])
        return on

    rest = [c for c in right.columns if c not in keys.values() and c != count]
    limit = max(rows // HOT_SHARE, 1)
    hot = F.broadcast(right.where(F.col(count) > limit).withColumn("__hot", F.lit(True)))
    marked = left.join(hot, fits(left, hot), "left")
    found = marked.where("__hot").select(*left.columns, *rest)
    others = marked.where("__hot is null").select(*left.columns)
    cold = right.where(F.col(count) <= limit)
    return found.unionByName(others.join(cold.hint("merge"), fits(others, cold), "left").select(*left.columns, *rest))


def sampled_texts(docs: DataFrame, labels: DataFrame, label: str, fold: tuple, max_docs: int, max_chars: int) -> list:
    """A bounded sample of labelled training rows: [(text bytes, label)], in the order of a hash of doc_id.

    fold = (modulus, held-out remainder) of crc32(doc_id as text); rows of the held-out fold are never read.
    Of several labels for one doc_id the largest counts; rows without id or label, and labels without a document, don't.
    Both bounds are parameters: at most max_docs ids, and no more than max_chars characters in all; in hash order, a
    text that doesn't fit what is left of them is skipped and later ones are still looked at."""
    modulus, held = fold
    ids = (
        labels.select("doc_id", F.col(label).cast("int").alias("__y"))
        .where(F.col("doc_id").isNotNull() & F.col("__y").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus != held))
        .groupBy("doc_id").agg(F.max("__y").alias("__y"))
        .join(docs.select("doc_id"), "doc_id", "left_semi")
        .withColumn("__h", F.xxhash64(F.lit("sample"), "doc_id"))
        .orderBy("__h", "doc_id").limit(max_docs)
    )
    rows = materialize(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("__h", "doc_id", "__y", "text", F.coalesce(F.length("text"), F.lit(0)).alias("__n")))
    keep, total = [], 0
    for r in rows.groupBy("__h", "doc_id", "__n").agg(F.count("*").alias("__c")).orderBy("__h", "doc_id", "__n").limit(2 * max_docs).collect():
        if total + r["__n"] * r["__c"] <= max_chars and len(keep) < max_docs:
            total += r["__n"] * r["__c"]
            keep.append((r["doc_id"], r["__n"]))
    if not keep:
        return []
    chosen = docs.sparkSession.createDataFrame(keep, f"doc_id {dict(docs.dtypes)['doc_id']}, __n int")
    got = rows.join(F.broadcast(chosen), ["doc_id", "__n"]).orderBy("__h", "doc_id", "text").limit(2 * max_docs).select("text", "__y").collect()
    return [((r["text"] or "").encode(), int(r["__y"])) for r in got]


def is_held_out(modulus: int, held: int):
    """crc32(doc_id as text) mod modulus = held; a null doc_id counts as the empty text."""
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus) == held
