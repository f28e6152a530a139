"""Shared helpers: checkpoints, texts of Arrow batches, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labeltext.session import ensure_checkpoint_dir

# Python tasks work on about this many bytes of text at a time, whatever the
# size of the batches that Spark hands over.
SLICE_BYTES = 1 << 19


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the checkpoint folder that executors share."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 1,000 rows where the session still has Spark's default.

    Texts can be long, and a batch is held whole by the JVM and the Python task.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder}/documents.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer form of it that is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def id_bucket(doc_id: Column | str, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``: a split that stays the same."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string").cast("binary")) % buckets


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all strings of ``column`` and their offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)
    at = at[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` with about ``most`` bytes of text each, at least one row."""
    _, at = text_bytes(batch.column(column))
    start, rows = 0, batch.num_rows
    while start < rows:
        stop = int(np.searchsorted(at, at[start] + most, side="right")) - 1
        stop = min(rows, max(stop, start + 1))
        yield batch.slice(start, stop - start)
        start = stop


def ragged(values: pa.Array, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of ``x``."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def least_of_tree(parent: np.ndarray) -> np.ndarray:
    """Pointer jumping until every entry names its root."""
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels ``label`` (each the smallest member) after edges a-b join them."""
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        label = label.copy()
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        label = least_of_tree(label)
    return label


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` (64-bit integers, no nulls).

    Returns ``(node, root)``, root the smallest node of the component, for every
    node that an edge names; no edges give no rows. Alternating large and small
    stars: each round replaces the edges by as many or fewer, and O(log n) rounds
    leave one star per component. Every round is checkpointed, so its lineage is
    one step long. Minima are combined map-side, and a hub's edges meet a single
    row of minima, in a join that adaptive execution can split.
    """
    now = checkpointed(_proper(edges.select("a", "b")))
    state = _digest(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = checkpointed(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = checkpointed(_proper(large))
        lower = checkpointed(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = checkpointed(_proper(small.unionByName(lower.withColumnRenamed("m", "b"))))
        before, state = state, _digest(now)
        if before == state:
            break
    members = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return members.unionByName(roots)


def _proper(edges: DataFrame) -> DataFrame:
    """Distinct edges that point down, without loops."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return down.where("a <> b").distinct()


def _digest(edges: DataFrame) -> tuple:
    """Number of rows and sums of two hashes of them: equal for equal tables."""
    hashes = [F.sum(F.xxhash64("a", "b", F.lit(salt)).cast("decimal(38,0)")) for salt in (1, 2)]
    return tuple(edges.agg(F.count("*"), *hashes).first())
