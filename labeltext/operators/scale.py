"""Joins and numbering that hold up under skew.

* ``spread``         use all cores on a table of few files
* ``small_table``    a table proven small by a bounded read, or as it was
* ``join_counted``   join against a per-key table without a hot shuffle key
* ``with_row_index`` dense 0-based row numbers without a single-task window
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labeltext.session import ensure_checkpoint_dir

# At most this many keys, of this mean size in bytes, are ever broadcast as
# frequent keys: about 16 MB of key text.
FREQUENT_KEYS = 250_000
KEY_BYTES = 64


def spread(scan: DataFrame, key: str) -> DataFrame:
    """A plain scan dealt out by ``key`` if it has fewer partitions than cores.

    Few large row groups would leave cores idle in the expensive text steps. A
    large table has more partitions than cores and passes through unshuffled.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores, key)


def small_table(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """``df`` marked for broadcast if a bounded read finds it small.

    At most ``max_rows + 1`` rows are read. A table within the bound comes back
    as a local relation, so it is computed once; a larger one comes back
    unmarked and is joined by shuffle.
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def is_small(df: DataFrame, max_rows: int, text: str) -> bool:
    """Whether a bounded read finds at most ``max_rows`` rows of modest text size."""
    seen = df.limit(max_rows + 1).agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")
    ).first()
    return seen.n <= max_rows and seen.b <= max_rows * KEY_BYTES


def join_counted(
    rows: DataFrame, counted: DataFrame, keys: list[str], n: str, frequent_keys: int = FREQUENT_KEYS
) -> DataFrame:
    """Inner join of ``rows`` with ``counted``, where ``counted`` has one row per
    key and its column ``n`` is the number of ``rows`` with that key.

    Keys carrying at least 1/frequent_keys of all rows are joined by broadcast,
    the rest by shuffle. Since the counts add up to the number of rows there can
    be no more than ``frequent_keys`` such keys, and a key longer than KEY_BYTES
    must be frequent in proportion, which bounds the broadcast in bytes too. What
    is left to the shuffle has no hot key.
    """
    total = counted.agg(F.sum(n)).scalar()
    text_keys = [k for k in keys if counted.schema[k].dataType.simpleString() == "string"]
    size = F.lit(KEY_BYTES).cast("double")
    for key in text_keys:
        size = F.greatest(size, F.octet_length(key).cast("double"))
    frequent = F.col(n).cast("double") * frequent_keys * KEY_BYTES >= F.lit(total).cast("double") * size
    hot = counted.where(frequent)
    cold = counted.where(~frequent)
    by_broadcast = rows.join(F.broadcast(hot), keys)
    by_shuffle = rows.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(cold, keys)
    return by_broadcast.unionByName(by_shuffle)


def with_row_index(df: DataFrame, order: list[str], name: str = "row_index") -> DataFrame:
    """``df`` with dense 0-based row numbers in the given total order.

    Range-partitions and sorts once, fixes that layout with a checkpoint, and
    adds each partition's start to the position inside it. Only the table of
    partition sizes, one row per partition, meets in one task.
    """
    fixed = _ordered(df, order)
    starts = _starts(fixed, F.count("*"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = fixed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + inside)
    return numbered.drop("_at", "_part", "_start")


def with_running_total(df: DataFrame, order: list[str], n: str, name: str = "row_index") -> DataFrame:
    """``df`` with the 0-based place of the last of the ``n`` rows that each row
    stands for, in the given total order."""
    fixed = _ordered(df, order)
    starts = _starts(fixed, F.sum(n))
    before = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    inside = fixed.withColumn("_inside", F.sum(n).over(before))
    numbered = inside.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_inside") - 1)
    return numbered.drop("_at", "_part", "_start", "_inside", n)


def _ordered(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` range-partitioned and sorted, its layout fixed, with ``_part`` and ``_at``."""
    ensure_checkpoint_dir(df.sparkSession)
    laid_out = df.repartitionByRange(*order).sortWithinPartitions(*order)
    fixed = laid_out.withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    return fixed.withColumn("_part", F.shiftright("_at", 33))


def _starts(fixed: DataFrame, size: Column) -> DataFrame:
    """``(_part, _start)``: what stands before each partition, one row per partition."""
    sizes = fixed.groupBy("_part").agg(size.alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
