"""Line sinks.

Text output is one folder per kind (``source``, ``target``) with a sub-folder per
split; line j of ``part-i`` in one belongs to line j of ``part-i`` in the other.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labeltext.functions.line_patterns import single_line_pair
from labeltext.functions.text import clean_line
from labeltext.session import ensure_checkpoint_dir
from labeltext.sources.readers import BUCKETS


def _laid_out(rows: DataFrame, folders: list[str]) -> DataFrame:
    """Rows range-partitioned and sorted by folder and id, the layout fixed by a
    checkpoint, so that several writes cut it into the same files."""
    ensure_checkpoint_dir(rows.sparkSession)
    order = [*folders, "id"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint()


def _write_in_place(rows: DataFrame, path: str, kinds: dict[str, Column], folders: list[str]) -> None:
    """A checkpoint and a write per kind, without a rename: for object stores, where
    renaming a folder copies it."""
    laid_out = _laid_out(rows, folders)
    for kind, line in kinds.items():
        lines = laid_out.select(line.alias(kind), *folders)
        lines.write.mode("overwrite").partitionBy(*folders).text(f"{path}/{kind}")


def _write_aligned(rows: DataFrame, path: str, kinds: dict[str, Column], folders: list[str]) -> None:
    """One job that writes the lines of all ``kinds`` as ``path/kind/folder=..``.

    Rows are range-partitioned by folder and id, and each becomes a line per kind in
    its task, which writes all of them in one order: line j of ``part-i`` is of the
    same row in each kind, also where ids repeat, a task fails or an executor goes.
    The result stands beside the old one until it is complete, then takes its place.
    """
    spark = rows.sparkSession
    laid_out = rows.repartitionByRange(*folders, "id").withColumn("_at", F.monotonically_increasing_id())
    lines = F.array(*[F.struct(F.lit(kind).alias("kind"), line.alias("line")) for kind, line in kinds.items()])
    fanned = laid_out.select(*folders, "id", "_at", F.explode(lines).alias("_line"))
    staging = f"{path}/_aligned-{uuid.uuid4()}"
    (
        fanned.select("_line.kind", *folders, "id", "_at", "_line.line")
        .sortWithinPartitions("kind", *folders, "id", "_at")
        .select("line", "kind", *folders)
        .write.partitionBy("kind", *folders)
        .text(staging)
    )
    folder = spark._jvm.org.apache.hadoop.fs.Path
    files = folder(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for kind in kinds:
        new, old = folder(f"{staging}/kind={kind}"), folder(f"{path}/{kind}")
        files.delete(old, True)
        if not (files.rename(new, old) if files.exists(new) else files.mkdirs(old)):
            raise OSError(f"{path}/{kind} could not be put in place; its lines are in {staging}")
    files.delete(folder(staging), True)


def write_line_pairs(lines: DataFrame, path: str, in_place: bool = False) -> None:
    """``(id, source, target, split)`` as aligned text under ``path/source`` and
    ``path/target``, replacing what is there; ``in_place`` renames nothing."""
    kinds = {kind: F.col(kind) for kind in ("source", "target")}
    write = _write_in_place if in_place else _write_aligned
    write(lines.select("id", "split", *kinds), path, kinds, ["split"])


def write_bucketed_corpus(corpus: DataFrame, path: str, table: str, buckets: int) -> DataFrame:
    """``corpus`` as Parquet under ``path``, dealt by ``doc_id`` into ``buckets`` files,
    and registered as ``table``, which comes back.

    This is the one shuffle of its texts: joins by ``doc_id`` with that table (the
    complement, style rows, splits and labels of documents) exchange the other side
    only. The number of buckets is kept with the files, in the metadata of
    ``doc_id``. Neither ``path`` nor ``table`` may hold anything yet. Rows without an
    id, which no join by id returns, share a bucket.
    """
    key = F.col("doc_id").alias("doc_id", metadata={BUCKETS: buckets})
    dealt = corpus.withColumn("doc_id", key).repartition(buckets, "doc_id")
    dealt.write.format("parquet").option("path", path).bucketBy(buckets, "doc_id").saveAsTable(table)
    return corpus.sparkSession.table(table)


def write_line_table(lines: DataFrame, path: str) -> None:
    """``(id, source, target, split)`` as Parquet by split: one pass, no ordering
    shuffle. The form to prefer where text files are not required."""
    lines.write.mode("overwrite").partitionBy("split").parquet(path)


def write_topic_lines(lines: DataFrame, path: str) -> None:
    """``(id, topic_name, split, line)`` as text by topic and split."""
    order = ["topic_name", "split"]
    (
        lines.repartitionByRange(*order, "id")
        .sortWithinPartitions(*order, "id")
        .select("line", *order)
        .write.mode("overwrite")
        .partitionBy(*order)
        .text(path)
    )


def write_style_rows(rows: DataFrame, path: str, split_files: bool = True, in_place: bool = False) -> None:
    """``(id, label_name, split, source, target)`` as text by class and split:
    aligned ``source`` and ``target`` folders, or one ``pair`` folder with both on
    a line. Classes without rows get no folder."""
    folders = ["label_name", "split"]
    lines = rows.select(
        "id", *folders, clean_line(F.col("source")).alias("source"), clean_line(F.col("target")).alias("target")
    )
    if split_files:
        kinds = {"source": F.col("source"), "target": F.col("target")}
    else:
        kinds = {"pair": single_line_pair(F.col("source"), F.col("target"))}
    write = _write_in_place if in_place else _write_aligned
    write(lines, path, kinds, folders)
