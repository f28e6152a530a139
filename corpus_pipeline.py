"""The corpus pipeline: stages over ``documents``, each written and read again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labeltext.llm import chunks, exact, quality, queries, simhash
from labeltext.llm.common import checkpointed, documents, fresh, small_batches
from labeltext.session import ensure_checkpoint_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the additive model of ``labels.quality`` accepts."""
    small_batches(spark)
    model = queries.quality_model(spark, docs, sf_dir)
    return docs.where(quality.score(F.col("text"), model) >= 0.5)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for A-Z's case, the row with the largest id."""
    return exact.survivors(docs, keep="max")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every SimHash group (3 words, 3 bits) the row with the smallest id.

    Rows are told apart by a number of their own, fixed by a checkpoint: of rows
    with the same smallest id the first stays, rows without an id come after all
    others, and a row never goes because of another one that shares its id. Only the
    numbers of the rows that go meet the texts; their side is broadcast when Spark
    finds it small.
    """
    number, key = fresh(docs, "_number"), fresh(docs, "_key")
    rows = checkpointed(docs.withColumn(number, F.monotonically_increasing_id()))
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col(number).alias("number"))
    near = simhash.near_duplicates(rows.select(order.alias(key), "text"), words=3, distance=3, key=key)
    gone = near.where(F.col(f"{key}.number") != F.col("component_id.number")).select(F.col(f"{key}.number").alias(number))
    return rows.join(gone, number, "left_anti").select(*docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages cut out of every document but one; ``n_chars`` follows the text."""
    cut = chunks.deduplicated(docs)[0].select(*docs.columns)
    if "n_chars" not in docs.columns:
        return cut
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2048 tokens."""
    return queries.packed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("simhash", near_stage),
    ("substring_dedup", substring_stage),
    ("pattern_packing", packing_stage),
]

# The stages' models, fingerprints and token ids have no SQL form; tests hold the
# stages against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is a Parquet table in the shared checkpoint folder."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    docs = documents(spark, sf_dir)
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
