"""The given tables seen as the inputs the operators expect.

A split, topic or class is assigned to every row; no row is left out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labeltext.operators.scale import spread
from labeltext.session import ensure_checkpoint_dir
from labeltext.sources.readers import load_corpus
from labeltext.sources.writers import write_bucketed_corpus


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return load_corpus(spark, f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """The documents, on all cores."""
    return spread(table(spark, folder, "documents"), "doc_id")


def _split(key: str) -> Column:
    return F.when(F.col(key) % 5 == 0, "test").otherwise("train")


def news(spark: SparkSession, folder: str) -> DataFrame:
    """The language is the class: its rank among the languages that occur."""
    rows = table(spark, folder, "documents").select("lang").where("lang IS NOT NULL").distinct()
    languages = sorted(r.lang for r in rows.collect())  # as many as there are languages
    position = F.array_position(F.array(*[F.lit(v) for v in languages]).cast("array<string>"), F.col("lang"))
    return texts(spark, folder).select(
        "doc_id", "text", (F.nullif(position, F.lit(0)) - 1).cast("int").alias("label"), _split("doc_id").alias("split")
    )


def bucketed_news(spark: SparkSession, folder: str) -> DataFrame:
    """``news`` written once by ``doc_id``, so that joins by it leave the texts in place."""
    name = f"news_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return write_bucketed_corpus(news(spark, folder), f"{ensure_checkpoint_dir(spark)}/{name}", name, buckets)


def sentiment(spark: SparkSession, folder: str) -> DataFrame:
    """Two-class corpus: the quality label."""
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    return texts(spark, folder).select("doc_id", "text", _split("doc_id").alias("split")).join(labels, "doc_id")


def sentence_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """A user turn and the assistant turn after it."""
    turns = table(spark, folder, "conversations")
    user = turns.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("sentence1"))
    reply = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("sentence2")
    )
    tenth = F.col("conv_id") % 10
    return user.join(reply, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("id"),
        "sentence1",
        "sentence2",
        (F.col("conv_id") % 2).cast("int").alias("label"),
        F.when(tenth == 0, "test").when(tenth == 1, "validation").otherwise("train").alias("split"),
    )


def summaries(spark: SparkSession, folder: str) -> DataFrame:
    """A text and its first line."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"),
        "text",
        F.substring_index("text", "\n", 1).alias("target"),
        _split("doc_id").alias("split"),
    )


def relations(spark: SparkSession, folder: str) -> DataFrame:
    """A customer and the nation they belong to, as a relation record."""
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return (
        table(spark, folder, "customer")
        .select("c_custkey", "c_name", "c_nationkey")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("c_custkey").alias("id"),
            F.array("c_name", F.lit("of"), "n_name").alias("token"),
            F.struct(F.col("n_name").alias("name")).alias("h"),
            F.struct(F.col("c_name").alias("name")).alias("t"),
            F.when(F.col("n_regionkey") < 3, "R1").otherwise("R2").alias("relation"),
        )
    )


def relation_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("R1", "buyer"), ("R2", "customer")], "relation string, name string")


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """Texts under ten topics."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("best_answer"),
        (F.col("doc_id") % 10).cast("int").alias("topic"),
        _split("doc_id").alias("split"),
    )


def two_labelings(spark: SparkSession, folder: str) -> DataFrame:
    """Language class ``a`` and quality/toxicity class ``b`` of labelled documents."""
    labels = table(spark, folder, "labels").select(
        "doc_id", (F.col("quality") * 2 + F.col("toxic")).cast("int").alias("b")
    )
    return (
        news(spark, folder).select("doc_id", F.col("label").alias("a")).join(labels, "doc_id")
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("features"), "label"
    )


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """A probability from the text length, with the quality label as truth."""
    p = 1.0 / (1.0 + F.exp(-(F.col("n_chars") - 1000) / 1000.0))
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").cast("double").alias("y"))
    return (
        table(spark, folder, "documents")
        .select("doc_id", "source", p.alias("p"))
        .join(labels, "doc_id")
        .select(F.col("doc_id").alias("id"), "source", "p", "y")
    )
