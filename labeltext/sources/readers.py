"""Corpus and dictionary readers."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labeltext.fixed_values import BENCHMARK_CONFIGS
from labeltext.operators.corpus import assemble_splits, fan_out_splits
from labeltext.operators.vocabulary import build_vocabulary

RELATION_SCHEMA = (
    "id bigint, token array<string>, h struct<name:string>, t struct<name:string>, relation string"
)

# Metadata key of ``doc_id`` in the files of a bucketed corpus.
BUCKETS = "buckets"


def load_corpus(
    spark: SparkSession,
    path: str,
    config: str | None = None,
    split: str | None = None,
    format: str = "parquet",
    schema: str | None = None,
    **options,
) -> DataFrame:
    """A corpus stored as ``path[/config]``, usually with ``split=`` folders, so
    that choosing a split prunes partitions."""
    reader = spark.read.format(format).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    corpus = reader.load(path if config is None else str(PurePosixPath(path) / config))
    return corpus if split is None else corpus.where(F.col("split") == split)


def load_bucketed_corpus(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A corpus of ``write_bucketed_corpus``, for a session that does not know it yet:
    registers the files as ``table`` with the buckets they were written in."""
    schema = spark.read.parquet(path).schema
    buckets = schema["doc_id"].metadata.get(BUCKETS) if "doc_id" in schema.names else None
    if buckets is None:
        raise ValueError(f"{path} holds no corpus bucketed by doc_id")
    quoted = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {table} ({schema.toDDL()}) USING parquet "
        f"CLUSTERED BY (doc_id) INTO {int(buckets)} BUCKETS LOCATION '{quoted}'"
    )
    return spark.table(table)


def load_configs(
    spark: SparkSession, path: str, configs: list[str] = BENCHMARK_CONFIGS, **kwargs
) -> dict[str, DataFrame]:
    """Every configuration of a multi-task benchmark, each with its own schema."""
    return {config: load_corpus(spark, path, config, **kwargs) for config in configs}


def load_relation_records(
    spark: SparkSession, train: str, valid: str, schema: str = RELATION_SCHEMA
) -> DataFrame:
    """JSON-lines train and validation files; validation also serves as test."""
    reader = spark.read.schema(schema)
    corpus = assemble_splits({"train": reader.json(train), "val": reader.json(valid)})
    return fan_out_splits(corpus, {"val": ["val", "test"]})


def invert(entries: DataFrame, name: str = "name", relation: str = "relation", order: str = "pos") -> DataFrame:
    """``(relation, name)`` from entries name -> id; of several names with one id
    the last by ``order`` wins."""
    return entries.groupBy(F.col(relation).alias("relation")).agg(F.max_by(name, order).alias("name"))


def load_inverted_dictionary(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``(relation, name)`` from a JSON object name -> id.

    One JSON object is one value, so one task reads it whole. A dictionary too
    large for that is given as JSON ``lines`` instead, one object of any number of
    names each: they are read in parallel, and of several names with one id the
    last by file, line and place wins.
    """
    if lines:
        entries = spark.read.text(path).select(
            F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).alias("at"),
            F.posexplode(F.map_entries(F.from_json("value", "map<string,string>"))).alias("pos", "entry"),
        )
        entries = entries.withColumn("pos", F.struct("at", "pos"))
    else:
        entries = spark.read.text(path, wholetext=True).select(
            F.posexplode(F.map_entries(F.from_json("value", "map<string,string>"))).alias("pos", "entry")
        )
    return invert(entries.select("pos", F.col("entry.key").alias("name"), F.col("entry.value").alias("relation")))


def load_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value``: the lines of a text file, undecodable bytes replaced by U+FFFD."""
    return spark.read.text(path).select(F.make_valid_utf8("value").alias("value"))


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """``(token, token_id)`` from a file with one word per line, in file order."""
    lines = spark.read.text(path).select(
        F.col("value").alias("token"),
        F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).alias("at"),
    )
    return build_vocabulary(lines, "at")
