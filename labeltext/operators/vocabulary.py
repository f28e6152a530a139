"""Vocabulary tables and id sequences.

A vocabulary is ``(token, token_id)``: padding 0, unknown 1, mask 2, words from 3.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labeltext.fixed_values import FIRST_WORD_ID, MASK, MASK_ID, PAD, PAD_ID, UNK, UNK_ID
from labeltext.functions.text import pad_ids
from labeltext.operators.scale import is_small, join_counted, with_row_index, with_running_total
from labeltext.session import ensure_checkpoint_dir

SPECIAL_IDS = {PAD: PAD_ID, UNK: UNK_ID, MASK: MASK_ID}
BROADCAST_WORDS = 1_000_000


def build_vocabulary(word_list: DataFrame, order: str | None = None) -> DataFrame:
    """Ids for a word list ``(token, ..)`` in the order of ``order`` (default: the
    tokens' own). A repeated token keeps its last id."""
    # The last place of a token decides, so its others only count: a place is one
    # row per token, however often the token is repeated.
    if order is None:
        places = word_list.groupBy("token").agg(F.count("*").alias("n"))
        numbered = with_running_total(places, ["token"], "n", "row_index")
    else:
        numbered = with_row_index(word_list.select("token", order), [order])
    spark = word_list.sparkSession
    special = spark.createDataFrame(list(SPECIAL_IDS.items()), "token string, token_id bigint")
    words = numbered.select("token", (F.col("row_index") + FIRST_WORD_ID).alias("token_id"))
    return special.unionByName(words).groupBy("token").agg(
        F.max("token_id").cast("int").alias("token_id")
    )


def vocabulary_tokens(vocabulary: DataFrame) -> DataFrame:
    """All tokens by id."""
    return vocabulary.orderBy("token_id").select("token")


def longest(rows: DataFrame, sequence: str) -> DataFrame:
    """The length of the longest sequence, as one row."""
    return rows.agg(F.max(F.size(sequence)).alias("max_len"))


def encode(rows: DataFrame, vocabulary: DataFrame, sequence: str, ids: str = "ids") -> DataFrame:
    """``rows`` with ``ids``: the id of each word of ``sequence``, unknown words as id 1.

    A vocabulary that a bounded read finds small goes to the tasks, which look up the
    distinct words of a batch in it, so rows stay where they are. Otherwise words meet
    the vocabulary by joins, for which ``doc_id`` must be unique.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    vocabulary = vocabulary.select("token", "token_id").checkpoint()
    if is_small(vocabulary, BROADCAST_WORDS, "token"):
        return rows.withColumn(ids, _lookup(vocabulary)(F.col(sequence)))
    return _joined(rows, vocabulary, sequence, ids)


def _lookup(vocabulary: DataFrame) -> Callable[[Column], Column]:
    """Ids of an array of words, by a table that is known to be small."""
    table = vocabulary.toArrow()
    shared = vocabulary.sparkSession.sparkContext.broadcast((table.column("token").to_pylist(), table.column("token_id").to_pylist()))
    ready: dict[str, int] = {}  # built once per Python worker

    @F.arrow_udf("array<int>")
    def look_up(words: pa.Array) -> pa.Array:
        if not ready:
            ready.update(zip(*shared.value, strict=True))
        codes = words.flatten().dictionary_encode(null_encoding="encode")
        known = pa.array([ready.get(w, UNK_ID) for w in codes.dictionary.to_pylist()], pa.int32())
        at = np.append(0, np.cumsum(words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(at), known.take(codes.indices))

    return look_up


def _joined(rows: DataFrame, vocabulary: DataFrame, sequence: str, ids: str) -> DataFrame:
    """``encode`` by joins: each distinct word is looked up once and ``join_counted``
    spreads the result, so that neither frequent nor unknown words make a hot key."""
    carried = [c for c in rows.columns if c != sequence]
    words = rows.select(*carried, F.posexplode(sequence).alias("pos", "token"))
    asked = words.groupBy("token").agg(F.count("*").alias("n"))
    found = join_counted(words, asked.join(vocabulary, "token", "left"), ["token"], "n")
    token_id = F.coalesce("token_id", F.lit(UNK_ID)).alias("token_id")
    # The row's other columns ride along with its first word, so that one
    # grouping by document gives the whole row back; the words are its own.
    others = [c for c in rows.columns if c not in ("doc_id", sequence)]
    first = [F.when(F.col("pos") == 0, F.col(c)).alias(c) for c in others]
    one = F.struct("pos", token_id, "token")
    ordered = found.select("doc_id", *first, one.alias("one")).groupBy("doc_id").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in others],
        F.sort_array(F.collect_list("one")).alias("_ids"),
    )
    encoded = ordered.withColumn(sequence, F.col("_ids.token")).withColumn(ids, F.col("_ids.token_id"))
    empty = rows.where(F.coalesce(F.size(sequence), F.lit(0)) <= 0)
    empty = empty.withColumn(ids, F.array().cast("array<int>"))
    return encoded.select(*rows.columns, ids).unionByName(empty.select(*rows.columns, ids))


def encode_padded(
    rows: DataFrame, vocabulary: DataFrame, sequence: str, to_len: int | None = None
) -> DataFrame:
    """``encode`` cut or padded to ``to_len``, by default the longest sequence."""
    length = to_len
    if length is None:
        length = longest(rows, sequence).scalar()
    else:
        rows = rows.withColumn(sequence, F.slice(sequence, 1, to_len))
    encoded = encode(rows, vocabulary, sequence)
    return encoded.withColumn("ids", pad_ids(F.col("ids"), length, PAD_ID))
