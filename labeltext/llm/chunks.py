"""Substring dedup by content-defined chunks of a gear rolling hash.

Chunks. A gear hash rolls over the bytes (shifted sum of a random number per
byte, over the last 16 bytes). At every word's end it has a value that depends
on nothing else, and a chunk ends at the words whose value is the least of some
``WINDOW`` words in a row. Cuts therefore move with the text: an insertion
changes the chunks around it only, and within a passage at most WINDOW - 1 words
at either end (and the words of its first 16 bytes) lie outside chunks that
every copy of the passage has. Chunks are 6 to 7 words long on average.

Dedup. Chunks are compared by a 128-bit digest. Each document sends every
distinct digest once; per digest the smallest document id owns it (combined
map-side, so a passage that a third of all documents hold is one row per task).
The digests of two or more documents meet the chunks again, in a join of two
plain shuffles that adaptive execution splits where it is skewed. A chunk repeats
if a document with a smaller id owns it, or if it stands earlier in its own
document. Runs of repeated chunks of ``least_words`` words or more are cut out;
shorter runs, such as phrases, stay. A digest's owner never loses it, so every
passage stays somewhere. With ``least_words`` = 20 each repeated passage of 51
words is found for certain: even of one-letter words at most 8 have a hash that
reaches out of the passage, and between the first and the last certain cut lie
51 - 8 - (2 * 12 - 1) = 20 words or more. Shorter ones down to 20 words are found
with falling chance. The words of a found passage outside these cuts stay. Chunks
end at white space only, so a passage without any is one word.

Defined cases: null and empty texts have no chunks and stay as they are; a null
id counts as larger than any other; rows with the same id never own each other's
chunks, so rows that repeat keep their text alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_digest

from labeltext.llm.common import checkpointed, fresh, mix64, slices, text_bytes

HASH_BYTES = 16
WINDOW = 12
LEAST_WORDS = 20
LAST_ID = (1 << 63) - 1

GEAR = (mix64(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


@dataclass
class Chunks:
    """Chunks of the texts of a batch, in order; offsets are bytes of the batch."""

    text: np.ndarray
    index: np.ndarray  # within its text
    start: np.ndarray
    end: np.ndarray
    words: np.ndarray
    digest: np.ndarray  # two 64-bit numbers
    repeated: np.ndarray  # stands earlier in the same text
    base: np.ndarray  # the first chunk of each text


def gear_hash(data: np.ndarray) -> np.ndarray:
    """The gear hash of the HASH_BYTES bytes up to each byte."""
    h, width = GEAR[data], 1
    while width < HASH_BYTES:
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint32(width)
        h, width = wider, 2 * width
    return h * np.uint32(0x9E3779B1)


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row, by doubling."""
    have, least = 1, values
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    rest = width - have
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def chunked(data: np.ndarray, at: np.ndarray) -> Chunks:
    rows = len(at) - 1
    space = SPACE[data]
    first = at[:-1][at[:-1] < at[1:]]
    start = ~space
    start[1:] &= space[:-1]
    start[first] = ~space[first]
    word_start = np.flatnonzero(start)
    stop = np.ones(len(data), bool)
    stop[:-1] = space[1:]
    stop[first[first > 0] - 1] = True
    word_end = np.flatnonzero(stop & ~space)
    words_of = np.searchsorted(word_start, at)
    word_text = np.repeat(np.arange(rows), np.diff(words_of))
    chunk_word = np.zeros(0, np.int64)  # words after which a chunk ends
    if len(word_end) >= WINDOW:
        value = gear_hash(data)[word_end].astype(np.uint64)
        value[word_end - at[word_text] < HASH_BYTES - 1] = 0xFFFFFFFF
        place = np.uint64(0xFFFFFFFF) - np.arange(len(value), dtype=np.uint64)
        least = window_least((value << np.uint64(32)) | place, WINDOW)
        whole = word_text[: len(least)] == word_text[WINDOW - 1 :]
        chosen = np.zeros(len(value), bool)
        chosen[(np.uint64(0xFFFFFFFF) - (least[whole] & np.uint64(0xFFFFFFFF))).astype(np.int64)] = True
        chosen[words_of[1:][words_of[1:] > words_of[:-1]] - 1] = False  # a text's last word ends it anyway
        chunk_word = np.flatnonzero(chosen) + 1
    text_start = np.flatnonzero(at[:-1] < at[1:])
    starts = np.concatenate([at[text_start], word_start[chunk_word]])
    order = np.argsort(starts, kind="stable")
    starts = starts[order]
    text = np.concatenate([text_start, word_text[chunk_word]])[order] if len(starts) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    last = np.ones(len(text), bool)
    last[:-1] = text[1:] != text[:-1]
    ends[last] = at[text[last] + 1]
    base = np.searchsorted(text, np.arange(rows + 1))
    raw = data.tobytes()
    pairs = zip(starts.tolist(), ends.tolist(), strict=True)
    digest = np.frombuffer(b"".join([xxh3_128_digest(raw[a:b].rstrip()) for a, b in pairs]), np.int64).reshape(-1, 2)
    sorted_ = np.lexsort((np.arange(len(text)), digest[:, 1], digest[:, 0], text))
    same = (np.diff(text[sorted_]) == 0) & (np.diff(digest[sorted_], axis=0) == 0).all(axis=1)
    repeated = np.zeros(len(text), bool)
    repeated[sorted_[1:][same]] = True
    words = np.searchsorted(word_start, ends) - np.searchsorted(word_start, starts)
    return Chunks(text, np.arange(len(text)) - base[text], starts, ends, words, digest, repeated, base)


def chunk_rows(docs: DataFrame, order: str, salt: str, text: str) -> DataFrame:
    """``(hi, lo, owner, place)``: a row per distinct chunk of each row of ``docs``.

    ``order`` and ``salt`` are columns (long, int) that name the row; ``place``
    packs the salt and the chunk's number.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                found = chunked(*text_bytes(batch.column(text)))
                once = ~found.repeated
                of = found.text[once]
                salts = batch.column(salt).to_numpy()[of].astype(np.int64)
                columns = [
                    found.digest[once, 0], found.digest[once, 1], batch.column(order).to_numpy()[of],
                    (salts << 32) | found.index[once],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["hi", "lo", "owner", "place"])

    return docs.select(order, salt, text).mapInArrow(run, "hi long, lo long, owner long, place long")


def repeated_chunks(rows: DataFrame) -> DataFrame:
    """``(owner, salt, chunks)``: the numbers of each row's chunks that a smaller id owns.

    Equal rows of one id have the same chunks, which count once, combined map-side."""
    owners = rows.groupBy("hi", "lo").agg(F.min("owner").alias("least"), F.max("owner").alias("most"))
    shared = checkpointed(owners.where("least < most").select("hi", "lo", "least"))
    found = rows.join(shared, ["hi", "lo"]).where("least < owner")
    salt, chunk = F.shiftright("place", 32).cast("int"), F.col("place").bitwiseAND(0xFFFFFFFF).cast("int")
    return found.groupBy("owner", salt.alias("salt")).agg(F.collect_set(chunk).alias("chunks"))


def cut_runs(found: Chunks, repeated: np.ndarray, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and end (bytes of the batch) of every run of repeated chunks that goes."""
    edge = np.zeros(len(repeated), bool)
    edge[1:] = found.text[1:] != found.text[:-1]
    new = repeated.copy()
    new[1:] &= ~repeated[:-1] | edge[1:]
    first = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    at = np.flatnonzero(repeated)
    words = np.bincount(run[at], found.words[at], len(first))
    last = np.zeros(len(first), np.int64)
    last[run[at]] = at
    long = words >= least_words
    return found.text[first[long]], found.start[first[long]], found.end[last[long]]


def deduplicated(
    docs: DataFrame, least_words: int = LEAST_WORDS, key: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, str]:
    """``docs`` with repeated passages cut out of the text, and one more column, whose
    name is returned too: the spans cut, as code points of the original text."""
    order, salt, spans = fresh(docs, "_order"), fresh(docs, "_salt"), fresh(docs, "_spans")
    named = docs.withColumn(order, F.coalesce(F.col(key).cast("long"), F.lit(LAST_ID)))
    named = named.withColumn(salt, F.hash(F.coalesce(text, F.lit(""))))
    marked = repeated_chunks(chunk_rows(named, order, salt, text))
    marks = fresh(docs, "_chunks")
    marked = marked.select(F.col("owner").alias(order), F.col("salt").alias(salt), F.col("chunks").alias(marks))
    joined = named.join(marked, [order, salt], "left").select(*docs.columns, marks)
    span_type = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField(spans, span_type)])

    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                texts, cuts = _cut(batch, text, marks, least_words)
                columns = [texts if c == text else batch.column(c) for c in names]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(cuts, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    [*names, spans],
                )

    return joined.mapInArrow(run, schema), spans


def _cut(batch: pa.RecordBatch, text: str, marks: str, least_words: int) -> tuple[pa.Array, list[list[dict]]]:
    data, at = text_bytes(batch.column(text))
    found = chunked(data, at)
    repeated = found.repeated.copy()
    lists = batch.column(marks)
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    of = np.repeat(np.arange(len(sizes)), sizes)
    repeated[found.base[of] + lists.flatten().to_numpy()] = True
    row, start, end = cut_runs(found, repeated, least_words)
    texts = batch.column(text)
    cuts: list[list[dict]] = [[] for _ in range(batch.num_rows)]
    if not len(row):
        return texts, cuts
    texts = texts.to_pylist()
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    for i in np.unique(row).tolist():
        own = row == i
        spans = list(zip(points[start[own]] - points[at[i]], points[end[own]] - points[at[i]], strict=True))
        cuts[i] = [{"start": int(a), "end": int(b)} for a, b in spans]
        kept, before = [], 0
        for a, b in spans:
            kept.append(texts[i][before:a])
            before = b
        texts[i] = "".join([*kept, texts[i][before:]])
    return pa.array(texts, pa.string()), cuts
