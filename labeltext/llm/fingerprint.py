"""Document fingerprints by one-permutation MinHash.

Each shingle of five words is hashed once. The hash's upper bits choose one of
``BINS`` bins, the rest is its value, and a bin keeps the least value. Empty bins
are filled by optimal densification: bin j tries the bins named by a hash of
(j, attempt), attempt after attempt, and takes the value of the first that was
not empty, so two texts with the same full bins fill the others alike. The
fingerprint is the lowest ``LOW_BITS`` bits of every bin, packed. Bins of
unrelated texts agree by chance in 2^-LOW_BITS of all cases; ``likeness`` takes
that bias out of the share of equal bins and estimates the Jaccard likeness.

``edited_fingerprints`` also fingerprints each text with its last third replaced
by the beginning of the next document (descending id, after the last the first).
Neighbours meet without a global sort in one task: ids are dealt into ranges, and
the first row of each range goes to the range before as well.

Defined cases: words are runs without white space; a text of fewer than five
words has one shingle of all its words; a null text is empty, and a text without
words has the empty fingerprint, which is like itself (1) and nothing else (0);
null ids come last; rows with the same id are ordered by their text; a single
row is its own next document; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from labeltext.llm.common import mix64, slices

BINS, LOW_BITS, WORDS = 256, 8, 5
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
MOST_WORDS = 200_000
# Ids sampled for each range.
SAMPLES = 20


class WordHashes(dict):
    """Numbers words and holds their 64-bit hashes."""

    def __init__(self):
        super().__init__()
        self.hashes: list[int] = []

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        self.hashes.append(xxh3_64_intdigest(word.encode(errors="surrogatepass")))
        return at

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of the texts, and the number of words of each."""
        if len(self) > MOST_WORDS:
            self.clear()
            self.hashes = []
        codes, sizes = [], []
        for text in texts:
            words = text.split()
            codes += map(self.__getitem__, words)
            sizes.append(len(words))
        return np.array(self.hashes, np.uint64)[np.array(codes, np.int64)], np.array(sizes, np.int64)


def shingles(words: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, and the row of each."""
    ends = np.cumsum(sizes)
    starts, factor = ends - sizes, np.uint64(0x9E3779B97F4A7C15)
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    total = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for i in range(width):
        total = total * factor + words[i : i + len(total)]
    row = np.repeat(np.arange(len(sizes)), sizes)
    inside = row[: len(total)] == row[width - 1 :] if len(total) else np.zeros(0, bool)
    few = []
    for r in short.tolist():
        value = np.uint64(sizes[r])
        for word in words[starts[r] : ends[r]]:
            value = (np.array([value]) * factor + word)[0]
        few.append(value)
    hashes = np.concatenate([total[inside], np.array(few, np.uint64)])
    return mix64(hashes), np.concatenate([row[: len(total)][inside], short])


def densified(bins: np.ndarray) -> np.ndarray:
    """Bins of each row with the empty ones filled from full ones of the row."""
    count = bins.shape[1]
    empty = bins == EMPTY
    full = ~empty
    row, bin_ = np.nonzero(empty & full.any(axis=1)[:, None])
    out, attempt = bins.copy(), 0
    while len(row):
        attempt += 1
        probe = mix64(bin_.astype(np.uint64) + np.uint64(attempt << 20)) % np.uint64(count)
        found = full[row, probe.astype(np.int64)]
        out[row[found], bin_[found]] = bins[row[found], probe[found].astype(np.int64)]
        row, bin_ = row[~found], bin_[~found]
    return out


def signatures(hashes: np.ndarray, row: np.ndarray, rows: int, bins: int = BINS, low_bits: int = LOW_BITS):
    """The low bits of every bin of every row (uint8), and which rows have shingles."""
    upper = int(bins).bit_length() - 1
    place = row * bins + (hashes >> np.uint64(64 - upper)).astype(np.int64)
    values = np.full(rows * bins, EMPTY)
    np.minimum.at(values, place, hashes & np.uint64((1 << (64 - upper)) - 1))
    values = values.reshape(rows, bins)
    some = np.zeros(rows, bool)
    some[row] = True
    return (densified(values) & np.uint64((1 << low_bits) - 1)).astype(np.uint8), some


def packed(low: np.ndarray, some: np.ndarray, low_bits: int = LOW_BITS) -> list[str]:
    """Fingerprints in hex digits: low_bits per bin; empty without shingles."""
    bits = (low[:, :, None] >> np.arange(low_bits - 1, -1, -1)) & 1
    rows = np.packbits(bits.reshape(len(low), -1), axis=1)
    return [r.tobytes().hex() if s else "" for r, s in zip(rows, some, strict=True)]


def likeness(a: np.ndarray, some_a: np.ndarray, b: np.ndarray, some_b: np.ndarray, low_bits: int = LOW_BITS) -> np.ndarray:
    """Estimated Jaccard likeness, corrected for chance agreement and held to 0 .. 1."""
    chance = 2.0**-low_bits
    share = (a == b).mean(axis=1) if len(a) else np.zeros(0)
    estimate = np.clip((share - chance) / (1 - chance), 0, 1)
    return np.where(some_a & some_b, estimate, (some_a == some_b).astype(float))


def fingerprinted(texts: list[str], words: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    return signatures(*shingles(*words.of(texts), WORDS), len(texts))


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by the first as many letters of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def ranges(docs: DataFrame, order: str, count: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Bounds that deal ``order`` descending into about ``count`` ranges, and for each
    range in use the (range, order) of the first row of the next, round to the first."""
    total = docs.count()
    every = max(1, total // (count * SAMPLES))
    # About count * SAMPLES numbers reach the driver, whatever the size of the table.
    sample = docs.where(F.pmod(F.xxhash64(order), F.lit(every)) == 0).select(order).collect()
    sample = np.sort(np.array([r[0] for r in sample], np.int64))
    bounds = np.unique(sample[:: max(1, len(sample) // count)]) if len(sample) else np.zeros(0, np.int64)
    heads = docs.groupBy(_range(order, bounds).alias("range")).agg(F.max(order).alias("head")).orderBy("range").collect()
    used = [(r["range"], r["head"]) for r in heads]
    return bounds, [(used[i][0], used[(i + 1) % len(used)][1]) for i in range(len(used))]


def _range(order: str, bounds: np.ndarray):
    """The number of the range, 0 with the largest values."""
    @F.arrow_udf("int")
    def dealt(values: pa.Array) -> pa.Array:
        return pa.array(len(bounds) - np.searchsorted(bounds, values.to_numpy(), side="right"), pa.int32())

    return dealt(F.col(order))


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``."""
    order = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"), order.alias("at"))
    count = max(2 * rows.rdd.getNumPartitions(), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds, following = ranges(rows.select("at"), "at", count)
    own = rows.withColumn("range", _range("at", bounds)).withColumn("tail", F.lit(0))
    # One row per range in use (ties of a head's id aside), so at most ``count`` numbers.
    heads = docs.sparkSession.createDataFrame(following, "range int, at long")
    tails = rows.join(F.broadcast(heads), "at").withColumn("tail", F.lit(1))
    names = ["range", "tail", "at", "key", "text"]
    dealt = own.select(names).unionByName(tails.select(names)).repartitionById(len(bounds) + 1, F.col("range"))
    ordered = dealt.sortWithinPartitions("range", "tail", F.desc("at"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, carried = WordHashes(), None
        for whole in batches:
            for batch in slices(whole, "text"):
                part = pa.Table.from_batches([batch] if carried is None else [carried, batch]).combine_chunks()
                yield from _compared(part, words, key)
                carried = part.slice(part.num_rows - 1).to_batches()[0]

    schema = T.StructType([
        T.StructField(key, docs.schema[key].dataType), T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ])
    return ordered.mapInArrow(run, schema)


def _compared(part: pa.Table, words: WordHashes, key: str) -> Iterator[pa.RecordBatch]:
    """Results of all rows of ``part`` but the last, whose next row is not there yet."""
    tail = part.column("tail").to_numpy()[:-1]
    at = np.flatnonzero(tail == 0)
    if not len(at):
        return
    texts = part.column("text").to_pylist()
    changed = [edited(a, b) for a, b in pairwise(texts)]
    low, some = fingerprinted(texts, words)
    low_edited, some_edited = fingerprinted(changed, words)
    near_edited = likeness(low[:-1], some[:-1], low_edited, some_edited)
    near_next = likeness(low[:-1], some[:-1], low[1:], some[1:])
    prints, edited_prints = packed(low[:-1], some[:-1]), packed(low_edited, some_edited)
    columns = [
        part.column("key").combine_chunks().take(pa.array(at)),
        pa.array([len(texts[i]) for i in at], pa.int64()),
        pa.array([sha256(changed[i].encode()).hexdigest() for i in at], pa.string()),
        pa.array([prints[i] for i in at], pa.string()),
        pa.array([edited_prints[i] for i in at], pa.string()),
        pa.array(near_edited[at]),
        pa.array(near_next[at]),
    ]
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    yield pa.RecordBatch.from_arrays(columns, names)
