"""Sequence packing by length patterns and non-negative least squares.

1. Every document longer than the capacity is cut into pieces of exactly that
   length; only its first piece may be shorter.
2. The histogram of piece lengths, at most ``capacity`` numbers whatever the
   corpus, goes to the driver. There all patterns of at most ``pattern_docs``
   lengths that fill a sequence exactly are enumerated, and repeat counts are
   fitted to the histogram by non-negative least squares (accelerated projected
   gradient; every column has at most ``pattern_docs`` entries, so a step costs
   as much as the patterns have). Counts are rounded and held to what is there;
   the rest of the histogram is packed best fit, longest first.
3. The plan is a table of intervals: the ``i``-th piece of some length belongs to
   the interval that holds ``i``, which names sequence and offset. Pieces get
   their ``i`` from a range-partitioned order, so no length, however frequent,
   meets in one task, and the table is bounded by the capacity.

Results: the sequences are gapless from offset 0. ``pack_pieces`` takes lengths
1 .. capacity and raises on others; an empty table gives no pieces, nor does an
empty list of ids (``token_pieces`` closes every text by an end id, so none is
empty there). Ties
among equal lengths are ordered by the key columns; rows that repeat are packed
each for itself.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labeltext.llm import bpe
from labeltext.llm.common import checkpointed, ragged

Plan = list[tuple[tuple[int, ...], int]]


def patterns(lengths: np.ndarray, capacity: int, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All patterns of 2 .. ``docs`` (at most 3) of ``lengths`` that sum to the capacity.

    Returned as three aligned arrays of lengths, 0 where a pattern has only two.
    """
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    a = np.flatnonzero(there)
    a = a[(a > 0) & (2 * a <= capacity)]
    pairs = a[there[capacity - a]]
    found = [(pairs, capacity - pairs, np.zeros_like(pairs))]
    if docs >= 3:
        for low in a[3 * a <= capacity]:
            mid = np.arange(low, (capacity - low) // 2 + 1)
            mid = mid[there[mid] & there[capacity - low - mid]]
            found.append((np.full(len(mid), low), mid, capacity - low - mid))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def fit(columns: tuple[np.ndarray, ...], histogram: np.ndarray, rounds: int) -> np.ndarray:
    """Repeat counts x >= 0 with the least weighted squares of A x - histogram.

    A length weighs its share of the capacity: what a rest of long pieces costs
    in sequences, a rest of short ones does not.
    """
    size = len(histogram)
    weight = np.arange(size) / (size - 1)
    weight[0] = 0
    target = histogram * weight

    def forward(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(c, x, size) for c in columns) * weight

    def backward(r: np.ndarray) -> np.ndarray:
        r = r * weight
        return sum(r[c] for c in columns)

    x = np.zeros(len(columns[0]))
    step = np.ones(len(x))
    for _ in range(20):  # power iteration for the largest curvature
        step = backward(forward(step))
        norm = np.linalg.norm(step)
        step /= norm
    y, t = x, 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - backward(forward(y) - target) / (norm * 1.01))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def best_fit(histogram: np.ndarray, capacity: int) -> Plan:
    """Best fit, longest first, on counts: packs of one pattern move together."""
    open_packs: list[dict[tuple[int, ...], int]] = [defaultdict(int) for _ in range(capacity + 1)]
    spaces: set[int] = set()
    for length in range(capacity, 0, -1):
        left = int(histogram[length])
        while left:
            space = min((s for s in spaces if s >= length), default=None)
            if space is None:
                per = min(left, capacity // length)
                packs, pattern = left // per, (length,) * per
            else:
                pattern, there = open_packs[space].popitem()
                packs = min(there, left)
                if there > packs:
                    open_packs[space][pattern] = there - packs
                elif not open_packs[space]:
                    spaces.discard(space)
                pattern, per = (*pattern, length), 1
            rest = capacity - sum(pattern)
            open_packs[rest][pattern] += packs
            spaces.add(rest)
            left -= packs * per
    return [x for packs in open_packs for x in sorted(packs.items(), reverse=True)]


def plan(
    histogram: np.ndarray, pattern_docs: int = 3, rounds: int = 300, shares: tuple[float, ...] = (0.97, 0.75, 0.5)
) -> Plan:
    """Patterns with repeat counts that use up ``histogram`` (index: length) exactly.

    The fitted counts are spread thin over many patterns, so they are rounded by
    their running sum, which keeps the totals of neighbouring patterns. A share
    below 1 leaves best fit some freedom to end with few open packs; of the
    shares, the one with the fewest sequences is taken.
    """
    capacity = len(histogram) - 1
    full = int(histogram[capacity])
    rest = histogram.astype(np.int64).copy()
    rest[capacity] = 0
    whole: Plan = [((capacity,), full)] if full else []
    columns = patterns(np.flatnonzero(rest), capacity, pattern_docs)
    if not len(columns[0]):
        return whole + best_fit(rest, capacity)
    repeats = fit(columns, rest, rounds)
    plans = [_rounded(columns, repeats * share, rest) for share in shares]
    return whole + min(plans, key=lambda p: sum(times for _, times in p))


def _rounded(columns: tuple[np.ndarray, ...], repeats: np.ndarray, histogram: np.ndarray) -> Plan:
    """Patterns with whole counts that the histogram can serve, then its rest by best fit."""
    rest, plan_ = histogram.copy(), []
    counts = np.diff(np.floor(np.cumsum(repeats) + 1e-9), prepend=0).astype(np.int64)
    for at in np.flatnonzero(counts):
        pattern = tuple(sorted((int(c[at]) for c in columns if c[at]), reverse=True))
        times = int(min(counts[at], min(rest[x] // pattern.count(x) for x in pattern)))
        if times:
            plan_.append((pattern, times))
            for x in pattern:
                rest[x] -= times
    return plan_ + best_fit(rest, len(rest) - 1)


def intervals(plan_: Plan) -> np.ndarray:
    """Rows (length, first index, first sequence, offset), sorted by the first two."""
    taken: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for pattern, times in plan_:
        offset = 0
        for length in pattern:
            rows.append((length, taken[length], sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def cut(batches: Iterator[pa.RecordBatch], capacity: int, key: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Batches (key, piece, start, length, ids, ids_crc32) of batches (key, ids).

    Every list is closed by ``end_id``, so each has a piece at least.
    """
    for batch in batches:
        lists = batch.column("ids")
        ends = lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()
        values = np.insert(lists.flatten().to_numpy(), ends, end_id)
        sizes = np.diff(ends, prepend=0) + 1
        pieces = -(-sizes // capacity)
        row = np.repeat(np.arange(len(sizes)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = (sizes - (pieces - 1) * capacity)[row]
        start = np.where(piece == 0, 0, first + (piece - 1) * capacity)
        length = np.where(piece == 0, first, capacity)
        at = np.concatenate([[0], np.cumsum(length)])
        raw = memoryview(values.astype("<u4").tobytes())
        checks = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in pairwise(at.tolist())]
        columns = {
            key: batch.column(key).take(pa.array(row)),
            "piece": pa.array(piece, pa.int32()),
            "start": pa.array(start, pa.int64()),
            "length": pa.array(length, pa.int64()),
            "ids": ragged(pa.array(values, pa.int32()), at),
            "ids_crc32": pa.array(checks, pa.int64()),
        }
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def token_pieces(
    texts: DataFrame,
    path: str,
    capacity: int,
    key: str = "doc_id",
    text: str = "text",
    end_id: int = 0,
    with_ids: bool = True,
) -> DataFrame:
    """Encoded texts, each closed by ``end_id``, in pieces of at most ``capacity`` ids.

    Columns: key, piece, start (ids before it), length, ids (if ``with_ids``) and
    ids_crc32, the checksum of the ids as little-endian 32-bit numbers.
    """
    content = bpe.shipped(texts.sparkSession, path)
    narrow = texts.select(key, text)
    fields = [narrow.schema[key], T.StructField("piece", T.IntegerType())]
    fields += [T.StructField(c, T.LongType()) for c in ("start", "length")]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType(), False))] * with_ids
    schema = T.StructType([*fields, T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(bpe.encoded(batches, content.value, key, text, library=True), capacity, key, end_id):
            yield batch.select(schema.names)

    return narrow.mapInArrow(run, schema)


def pack_pieces(pieces: DataFrame, capacity: int, order: list[str], pattern_docs: int = 3) -> DataFrame:
    """``pieces`` (with a column ``length``) plus ``sequence_id`` and ``offset``.

    Only narrow columns should come in: they are checkpointed, range-partitioned
    by length and ``order`` and checkpointed again, so numbers never change under a retry.
    """
    pieces = checkpointed(pieces)  # read three times: counts, range bounds, order
    counts = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most capacity rows
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counts:
        if length is None or not 1 <= length <= capacity:
            raise ValueError(f"piece length {length} is outside 1..{capacity}")
        histogram[length] = n
    table = intervals(plan(histogram, pattern_docs))
    starts = np.concatenate([[0], np.cumsum(histogram)])[: capacity + 1]
    ordered = pieces.repartitionByRange("length", *order).sortWithinPartitions("length", *order)
    fixed = checkpointed(ordered.withColumn("_at", F.monotonically_increasing_id()))
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = fixed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition; the number of partitions bounds this broadcast.
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    ranked = fixed.withColumn("_part", part).join(F.broadcast(sizes), "_part")
    ranked = ranked.withColumn("_rank", F.col("_before") + inside).drop("_at", "_part", "_before")
    columns = [c for c in ranked.columns if c != "_rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            index = batch.column("_rank").to_numpy() - starts[length]
            low, high = np.searchsorted(table[:, 0], length), np.searchsorted(table[:, 0], length, side="right")
            while (low + 1 < high).any():  # the last interval of the length that starts at or below index
                mid = (low + high) // 2
                up = table[np.minimum(mid, len(table) - 1), 1] <= index
                wide = low + 1 < high
                low, high = np.where(wide & up, mid, low), np.where(wide & ~up, mid, high)
            row = table[low]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(row[:, 2] + index - row[:, 1]), pa.array(row[:, 3])],
                [*columns, "sequence_id", "offset"],
            )

    added = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    return ranked.mapInArrow(place, T.StructType([*(ranked.schema[c] for c in columns), *added]))

