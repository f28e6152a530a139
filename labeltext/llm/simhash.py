"""SimHash near duplicates by a Gray-order hierarchical index.

A fingerprint has a bit set where more than half of a text's shingle hashes have
it. Distinct fingerprints within ``distance`` bits are linked, and components of
links are the groups.

Search. Two fingerprints that differ in at most d of some bits agree on one of
d + 1 blocks of them. Each fingerprint goes to d + 1 buckets, one per block of
its 64 bits; a bucket of more than ``BUCKET`` fingerprints splits again by d + 1
blocks of its remaining bits, and so on: fixing bits bounds a bucket, nothing is
capped, and no link is lost. Inside a bucket the fingerprints are sorted by Gray
rank, where neighbours share most bits. Every eight neighbours get a node that
holds the bits they all share, eight nodes get an upper node, up to the bucket's
root. Pairs of nodes go down from the root: at each level only shared bits that
the nodes above had not compared are compared, the differences add up, and a
pair of groups is pruned as a whole once they exceed the distance. A bucket
returns not its links but a spanning star of each of its components, so the
result grows with the fingerprints, not with the pairs.

Defined cases: null and empty texts have fingerprint 0, which links like any
other; rows without an id take part, and a component of such rows only has
component_id null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from labeltext.llm.common import checkpointed, components, joined, slices, text_bytes

SEED = 42
BITS = 64
# A bucket with more fingerprints is split further; a task works on about BATCH at a time.
BUCKET = 4096
BATCH = 1 << 16
FAN_OUT = 8
# Pairs of nodes compared in one step.
FRONTIER = 1 << 20


def shingle_hashes(data: bytes, words: int) -> list[int]:
    """XXH64 of each shingle of ``words`` words of an ASCII-lowered text, repeats included."""
    found = data.lower().split()
    if len(found) <= words:
        return [xxh64_intdigest(b" ".join(found), SEED)] if found else []
    shingles = zip(*(found[i:] for i in range(words)), strict=False)
    return [xxh64_intdigest(s, SEED) for s in map(b" ".join, shingles)]


def majority_bits(hashes: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """For each row a fingerprint: the bits set in over half of its hashes."""
    bits = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
    total = np.bincount(row, minlength=rows)
    prints = np.zeros(rows, np.uint64)
    for byte in range(8):
        values = ((hashes >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.int64)
        seen = np.bincount(row * 256 + values, minlength=rows * 256).reshape(rows, 256) @ bits
        most = (2 * seen > total[:, None]).astype(np.uint64)
        prints |= (most << np.arange(8 * byte, 8 * byte + 8, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return prints


def fingerprints(docs: DataFrame, words: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, fp)`` of every row, fp as a signed 64-bit integer."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                data, at = text_bytes(batch.column(text))
                data = data.tobytes()
                hashes, sizes = [], []
                for a, b in zip(at.tolist(), at[1:].tolist(), strict=False):
                    own = shingle_hashes(data[a:b], words)
                    hashes += own
                    sizes.append(len(own))
                row = np.repeat(np.arange(len(sizes)), sizes)
                prints = majority_bits(np.array(hashes, np.uint64), row, len(sizes))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key), pa.array(prints.view(np.int64))], [key, "fp"]
                )

    narrow = docs.select(key, text)
    return narrow.mapInArrow(run, T.StructType([narrow.schema[key], T.StructField("fp", T.LongType())]))


def gray_rank(fp: Column) -> Column:
    """The position of ``fp`` in Gray order, as a signed number that sorts like it."""
    rank = fp
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank.bitwiseXOR(F.lit(-(1 << 63)))


def blocks(free: int, parts: int) -> list[int]:
    """The bits of mask ``free``, split into ``parts`` masks of neighbouring bits."""
    bits = [i for i in range(BITS) if free >> i & 1]
    edges = [len(bits) * i // parts for i in range(parts + 1)]
    return [sum(1 << i for i in bits[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def buckets(prints: DataFrame, distance: int, most: int) -> DataFrame:
    """``(mask, value, fp)``: fingerprints that agree in the bits of a mask meet.

    ``prints(fp)`` holds distinct fingerprints. Every two of them within the
    distance share at least one returned bucket, and no bucket exceeds ``most``
    unless all its bits are fixed, when it holds one fingerprint.
    """
    if most < 1 << distance:
        raise ValueError("a bucket must hold all fingerprints that differ in the last few free bits")
    whole = (1 << BITS) - 1
    masks = blocks(whole, distance + 1)
    rows = _keyed(prints, [signed(m) for m in masks])
    done = None
    while True:
        full = checkpointed(rows.groupBy("mask", "value").agg(F.count("*").alias("n")).where(F.col("n") > most))
        hot = full.isEmpty()
        kept = rows if hot else rows.join(full, ["mask", "value"], "left_anti")
        done = kept if done is None else done.unionByName(kept)
        if hot:
            return done
        # The bits of a bucket's mask are fixed; its next masks add a block of the others.
        finer = [(m, m | b) for m in masks for b in blocks(whole & ~m, distance + 1)]
        parents = F.array(*[F.struct(F.lit(signed(a)).alias("of"), F.lit(signed(b)).alias("to")) for a, b in finer])
        crowded = rows.join(full.select("mask", "value"), ["mask", "value"], "left_semi")
        # The same fingerprint and mask can come from two parents; one row is enough.
        next_rows = crowded.select("fp", F.explode(F.filter(parents, lambda p: p["of"] == F.col("mask"))).alias("m"))
        next_rows = next_rows.select(F.col("m.to").alias("mask"), F.expr("fp & m.to").alias("value"), "fp").distinct()
        rows = checkpointed(next_rows)
        masks = list(dict.fromkeys(b for _, b in finer))


def _keyed(prints: DataFrame, masks: list[int]) -> DataFrame:
    exploded = prints.select("fp", F.explode(F.array(*map(F.lit, masks))).alias("mask"))
    return exploded.select("mask", F.expr("fp & mask").alias("value"), "fp")


def nodes_above(group: np.ndarray, ones: np.ndarray, shared: np.ndarray):
    """One level of the index: every FAN_OUT neighbours of a group under one node.

    Returns the nodes' group, common ones, shared bits and first child.
    """
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    inside = np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))
    first = np.flatnonzero(inside % FAN_OUT == 0)
    all_ones = np.bitwise_and.reduceat(ones, first)
    all_zeros = np.bitwise_and.reduceat(shared & ~ones, first)
    return group[first], all_ones, all_ones | all_zeros, np.append(first, len(group))


def linked(group: np.ndarray, prints: np.ndarray, distance: int) -> np.ndarray:
    """Component labels (positions) of fingerprints, sorted by group and Gray rank.

    Links exist within a group, between fingerprints at most ``distance`` apart.
    """
    levels = [(group, prints, np.full(len(prints), ~np.uint64(0)), None)]
    while len(levels[-1][0]) > len(np.unique(levels[-1][0])):
        levels.append(nodes_above(*levels[-1][:3]))
    label = np.arange(len(prints))
    root = np.arange(len(levels[-1][0]))
    stack = [(len(levels) - 1, root, root, np.zeros(len(root), np.uint8))]
    while stack:
        level, a, b, apart = stack.pop()
        if level == 0:
            label = joined(label, a, b)
            continue
        _, _, shared, first = levels[level]
        _, below_ones, below_shared, _ = levels[level - 1]
        wide_a, wide_b = first[a + 1] - first[a], first[b + 1] - first[b]
        pairs = np.cumsum(wide_a * wide_b)
        if pairs[-1] > FRONTIER and len(a) > 1:
            half = len(a) // 2
            stack += [(level, a[:half], b[:half], apart[:half]), (level, a[half:], b[half:], apart[half:])]
            continue
        of = np.repeat(np.arange(len(a)), wide_a * wide_b)
        place = np.arange(pairs[-1]) - np.repeat(pairs - wide_a * wide_b, wide_a * wide_b)
        x = first[a[of]] + place // wide_b[of]
        y = first[b[of]] + place % wide_b[of]
        once = x < y if level == 1 else x <= y
        x, y, of = x[once], y[once], of[once]
        fresh_bits = below_shared[x] & below_shared[y] & ~(shared[a[of]] & shared[b[of]])
        apart = apart[of] + np.bitwise_count((below_ones[x] ^ below_ones[y]) & fresh_bits)
        near = apart <= distance
        if near.any():
            stack.append((level - 1, x[near], y[near], apart[near]))
    return label


def links(prints: DataFrame, distance: int = 3, most: int = BUCKET) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints ``prints(fp)``, whose components
    are those of all links at ``distance`` or fewer bits."""
    placed = buckets(prints, distance, most).withColumn("rank", gray_rank(F.col("fp")))
    placed = placed.repartition("mask", "value").sortWithinPartitions("mask", "value", "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for mask, value, fp in _whole_groups(batches):
            new = (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])
            group = np.concatenate([[0], np.cumsum(new)])
            label = linked(group, fp.view(np.uint64), distance)
            # The star's centre is the component's smallest fingerprint, in whatever bucket.
            least = np.full(len(fp), np.iinfo(np.int64).max)
            np.minimum.at(least, label, fp)
            centre = least[label]
            apart = centre != fp
            yield pa.RecordBatch.from_arrays([pa.array(fp[apart]), pa.array(centre[apart])], ["a", "b"])

    return placed.select("mask", "value", "fp").mapInArrow(run, "a long, b long")


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of the sorted batches, put together or cut between groups at about BATCH rows."""
    held: list[list[np.ndarray]] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy() for c in batch.columns])
        rows += batch.num_rows
        if rows < BATCH:
            continue
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        new = np.flatnonzero((columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1]))
        if len(new):
            cut = new[-1] + 1
            yield [c[:cut] for c in columns]
            columns = [c[cut:] for c in columns]
        held, rows = [columns], len(columns[0])
    if rows:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def near_duplicates(
    docs: DataFrame, words: int = 3, distance: int = 3, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(key, fp, component_id)`` of every row: component_id is the least id of its group."""
    prints = checkpointed(fingerprints(docs, words, key, text))
    distinct = checkpointed(prints.groupBy("fp").agg(F.min(key).alias("least")))
    roots = components(links(distinct.select("fp"), distance)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = checkpointed(rooted)
    ids = checkpointed(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    named = checkpointed(rooted.join(ids, "root").select("fp", "component_id"))
    return prints.join(named, "fp").select(key, "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    """16 lowercase hex digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
