"""Exact duplicates by Patricia tries over length-and-hash partitions.

Texts are equal when identical after lower-casing A-Z. Every task first inserts
its own texts into a radix trie, so copies within a task leave it as one row
with a count: however many copies a text has, at most one per task and 8 MB of
input is shuffled. Rows are then dealt by (length, content hash) and sorted by
it; the receiving task inserts the full byte strings into a trie, whose terminal
nodes own the group: they hold the winning identifier and the number of rows.
Equality is decided by the trie, never by the hash. There is
no spill by subtree: the sort by (length, hash) takes its place. Equal texts arrive
next to each other, so once the trie exceeds its budget the whole of it is final at
the next change of (length, hash) and is given out and emptied; its memory does not
grow with the partition, and what must spill is Spark's own sort.

Defined cases: null and empty texts are equal; a null identifier loses to any
other, and a group of null identifiers only has a null owner; rows that repeat
count each, and of rows that tie in the identifier the one with the smaller text
(as bytes) owns the group; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from labeltext.llm.common import checkpointed, fresh, slices, text_bytes

# Bytes of text in a trie before it is given out at the next chance.
TRIE_BYTES = 8 << 20


class Node:
    __slots__ = ("children", "label", "owner")

    def __init__(self, label: bytes):
        self.label = label
        self.children: dict[int, Node] = {}
        self.owner: list | None = None


class PatriciaTrie:
    """A compressed radix trie of byte strings."""

    def __init__(self):
        self.root = Node(b"")

    def insert(self, key: bytes) -> Node:
        """The terminal node of ``key``, made if it is new."""
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                return child
            if key.startswith(child.label, at):
                at += len(child.label)
                node = child
                continue
            common = common_prefix(child.label, key[at : at + len(child.label)])
            upper = node.children[key[at]] = Node(child.label[:common])
            child.label = child.label[common:]
            upper.children[child.label[0]] = child
            node, at = upper, at + common
        return node


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by bisection over block comparisons."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Owners:
    """Rows inserted so far: one owner and a count per distinct text."""

    def __init__(self, key: str, text: str, count: str | None, keep: str):
        self.key, self.text, self.count, self.keep = key, text, count, keep
        self.trie, self.owners = PatriciaTrie(), []
        self.batches: list[pa.RecordBatch] = []
        self.rows = self.bytes = 0

    def _wins(self, new: tuple, old: tuple) -> bool:
        (new_id, new_text), (old_id, old_text) = new, old
        if new_id == old_id:
            return new_text < old_text
        if new_id is None or old_id is None:
            return old_id is None
        return new_id > old_id if self.keep == "max" else new_id < old_id

    def add(self, batch: pa.RecordBatch) -> None:
        data, at = text_bytes(batch.column(self.text))
        data, at = data.tobytes(), at.tolist()
        ids = batch.column(self.key).to_pylist()
        counts = batch.column(self.count).to_pylist() if self.count else [1] * len(ids)
        for i, (doc, n) in enumerate(zip(ids, counts, strict=True)):
            raw = data[at[i] : at[i + 1]]
            node = self.trie.insert(raw.lower())
            if node.owner is None:
                node.owner = [doc, raw, n, self.rows + i]
                self.owners.append(node.owner)
            else:
                node.owner[2] += n
                if self._wins((doc, raw), tuple(node.owner[:2])):
                    node.owner[0], node.owner[1], node.owner[3] = doc, raw, self.rows + i
        self.batches.append(batch)
        self.rows += batch.num_rows
        self.bytes += len(data)

    def winners(self) -> tuple[pa.Table, list[int]]:
        """The owning rows, and the number of rows that each stands for."""
        rows = pa.array([o[3] for o in self.owners], pa.int64())
        return pa.Table.from_batches(self.batches).take(rows), [o[2] for o in self.owners]


def _given_out(owners: Owners, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The owners as batches, with their counts, lengths and hashes as further columns."""
    if not owners.rows:
        return
    table, counts = owners.winners()
    texts = [o[1].lower() for o in owners.owners]
    added = [
        pa.array(counts, pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array(np.array([xxh64_intdigest(t) for t in texts], np.uint64).view(np.int64)),
    ]
    names = [c for c in table.column_names if c not in columns]
    whole = pa.Table.from_arrays([*(table.column(c) for c in names), *added], [*names, *columns])
    yield from whole.combine_chunks().to_batches()


def owners(docs: DataFrame, keep: str = "max", key: str = "doc_id", text: str = "text") -> tuple[DataFrame, list[str]]:
    """One row of ``docs`` per distinct text, the one with the largest (``keep="max"``)
    or smallest (``"min"``) identifier, with three further columns, whose names
    are returned too: rows in the group, length and hash of the normalised text."""
    if keep not in ("max", "min"):
        raise ValueError(f"keep must be max or min, not {keep}")
    added = [fresh(docs, name) for name in ("_copies", "_length", "_hash")]
    count, length, digest = added
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in added)])

    def before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Owners(key, text, None, keep)
        for whole in batches:
            for batch in slices(whole, text):
                held.add(batch)
                if held.bytes >= TRIE_BYTES:
                    yield from _given_out(held, added)
                    held = Owners(key, text, None, keep)
        yield from _given_out(held, added)

    def after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = Owners(key, text, count, keep), None
        for whole in batches:
            for batch in slices(whole, text):
                lengths, hashes = batch.column(length).to_numpy(), batch.column(digest).to_numpy()
                start = 0
                if held.bytes >= TRIE_BYTES:
                    other = np.flatnonzero((lengths != last[0]) | (hashes != last[1]))
                    start = int(other[0]) if len(other) else batch.num_rows
                    held.add(batch.slice(0, start))
                    if len(other):
                        yield from _given_out(held, added)
                        held = Owners(key, text, count, keep)
                    else:  # still the same text: keep its one owner
                        held = _compacted(held, added)
                if start < batch.num_rows:
                    held.add(batch.slice(start))
                last = lengths[-1], hashes[-1]
        yield from _given_out(held, added)

    dealt = docs.mapInArrow(before, schema).repartition(length, digest).sortWithinPartitions(length, digest)
    return dealt.mapInArrow(after, schema), added


def _compacted(held: Owners, added: list[str]) -> Owners:
    smaller = Owners(held.key, held.text, held.count, held.keep)
    for batch in _given_out(held, added):
        smaller.add(batch)
    return smaller


def survivors(docs: DataFrame, keep: str = "max", key: str = "doc_id", text: str = "text") -> DataFrame:
    """The owning row of every group, with the columns of ``docs``."""
    return owners(docs, keep, key, text)[0].select(*docs.columns)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, text_sha256)`` of every row: the digest of its normalised text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                data, at = text_bytes(batch.column(text))
                data, at = data.tobytes().lower(), at.tolist()
                found = [sha256(data[a:b]).hexdigest() for a, b in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(found, pa.string())], [key, "text_sha256"])

    narrow = docs.select(key, text)
    return narrow.mapInArrow(run, T.StructType([narrow.schema[key], T.StructField("text_sha256", T.StringType())]))


def groups(docs: DataFrame, keep: str = "max", key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, keep_id, group_size, kept, text_sha256)`` of every row of ``docs``.

    The tries' owners are named by their digest, and every row finds its owner by
    the digest of its own text: the wide texts are shuffled once, the rows are
    narrow. ``kept`` is true for the rows whose identifier is their group's.
    """
    owned, (count, _, _) = owners(docs.select(key, text), keep, key, text)
    named = owned.select(F.col(key).alias("keep_id"), F.col(count).alias("group_size"), text)
    named = checkpointed(_with_digest(named, text))
    rows = digests(docs, key, text).join(named, "text_sha256")
    return rows.select(key, "keep_id", "group_size", F.col(key).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def _with_digest(named: DataFrame, text: str) -> DataFrame:
    schema = T.StructType([named.schema["keep_id"], named.schema["group_size"], T.StructField("text_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_bytes(batch.column(text))
            data, at = data.tobytes().lower(), at.tolist()
            found = [sha256(data[a:b]).hexdigest() for a, b in zip(at, at[1:], strict=False)]
            columns = [batch.column("keep_id"), batch.column("group_size"), pa.array(found, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return named.mapInArrow(run, schema)
