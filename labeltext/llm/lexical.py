"""Ranked lexical search by an Aho-Corasick scan of the documents.

There is no index of the documents. The distinct terms of the items become one
automaton (Aho & Corasick 1975) whose patterns carry a blank at both ends; a text is
brought to the same form (each character that belongs to no term becomes a blank, A-Z
lower case), so a pattern matches whole terms only, and one walk over the text
finds every occurrence of every term. The automaton's output is the number of a term; a
table from terms to items spreads its weight over the items that hold it.

A first scan adds up per task how many documents hold each term, how many documents
and terms there are; a second one, with the weights, keeps in each task the best ``k``
documents of every item, and only those are shuffled. Nothing per document, and no
posting, is ever written.

Items come through the driver in blocks of ``BLOCK_BYTES`` of text, at least one item
each, and each block's automaton is broadcast: its size follows from that bound, not
from the number of items. More blocks mean more scans. In a task, texts are taken in
slices of bounded bytes, and scores of a slice are sums over (document, item) cells that
hold a term, so memory follows the slice and its items.

Terms are maximal runs of ASCII letters, digits and non-ASCII characters. Scores are
whole numbers, as ``ranked`` states them.

Defined cases: null and empty texts hold no terms and are counted nowhere; a repeated
document row is a document of its own; rows without ``doc_id`` count in all statistics
and rank last among equal scores; a repeated item row is an item of its own, so its id
occurs with every rank twice; items without terms, and items none of whose terms
occur, have no rows; an empty table on either side gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labeltext.llm.common import SLICE_BYTES, slices, text_bytes

TOP = 20
BLOCK_BYTES = 2 << 20
BLANK = 32
# Final lists are cut once per group of tasks before all lists of an item meet.
GROUPS = 64


def _forms() -> np.ndarray:
    """What each byte becomes: ASCII signs a blank, A-Z lower case, all else itself."""
    table = np.arange(256, dtype=np.uint8)
    for code in range(128):
        if not chr(code).isalnum():
            table[code] = BLANK
        elif chr(code).isupper():
            table[code] = code + 32
    return table


FORMS = _forms()


def normal(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts in the automaton's form, a blank before each and at the end, and where
    the blank before each text stands."""
    first = at[:-1] + np.arange(len(at) - 1)
    out = np.full(len(data) + len(at), BLANK, np.uint8)
    keep = np.ones(len(out), bool)
    keep[first] = False
    keep[-1] = False
    out[keep] = FORMS[data]
    return out, first


def terms_of(text: str | None) -> list[str]:
    """The terms of a text, as UTF-8 read byte by byte."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    return FORMS[data].tobytes().decode("latin-1").split(" ")


@dataclass
class Block:
    """Some items: their ids, their distinct terms, and where the terms belong."""

    item_ids: list
    terms: list[str]
    first: np.ndarray  # per term, where its items begin
    items: np.ndarray
    times: np.ndarray  # how often the item holds the term

    def automaton(self) -> ahocorasick.Automaton:
        trie = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for number, term in enumerate(self.terms):
            trie.add_word(f" {term} ", number)
        trie.make_automaton()
        return trie


def block_of(rows: list[tuple]) -> Block:
    counts = [Counter(t for t in terms_of(text) if t) for _, text in rows]
    terms = sorted(set().union(*counts)) if counts else []
    number = {t: i for i, t in enumerate(terms)}
    cells = sorted((number[t], item, n) for item, c in enumerate(counts) for t, n in c.items())
    term, item, times = np.array(cells, np.int64).reshape(-1, 3).T
    return Block([r[0] for r in rows], terms, np.searchsorted(term, np.arange(len(terms) + 1)), item, times)


def blocks(items: DataFrame, most_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The items in blocks of bounded text, through the driver one block at a time."""
    rows, size = [], 0
    for item_id, text in items.toLocalIterator():
        rows.append((item_id, text))
        size += 64 + len((text or "").encode())
        if size >= most_bytes:
            yield block_of(rows)
            rows, size = [], 0
    if rows:
        yield block_of(rows)


def occurrences(batch: pa.RecordBatch, text: str, trie: ahocorasick.Automaton) -> tuple[np.ndarray, ...]:
    """Terms per document of a batch, and its cells (document, term, tf), by document."""
    data, at = text_bytes(batch.column(text))
    out, first = normal(data, at)
    inside = out != BLANK
    begins = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    n = np.diff(np.searchsorted(begins, np.append(first, len(out))))
    walk = trie.iter(out.tobytes().decode("latin-1")) if len(trie) else ()
    found = np.fromiter(chain.from_iterable(walk), np.int64).reshape(-1, 2)
    # A match ends on the blank after its term, which may be the one before the next text.
    doc = np.searchsorted(first, found[:, 0] - 1, side="right") - 1
    code, tf = np.unique(doc * max(1, len(trie)) + found[:, 1], return_counts=True)
    return n, code // max(1, len(trie)), code % max(1, len(trie)), tf.astype(np.int64)


def statistics(docs: DataFrame, block: Block, text: str = "text") -> tuple[int, int, np.ndarray]:
    """``(N, L, df per term)``: documents with a term, terms of all, documents per term."""
    shared = docs.sparkSession.sparkContext.broadcast(block.terms)
    terms = len(block.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Block([], shared.value, None, None, None).automaton()
        sums = np.zeros(terms + 2, np.int64)
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                n, _, term, _ = occurrences(part, text, trie)
                sums[:terms] += np.bincount(term, minlength=terms)[:terms]
                sums[terms] += int((n > 0).sum())
                sums[terms + 1] += int(n.sum())
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["i", "n"])

    rows = docs.select(text).mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    sums = np.zeros(terms + 2, np.int64)
    for row in rows:
        sums[row.i] = row.n
    shared.unpersist()
    return int(sums[terms]), int(sums[terms + 1]), sums[:terms]


class Best:
    """The best ``k`` documents of every item of a task: score, then least id."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.floor = np.ones(items, np.int64)  # less than this cannot enter
        self.item, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))
        self.null = np.zeros(0, bool)

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        """Candidates join those kept, and all but the best ``k`` of each item go."""
        enter = score >= self.floor[item]
        item = np.concatenate([self.item, item[enter]])
        score = np.concatenate([self.score, score[enter]])
        doc = np.concatenate([self.doc, doc[enter]])
        null = np.concatenate([self.null, null[enter]])
        order = np.lexsort((doc, null, -score, item))
        item, score, doc, null = item[order], score[order], doc[order], null[order]
        start = np.flatnonzero(np.diff(item, prepend=-1))
        place = np.arange(len(item)) - np.repeat(start, np.diff(np.append(start, len(item))))
        last = place == self.k - 1
        self.floor[item[last]] = score[last]
        keep = place < self.k
        self.item, self.score, self.doc, self.null = item[keep], score[keep], doc[keep], null[keep]


def best_of_tasks(
    docs: DataFrame, block: Block, n_docs: int, n_terms: int, df: np.ndarray, k: int, key: str, text: str
) -> DataFrame:
    """``(item, doc_id, score)``: the best ``k`` documents of each item, of each task."""
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((block, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weight = shared.value
        trie, best = block.automaton(), Best(len(block.item_ids), k)
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                n, doc, term, tf = occurrences(part, text, trie)
                m = 75 + 25 * n * n_docs // max(1, n_terms)
                gain = weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
                # The outputs of a cell: every item that holds its term.
                many = block.first[term + 1] - block.first[term]
                cell = np.repeat(np.arange(len(term)), many)
                at = block.first[term][cell] + np.arange(len(cell)) - np.repeat(np.cumsum(many) - many, many)
                code = doc[cell] * len(block.item_ids) + block.items[at]
                pair, place = np.unique(code, return_inverse=True)
                score = np.zeros(len(pair), np.int64)
                np.add.at(score, place, gain[cell] * block.times[at])
                ids = part.column(key)
                null = ids.is_null().to_numpy(zero_copy_only=False)
                number = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                of = pair // max(1, len(block.item_ids))
                best.add(pair % max(1, len(block.item_ids)), score, number[of], null[of])
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.item.astype(np.int32)), pa.array(best.doc, mask=best.null), pa.array(best.score)],
            ["item", "doc_id", "score"],
        )

    given = docs.select(F.col(key).cast("long").alias(key), text)
    return given.mapInArrow(run, "item int, doc_id long, score long")


def ranked(
    docs: DataFrame, items: DataFrame, k: int = TOP, key: str = "doc_id", text: str = "text", most_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of every item.

    With N documents that hold a term, L terms in all, n in a document, df documents
    with a term and tf occurrences in one: w = floor(1000 ln((2N+2)/(2df+1))),
    m = 75 + 25nN div L, and an item's terms, repeats included, add up
    w * (10^9 tf div (1000 tf + 12 m)). Only scores above 0 count; equal scores rank
    by ascending ``doc_id``.
    """
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for block in blocks(items.select("item_id", "text"), most_bytes):
        if not block.terms:
            continue
        n_docs, n_terms, df = statistics(docs, block, text)
        found = best_of_tasks(docs, block, n_docs, n_terms, df, k, key, text)
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        grouped = found.withColumn("group", F.pmod(F.xxhash64("doc_id"), F.lit(GROUPS)))
        first = F.row_number().over(Window.partitionBy("item", "group").orderBy(*order))
        place = F.row_number().over(Window.partitionBy("item").orderBy(*order))
        few = grouped.withColumn("rank", first).where(F.col("rank") <= k)
        last = few.withColumn("rank", place).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(block.item_ids)), f"item int, item_id {kind}")
        out = out.unionByName(last.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out
