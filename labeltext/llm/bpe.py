"""Byte-level BPE: encoding by a priority queue of merges, decoding by concatenation.

The vocabulary file is the ``tokenizers`` JSON form; its path is a parameter. It
is read on the driver and broadcast (a vocabulary does not grow with the data).

Encoding splits a text by the byte-level pattern into pieces. The symbols of a
piece form a doubly linked list; a heap holds (rank, position, left, right) of
the adjacent pairs that merge. The best entry is taken again and again: it is
skipped as stale if its symbols have changed since, else the pair becomes one
symbol and the new neighbours enter the heap. Pieces recur, so each task keeps a
bounded table of those it has encoded.

Ids of added tokens in a text ("<|endoftext|>") are recognised, as the library
does by default. ``encode``: null and empty texts give an empty list.
``decode``: null and empty lists give the empty text, ids outside the vocabulary
add nothing, bytes that are no UTF-8 become U+FFFD.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from tokenizers import Tokenizer, pre_tokenizers

from labeltext.llm.common import ragged, slices

# Fixed value: the published pattern of byte-level BPE.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The bytes that stand for themselves; the others become 256, 257 ..
PLAIN_BYTES = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

# Below this code point all Unicode versions agree, and the classes stay small.
NEAR = 0x558

MOST_PIECES = 300_000
MOST_IDS = 3_000_000


def byte_letters() -> list[str]:
    """The letter that writes each byte in the vocabulary file."""
    plain = set(PLAIN_BYTES)
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def near_pieces() -> re.Pattern:
    """PIECES for texts of code points below NEAR, with its classes written out."""
    def those(test) -> str:
        return "".join(re.escape(chr(c)) for c in range(NEAR) if test(chr(c)))

    letters = those(lambda c: unicodedata.category(c)[0] == "L")
    numbers = those(lambda c: unicodedata.category(c)[0] == "N")
    spaces = those(lambda c: regex.match(r"\s", c))
    return re.compile(
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+"
        rf"|[{spaces}]+(?![^{spaces}])|[{spaces}]+"
    )


class Splitter:
    """Splits a text into pieces exactly as the tokenizers library does.

    Texts of near code points, nearly all, take the small classes; others take
    the published pattern. Letters and numbers that one installed Unicode table
    knows and another does not are left to the library's own splitter.
    """

    def __init__(self):
        self.near, self.all = near_pieces(), regex.compile(PIECES)
        self.far = re.compile(f"[^\\x00-{chr(NEAR - 1)}]")
        self.disputed: regex.Pattern | None = None
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False)

    def _disputed(self) -> regex.Pattern:
        word = regex.compile(r"[\p{L}\p{N}\s]")
        odd = [c for c in map(chr, range(NEAR, 0x110000)) if unicodedata.category(c) == "Cn" and word.match(c)]
        spans, start = [], 0
        for i in range(1, len(odd) + 1):
            if i == len(odd) or ord(odd[i]) != ord(odd[i - 1]) + 1:
                spans.append(f"{odd[start]}-{odd[i - 1]}")
                start = i
        return regex.compile(f"[{''.join(spans)}]" if spans else r"(?!)")

    def __call__(self, text: str) -> list[str]:
        if not self.far.search(text):
            return self.near.findall(text)
        if self.disputed is None:
            self.disputed = self._disputed()
        if not self.disputed.search(text):
            return self.all.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]


class Vocabulary:
    """Tokens, merge ranks and added tokens of one vocabulary file."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type", "BPE") == "BPE" and before.get("type") == "ByteLevel"
        if not plain or before.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("not a byte-level BPE vocabulary without prefix space and normaliser")
        ids = model["vocab"]
        letter_byte = {c: b for b, c in enumerate(byte_letters())}
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", ())):
            raise ValueError("added tokens that strip or match words only are not supported")
        self.added = added
        self.byte_ids = [ids[c] for c in byte_letters()]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[left], ids[right]] = (rank, ids[left + right])
        tokens = [b""] * (max([*ids.values(), *added.values()]) + 1)
        for token, i in ids.items():
            tokens[i] = bytes(letter_byte[c] for c in token)
        for token, i in added.items():
            tokens[i] = token.encode()
        self.tokens = pa.array(tokens, pa.binary())

    def merged(self, piece: str) -> list[int]:
        """The ids of one piece after all merges, best rank and leftmost first."""
        symbols = [self.byte_ids[b] for b in piece.encode()]
        merges = self.merges
        n = len(symbols)
        if n < 2:
            return symbols
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        queue = []
        for at, pair in enumerate(pairwise(symbols)):
            found = merges.get(pair)
            if found:
                queue.append((found[0], at, *pair, found[1]))
        heapify(queue)
        while queue:
            _, at, left, right, new = heappop(queue)
            follow = after[at]
            if symbols[at] != left or follow >= n or symbols[follow] != right:
                continue  # stale: one of the two has been merged since
            symbols[at], symbols[follow] = new, -1
            end = after[at] = after[follow]
            if end < n:
                before[end] = at
                found = merges.get((new, symbols[end]))
                if found:
                    heappush(queue, (found[0], at, new, symbols[end], found[1]))
            start = before[at]
            if start >= 0:
                found = merges.get((symbols[start], new))
                if found:
                    heappush(queue, (found[0], start, symbols[start], new, found[1]))
        return [s for s in symbols if s >= 0]


class LibraryMerges:
    """The same ids of a piece from the tokenizers library, for those who only need ids."""

    def __init__(self, content: bytes):
        self.model = Tokenizer.from_str(content.decode()).model
        self.letters = dict(enumerate(byte_letters()))

    def __call__(self, piece: str) -> list[int]:
        letters = piece.encode().decode("latin-1").translate(self.letters)
        return [token.id for token in self.model.tokenize(letters)]


class Encoder(dict):
    """Encodes texts; as a dict, from a piece to its place in a table of ids.

    Pieces are merged by the priority queue above or, with ``library``, by the
    tokenizers library, which gives the same ids.
    """

    def __init__(self, content: bytes, library: bool = False):
        super().__init__()
        self.vocabulary = Vocabulary(content)
        self.merged = LibraryMerges(content) if library else self.vocabulary.merged
        self.pieces = Splitter()
        added = sorted(self.vocabulary.added, key=len, reverse=True)
        self.added = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.starts, self.ids = array("q", [0]), array("i")
        self.added_at = {}
        for token, i in self.vocabulary.added.items():
            self.added_at[token] = len(self.starts) - 1
            self.ids.append(i)
            self.starts.append(len(self.ids))

    def __missing__(self, piece: str) -> int:
        at = self[piece] = len(self.starts) - 1
        self.ids.extend(self.merged(piece))
        self.starts.append(len(self.ids))
        return at

    def _places(self, text: str):
        if self.added is None or not any(t in text for t in self.added_at):
            return map(self.__getitem__, self.pieces(text))
        return self._places_with_added(text)

    def _places_with_added(self, text: str):
        for part in self.added.split(text):
            if part in self.added_at:
                yield self.added_at[part]
            else:
                yield from map(self.__getitem__, self.pieces(part))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (int32), and the offsets of the texts in them."""
        if len(self.starts) > MOST_PIECES or len(self.ids) > MOST_IDS:
            self.forget()
        places, ends = [], [0]
        for text in texts:
            if text:
                places += self._places(text)
            ends.append(len(places))
        places = np.array(places, np.int32)
        starts, table = np.array(self.starts), np.array(self.ids)
        sizes = np.diff(starts)[places]
        at = np.concatenate([[0], np.cumsum(sizes)])
        ids = table[np.repeat(starts[places] - at[:-1], sizes) + np.arange(at[-1])]
        return ids, at[ends]


@lru_cache(maxsize=2)
def encoder(content: bytes, library: bool = False) -> Encoder:
    return Encoder(content, library)


def shipped(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary file, once per executor."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encoded(
    batches: Iterator[pa.RecordBatch], content: bytes, key: str, text: str, library: bool = False
) -> Iterator[pa.RecordBatch]:
    """Batches (key, ids) of batches that hold ``key`` and ``text``."""
    coder = encoder(content, library)
    for whole in batches:
        for batch in slices(whole, text):
            ids, at = coder.encode(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), ragged(pa.array(ids, pa.int32()), at)], [key, "ids"]
            )


def encode(texts: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ids array<int>)`` of every row, in the rows' partitions."""
    content = shipped(texts.sparkSession, path)
    narrow = texts.select(key, text)
    schema = T.StructType([narrow.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    return narrow.mapInArrow(lambda batches: encoded(batches, content.value, key, text), schema)


def decode(tokens: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``(key, ids, text)`` of every row: the vocabulary strings put together."""
    content = shipped(tokens.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = encoder(content.value).vocabulary.tokens
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                lists = part.column(ids)
                texts = pa.array(_texts(lists, table), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(key), lists, texts], [key, ids, "text"])

    narrow = tokens.select(key, ids)
    schema = T.StructType([*narrow.schema.fields, T.StructField("text", T.StringType())])
    return narrow.mapInArrow(run, schema)


def _texts(lists: pa.Array, table: pa.Array) -> list[str]:
    values = lists.flatten()
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(sizes)])
    numbers = values.fill_null(-1).to_numpy(zero_copy_only=False)
    known = (numbers >= 0) & (numbers < len(table))
    taken = table.take(pa.array(np.where(known, numbers, 0)))
    lengths = np.where(known, np.diff(np.frombuffer(taken.buffers()[1], np.int32)[: len(taken) + 1]), 0)
    if not known.all():
        taken = taken.filter(pa.array(known))
    ends = np.concatenate([[0], np.cumsum(lengths)])[at]
    data = taken.buffers()[2]
    data = b"" if data is None else data.to_pybytes()
    return [data[a:b].decode(errors="replace") for a, b in pairwise(ends.tolist())]
