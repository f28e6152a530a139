"""Quality by a generalised additive model with pairwise interactions.

A text becomes a few counts and shares, measured on whole batches of bytes. Each
feature is cut into bins, and the model is an intercept, one table of additions
per feature and one per interacting pair of features. The tables are learned by
cyclic boosting: round after round, every feature in turn (later every pair)
gets a shallow tree on its own bins, fitted to the gradient of the logistic loss
and added with a small rate; as the features take turns, none can claim what
another explains as well. Scoring looks up bins and adds, vectorised.

Fitting uses a bounded sample of labelled rows (``FIT_ROWS``, the first by a hash
of the id); the feature rows of the sample, a few numbers each, are collected.

Defined cases: null and empty texts have all features 0 and are scored as such;
labels of null or of unknown ids are ignored, several labels of an id count as
their mean; without labels of both kinds every score is the smoothed share of
label 1. Labels, language, source and id are never features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labeltext.llm.common import SLICE_BYTES, slices, text_bytes

FIT_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 10
ROUNDS, PAIR_ROUNDS, RATE = 200, 60, 0.1
LEAST_ROWS, PENALTY = 5, 1.0

FEATURES = [
    "log_chars", "log_words", "word_length", "upper", "digits", "symbols", "sentence_marks", "shouts",
    "breaks", "beyond_ascii", "distinct_words", "repeats_last", "distinct_lines", "single_letters", "wordless", "bars",
]


def _classes() -> np.ndarray:
    """A bit mask of character classes for every byte."""
    table = np.zeros(256, np.uint8)
    for c in range(128):
        char = chr(c)
        mask = char.isupper() * 1 + char.isdigit() * 2 + (char in "#$%&*+=<>@\\^_`{}[]~|/") * 4
        mask += (char in ".!?") * 8 + (char in "!?") * 16 + (char == "\n") * 32 + char.isalpha() * 64
        table[c] = mask
    table[128:] = 64 + 128
    return table


CLASSES = _classes()
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive offsets."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of FEATURES per text, from UTF-8 bytes and offsets."""
    if not len(data):
        return np.zeros((len(at) - 1, len(FEATURES)))
    kind, space = CLASSES[data], SPACE[data]
    count = lambda bit: _sums((kind & bit) > 0, at)
    chars = _sums((data & 0xC0) != 0x80, at)
    # A word starts where no space is and a space or the text's start stands before.
    start = ~space
    start[1:] &= space[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    start[first] = ~space[first]
    word_at = np.flatnonzero(start)
    words_of = np.searchsorted(word_at, at)
    words = np.diff(words_of)
    stop = np.ones(len(data), bool)
    stop[:-1] = space[1:]
    stop[first[first > 0] - 1] = True
    word_end = np.flatnonzero(stop & ~space) + 1
    letters = np.concatenate([[0], np.cumsum((kind & 64) > 0, dtype=np.int64)])
    size = word_end - word_at
    wordless = _sums((letters[word_end] - letters[word_at]) == 0, words_of)
    alone = _sums(size == 1, words_of)
    raw = data.tobytes()
    distinct, again, lines = np.zeros(len(words)), np.zeros(len(words)), np.ones(len(words))
    for i, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist(), strict=False)):
        text = raw[a:b]
        own = text.split()
        distinct[i] = len(set(own))
        again[i] = sum(map(bytes.__eq__, own, own[1:]))
        rows = text.split(b"\n")
        lines[i] = len(set(rows)) / len(rows)
    per = lambda x, y: x / np.maximum(1, y)
    columns = [
        np.log1p(chars), np.log1p(words), per(_sums(~space, at), words), per(count(1), count(64)),
        per(count(2), chars), per(count(4), chars), per(count(8), words), per(count(16), words),
        per(count(32), words), per(count(128), chars), per(distinct, words), per(again, words),
        np.where(chars > 0, lines, 0), per(alone, words), per(wordless, words), per(_sums(data == ord("|"), at), words),
    ]
    return np.stack(columns, axis=1)


def text_features(column: pa.Array) -> np.ndarray:
    """FEATURES of the texts of an Arrow column, a bounded number of bytes at a time."""
    batch = pa.RecordBatch.from_arrays([column], ["t"])
    parts = [features(*text_bytes(part.column(0))) for part in slices(batch, "t", SLICE_BYTES)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


@dataclass
class Additive:
    """Intercept and tables; ``edges`` and ``coarse`` cut a feature into bins."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray]

    def logits(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for i, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, i], side="right")]
        if self.pairs:
            bins = [np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.coarse)]
            for (i, j), table in self.pairs.items():
                total += table[bins[i], bins[j]]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def cut_points(values: np.ndarray, bins: int) -> np.ndarray:
    """Up to ``bins - 1`` edges between quantiles of the values."""
    return np.unique(np.quantile(values, np.arange(1, bins) / bins, method="higher"))


def shallow_tree(gradient: np.ndarray, hessian: np.ndarray, count: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Leaf values on ordered bins: the best split, then the best split of a part."""
    cuts = [0, len(gradient)]
    g, h, n = (np.concatenate([[0], np.cumsum(x)]) for x in (gradient, hessian, count))

    def gain(a, b):
        return (g[b] - g[a]) ** 2 / (h[b] - h[a] + PENALTY)

    while len(cuts) - 1 < leaves:
        best, where = 1e-9, None
        for a, b in zip(cuts, cuts[1:], strict=False):
            at = np.arange(a + 1, b)
            at = at[(n[at] - n[a] >= LEAST_ROWS) & (n[b] - n[at] >= LEAST_ROWS)]
            if len(at):
                won = gain(a, at) + gain(at, b) - gain(a, b)
                if won.max() > best:
                    best, where = won.max(), int(at[won.argmax()])
        if where is None:
            break
        cuts = sorted([*cuts, where])
    values = [(g[b] - g[a]) / (h[b] - h[a] + PENALTY) for a, b in zip(cuts, cuts[1:], strict=False)]
    return np.repeat(values, np.diff(cuts))


def cross_tree(gradient: np.ndarray, hessian: np.ndarray) -> tuple[np.ndarray, float]:
    """Leaf values on a grid of two features' bins, one cut of each, and their gain."""
    g, h = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (gradient, hessian))
    rows, columns = np.arange(1, len(gradient)), np.arange(1, gradient.shape[1])
    if not len(rows) or not len(columns):
        return np.zeros_like(gradient), 0.0

    def quarters(total):
        low = total[np.ix_(rows, columns)]
        top, left, whole = total[rows, -1][:, None], total[-1, columns][None], total[-1, -1]
        return np.stack([low, top - low, left - low, whole - top - left + low])

    gq, hq = quarters(g), quarters(h)
    gains = (gq**2 / (hq + PENALTY)).sum(axis=0) - g[-1, -1] ** 2 / (h[-1, -1] + PENALTY)
    i, j = np.unravel_index(gains.argmax(), gains.shape)
    value = gq[:, i, j] / (hq[:, i, j] + PENALTY)
    low, right = np.arange(len(gradient)) <= i, np.arange(gradient.shape[1]) <= j
    table = np.where(low[:, None], np.where(right, value[0], value[1]), np.where(right, value[2], value[3]))
    return table, float(gains[i, j])


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """A model of labels 0 or 1 from rows of FEATURES."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Additive(float(np.log(share / (1 - share))), [], [], [], {})
    wide = x.shape[1]
    if len(y) == 0 or y.min() == y.max():
        model.edges, model.tables = [np.zeros(0)] * wide, [np.zeros(1)] * wide
        return model
    model.edges = [cut_points(x[:, i], BINS) for i in range(wide)]
    model.coarse = [cut_points(x[:, i], PAIR_BINS) for i in range(wide)]
    bins = [np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    logits = np.full(len(y), model.intercept)

    def pulls() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logits))
        return y - p, p * (1 - p)

    counts = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, model.tables, strict=True)]
    for _ in range(ROUNDS):
        for i, (b, table) in enumerate(zip(bins, model.tables, strict=True)):
            gradient, hessian = pulls()
            step = shallow_tree(np.bincount(b, gradient, len(table)), np.bincount(b, hessian, len(table)), counts[i])
            table += RATE * step
            logits += RATE * step[b]
    coarse = [np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(model.coarse)]
    sides = [len(e) + 1 for e in model.coarse]

    def grids(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cell = coarse[i] * sides[j] + coarse[j]
        gradient, hessian = pulls()
        shape, cells = (sides[i], sides[j]), sides[i] * sides[j]
        return cell, np.bincount(cell, gradient, cells).reshape(shape), np.bincount(cell, hessian, cells).reshape(shape)

    strength = {(i, j): cross_tree(*grids(i, j)[1:])[1] for i, j in combinations(range(wide), 2)}
    for i, j in sorted(strength, key=lambda p: -strength[p])[:PAIRS]:
        model.pairs[i, j] = np.zeros((sides[i], sides[j]))
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in model.pairs.items():
            cell, gradient, hessian = grids(i, j)
            step, _ = cross_tree(gradient, hessian)
            table += RATE * step
            logits += RATE * step.ravel()[cell]
    return model


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, train: str, most: int = FIT_ROWS, key: str = "doc_id", text: str = "text"
) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``most`` labelled rows, the first by a hash of the id.

    ``train`` is an SQL condition on the id. A few numbers per row reach the driver.
    """
    known = labels.where(F.expr(train)).where(F.col(label).isNotNull() & F.col(key).isNotNull())
    known = known.groupBy(F.col(key).alias("of")).agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("of"), "of").limit(most))  # at most ``most`` pairs of numbers
    rows = docs.select(F.col(key).alias("of"), F.col(text).alias("text")).join(chosen, "of")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = text_features(batch.column("text"))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("of"), batch.column("label"), lists], ["of", "label", "x"])

    plain = rows.select("of", "label", "text")
    schema = T.StructType([plain.schema["of"], plain.schema["label"], T.StructField("x", T.ArrayType(T.DoubleType()))])
    found = sorted(map(tuple, plain.mapInArrow(run, schema).collect()))
    x = np.array([r[2] for r in found]).reshape(-1, len(FEATURES))
    return x, np.array([r[1] for r in found], float)


def score(text: Column | str, model: Additive) -> Column:
    """The score of a text column, 0 to 1, as a column of the same rows."""
    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(text_features(texts)))

    return scored(text)


def scores(docs: DataFrame, model: Additive, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, score)`` of every row."""
    return docs.select(key, score(F.col(text), model).alias("score"))
