"""Toxicity by a subsequence string kernel with Nyström landmarks.

The kernel of two words counts their common subsequences of three letters, each
weighed down by the gaps it spans, normalised and raised to a power (products of
kernels are kernels). Marks inside a word are left out and spelled-out words are put
together, so both count in full. A spelling with added letters keeps an insult's
subsequences, but the normalised kernel falls so far that most of them score below
one half (shares in the README). The kernel of two sentences is the sum over their
word pairs; with landmark words that is a vector of sums, whitened by the
landmarks' own kernel matrix (Nyström), and a linear support vector machine on
these vectors scores a sentence. A text has the score of its worst sentence.

Fitting works on a bounded sample of labelled texts (``FIT_TEXTS`` per class,
distinct texts, by a hash of the id) on the driver. Landmarks are the words that
cover the toxic texts greedily or are in most of them, and are rare in clean ones,
but for those too like another. Labelled sentences come from the texts' labels: every sentence of a clean
text is clean; of a toxic text the sentence that names a covering word, later the
one that scores highest, is toxic, the others are left out.

Scoring runs in the rows' partitions: every distinct word of a task is scored
once, a text costs table lookups. Kernels of a word with all landmarks are exact: every
three letters of the word, with whatever gaps, meet a table of the landmarks' own.
A word counts once a sentence. Runs
of single letters of one text ("i d i o t") count as one more word, longer words
than 48 letters as overlapping windows. A run has the score of its worst window,
among them all of a landmark's length, so an insult inside a spelled-out sentence
is not diluted. Fitting reads the same windows and runs; a word or run has the
vector of the window most like a landmark.

Defined cases: null and empty texts get the score of a sentence without words;
labels of null or of unknown rows are ignored, several labels of one id count as
the larger; with no toxic or no clean sample every score is the share of toxic
labels (0.5 without labels). Only texts are inputs of a score.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labeltext.llm.common import slices

FIT_TEXTS = 1500
COVERING, MOST_LANDMARKS, ALIKE = 64, 64, 0.65
ORDER, DECAY, POWER = 3, 0.9, 6
LONGEST = 48
MOST_WORDS = 200_000
BLOCK = 8192

MARKS = re.compile(r"[\W_]+")


def letters(words: list[str]) -> np.ndarray:
    """Code points of the words as a matrix, padded with -1."""
    sizes = np.array([len(w) for w in words])
    out = np.full((len(words), max(1, sizes.max(initial=0))), -1, np.int32)
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.int32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = points
    return out


def kernel(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Gap-weighted subsequence kernel of order ORDER of every row of ``s`` with
    the same row of ``t`` along the last axis; both are letter matrices that
    broadcast against each other but for that axis."""
    shape = np.broadcast_shapes(s.shape[:-1], t.shape[:-1])
    width = t.shape[-1]
    lag = np.arange(width)[None, :] - np.arange(width)[:, None]
    carry = np.where(lag >= 0, DECAY ** np.maximum(lag, 0), 0).astype(np.float32)
    t = np.where(t < 0, -2, t)
    heads = [np.zeros((*shape, width), np.float32) for _ in range(1, ORDER)]  # K'_l of the previous row
    total = np.zeros(shape, np.float32)
    for i in range(s.shape[-1]):
        match = (s[..., i, None] == t).astype(np.float32) * np.float32(DECAY * DECAY)
        match = np.broadcast_to(match, (*shape, width))
        before = np.zeros_like(heads[-1])
        before[..., 1:] = heads[-1][..., :-1]
        total += (match * before).sum(axis=-1)
        for order in range(ORDER - 2, -1, -1):
            if order:
                before = np.zeros_like(heads[order - 1])
                before[..., 1:] = heads[order - 1][..., :-1]
                new = match * before
            else:
                new = match
            heads[order] = np.float32(DECAY) * heads[order] + new @ carry
    return total


@cache
def subsequences(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the letters of all ORDER = 3 subsequences of a word of ``n`` letters, and their weights."""
    a, b, c = np.array(list(combinations(range(n), ORDER)), np.int32).reshape(-1, ORDER).T
    return a, b, c, (DECAY ** (c - a + 1)).astype(np.float32)


@dataclass
class Landmarks:
    """Landmark words with what scoring a word against them needs."""

    words: list[str]  # at most 64, of at most LONGEST letters
    alphabet: np.ndarray = field(init=False)  # sorted code points
    triple_of: np.ndarray = field(init=False)  # number of each three letters, -1 for none
    features: np.ndarray = field(init=False)  # of the landmarks: a row per three letters
    whiten: np.ndarray = field(init=False)

    def __post_init__(self):
        self.alphabet = np.unique(letters(self.words))
        self.alphabet = self.alphabet[self.alphabet >= 0]
        self.triple_of = np.arange((len(self.alphabet) + 1) ** 3, dtype=np.int32)
        parts = [self._subsequences(letters([w])) for w in self.words]
        own = np.maximum([kernel(letters([w]), letters([w]))[0] for w in self.words], 1e-12)
        known = np.unique(np.concatenate([p[1] for p in parts]))
        self.triple_of = np.full(len(self.triple_of), -1, np.int32)
        self.triple_of[known] = np.arange(len(known))
        self.features = np.zeros((len(known), len(self.words)), np.float32)
        for number, (_, triple, weight) in enumerate(parts):
            np.add.at(self.features[:, number], self.triple_of[triple], weight / np.sqrt(own[number]))
        self.whiten = np.eye(len(self.words))
        gram = word_likeness(self.words, self.words) ** POWER
        values, vectors = np.linalg.eigh(gram)
        kept = values > 1e-4
        self.whiten = vectors[:, kept] / np.sqrt(values[kept])

    def _subsequences(self, spelled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, number and weight of every three letters, with whatever gaps, that a
        landmark has too; the words are of one length."""
        a, b, c, weight = subsequences(spelled.shape[1])
        at = np.searchsorted(self.alphabet, spelled)
        size = len(self.alphabet)
        at[self.alphabet[np.minimum(at, size - 1)] != spelled] = size
        at = at.astype(np.int32)
        codes = self.triple_of[(at[:, a] * (size + 1) + at[:, b]) * (size + 1) + at[:, c]]
        row, place = np.nonzero(codes >= 0)
        return row, codes[row, place], weight[place]

    def similar(self, words: list[str]) -> np.ndarray:
        """Normalised kernel to the power POWER of each word, of at most LONGEST
        letters, with each landmark."""
        out = np.zeros((len(words), len(self.words)), np.float32)
        sizes = np.array([len(w) for w in words], np.int64)
        for n in np.unique(sizes[sizes >= ORDER]).tolist():
            of_size = np.flatnonzero(sizes == n)
            step = max(1, 300_000 // len(subsequences(n)[3]))
            for start in range(0, len(of_size), step):
                rows = of_size[start : start + step]
                spelled = letters([words[i] for i in rows])
                row, triple, weight = self._subsequences(spelled)
                if not len(row):
                    continue
                first = np.flatnonzero(np.diff(row, prepend=-1))
                used = row[first]
                cross = np.add.reduceat(self.features[triple] * weight[:, None], first)
                own = np.maximum(kernel(spelled[used], spelled[used]), 1e-12)
                out[rows[used]] = (cross / np.sqrt(own)[:, None]) ** POWER
        return out

    @property
    def lengths(self) -> list[int]:
        return sorted({len(w) for w in self.words})

    def nearest(self, parts: Iterable[list[str]]) -> np.ndarray:
        """Likeness of the word, of all in the lists, that is most like a landmark."""
        best = np.zeros(len(self.words))
        for words in parts:
            likeness = self.similar(words)
            one = likeness[likeness.max(axis=1).argmax()]
            best = one if one.max() > best.max() else best
        return best

    def vectors(self, words: list[str]) -> np.ndarray:
        return self.similar(words) @ self.whiten


def word_likeness(words: list[str], others: list[str]) -> np.ndarray:
    """Normalised kernel of all pairs."""
    a, b = letters(words), letters(others)
    own_a, own_b = kernel(a, a), kernel(b, b)
    return kernel(a[:, None, :], b[None]) / np.sqrt(np.maximum(own_a[:, None] * own_b, 1e-12))


def windows(word: str) -> list[str]:
    if len(word) <= LONGEST:
        return [word]
    return [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def tokens(text: str) -> list[str]:
    """White-space tokens; a line's end is a token of its own that ends a sentence."""
    return text.replace("\n", " . ").split()


def plain(token: str) -> str:
    """Letters and digits of a token, so that marks inside a word hide nothing."""
    return MARKS.sub("", token.lower())


def ends(token: str) -> bool:
    return token[-1] in ".!?"


def single(token: str) -> bool:
    return len(token) <= 2 and len(plain(token)) == 1 and plain(token).isalpha()


def run_windows(run: str, lengths: list[int]) -> Iterator[list[str]]:
    """Windows of a run of single letters, those of any of ``lengths`` at every
    letter, in lists of bounded size."""
    yield windows(run)
    for n in lengths:
        for at in range(0, len(run) - n + 1, BLOCK):
            yield list({run[i : i + n] for i in range(at, min(at + BLOCK, len(run) - n + 1))})


class WordTable(dict):
    """Numbers tokens; a batch's new words are scored together by ``score``.
    ``lengths`` are those of the landmarks."""

    def __init__(self, score, lengths: list[int] | None = None):
        super().__init__()
        self.score, self.lengths, self.new = score, lengths or [], []
        self.value = np.zeros(0)
        self.end = np.zeros(0, bool)
        self.single = np.zeros(0, bool)

    def __missing__(self, token: str) -> int:
        at = self[token] = len(self)
        self.new.append(token)
        return at

    def settle(self) -> None:
        if not self.new:
            return
        parts = [windows(plain(t)) for t in self.new]
        flat = self.score([w for p in parts for w in p])
        starts = np.cumsum([0, *map(len, parts)])[:-1]
        self.value = np.append(self.value, np.maximum.reduceat(flat, starts))
        self.end = np.append(self.end, [ends(t) for t in self.new])
        self.single = np.append(self.single, [single(t) for t in self.new])
        self.new = []


def first_of_pairs(sentence: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Positions of the first of each word in each sentence: a word counts once."""
    return np.unique(sentence * (codes.max(initial=0) + 1) + codes, return_index=True)[1]


def sentences(table: WordTable, texts: list[str | None]):
    """Scores of all sentences of the texts, and each sentence's text."""
    if len(table) > MOST_WORDS:
        table = WordTable(table.score, table.lengths)
    codes, sizes, all_tokens = [], [], []
    for text in texts:
        own = tokens(text) if text else []
        all_tokens.append(own)
        codes += map(table.__getitem__, own)
        sizes.append(len(own))
    table.settle()
    codes = np.array(codes, np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    value = table.value[codes]
    new = np.zeros(len(codes), bool)
    if len(codes):
        new[0] = True
        new[1:] = table.end[codes[:-1]] | (doc[1:] != doc[:-1])
    sentence = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    once = first_of_pairs(sentence, codes)
    total = np.bincount(sentence[once], value[once], len(starts))
    _add_spelled_out(table, codes, doc, all_tokens, sizes, sentence, total)
    return total, doc[starts], table


def spelled_out(alone: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 of each run of three or more single letters of one text."""
    if not len(alone):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    on = np.zeros(len(alone) + 1, bool)  # the run goes on from the token before
    on[1:-1] = alone[1:] & alone[:-1] & (doc[1:] == doc[:-1])
    first, last = np.flatnonzero(alone & ~on[:-1]), np.flatnonzero(alone & ~on[1:]) + 1
    long = last - first >= 3
    return first[long], last[long]


def _add_spelled_out(table, codes, doc, all_tokens, sizes, sentence, total) -> None:
    """Adds to a sentence the worst window's score of each run of three or more single letters."""
    first, last = spelled_out(table.single[codes], doc)
    base = np.concatenate([[0], np.cumsum(sizes)])
    value = np.full(len(first), -np.inf)
    parts, of = [], []

    def settle():
        if parts:
            np.maximum.at(value, of, table.score(parts))
            parts.clear()
            of.clear()

    for k, (a, b) in enumerate(zip(first, last, strict=True)):
        own = all_tokens[doc[a]][a - base[doc[a]] : b - base[doc[a]]]
        for some in run_windows("".join(map(plain, own)), table.lengths):
            parts += some
            of += [k] * len(some)
            if len(parts) >= BLOCK:
                settle()
    settle()
    np.add.at(total, sentence[first], value)


@dataclass
class Model:
    landmarks: Landmarks | None
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def word_scores(self, words: list[str]) -> np.ndarray:
        if self.landmarks is None:
            return np.zeros(len(words))
        parts = [words[i : i + BLOCK] for i in range(0, len(words), BLOCK)]
        return np.concatenate([np.zeros(0), *(self.landmarks.vectors(p) @ self.weights for p in parts)])

    def text_scores(self, table: WordTable, texts: list[str | None]) -> tuple[np.ndarray, WordTable]:
        """The worst sentence's score of each text, as a probability."""
        if self.landmarks is not None:
            table.lengths = self.landmarks.lengths
        total, doc, table = sentences(table, texts)
        worst = np.full(len(texts), -np.inf)
        np.maximum.at(worst, doc, total)
        worst = np.where(np.isinf(worst), 0, worst) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * worst + self.shift, -30, 30))), table


def covering_words(toxic: list[set[str]], clean: list[set[str]], most: int) -> list[str]:
    """Words that hardly occur in clean texts: those that cover the toxic texts
    greedily, then those in most toxic texts."""
    in_clean = Counter(w for words in clean for w in words)
    open_, chosen = list(range(len(toxic))), []
    texts_of: dict[str, list[int]] = {}
    for i, words in enumerate(toxic):
        for w in words:
            if len(w) >= ORDER and in_clean[w] <= 0.002 * len(clean):
                texts_of.setdefault(w, []).append(i)
    left = set(open_)
    counts = {w: len(t) for w, t in texts_of.items() if len(t) >= 2 or len(toxic) < 20}
    while left and len(chosen) < most and counts:
        best = max(counts, key=lambda w: (counts[w], w))
        if counts[best] < 2 and chosen:
            break
        chosen.append(best)
        for i in texts_of[best]:
            if i in left:
                left.discard(i)
                for w in toxic[i]:
                    if w in counts:
                        counts[w] -= 1
        del counts[best]
    enough = max(3, 0.003 * len(toxic))
    also = sorted((w for w, t in texts_of.items() if len(t) >= enough), key=lambda w: (-len(texts_of[w]), w))
    return list(dict.fromkeys([*chosen, *also[:most]]))


def svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 400) -> tuple[np.ndarray, float]:
    """A linear support vector machine (squared hinge, classes weighed alike), by
    accelerated gradient descent."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    bound = 2 * np.linalg.norm(x1 * np.sqrt(weight)[:, None], 2) ** 2 + penalty
    w = v = np.zeros(x1.shape[1])
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x1 @ v))
        regular = penalty * v
        regular[-1] = 0
        new = v - (regular - 2 * x1.T @ (weight * slack * y)) / bound
        v = new + k / (k + 3) * (new - w)
        w = new
    return w[:-1], float(w[-1])


def platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through scores with labels 0 or 1."""
    a, b = 1.0, 0.0
    soft = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * score + b, -30, 30)))
        r, h = p - soft, np.maximum(p * (1 - p), 1e-6)
        hessian = np.array([[(h * score * score).sum() + 1e-3, (h * score).sum()], [(h * score).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hessian, [(r * score).sum() + 1e-3 * a, r.sum()])
        a, b = a - step[0], b - step[1]
    return float(a), float(b)


def fit(texts: list[str | None], toxic: np.ndarray, rounds: int = 3) -> Model:
    """A model from texts with labels 0 or 1."""
    share = float(toxic.mean()) if len(toxic) else 0.5
    none = Model(None, np.zeros(0), 0.0, 1.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    if not 0 < share < 1:
        return none
    table = WordTable(lambda words: np.zeros(len(words)))
    split = [[table[t] for t in tokens(text or "")] for text in texts]
    table.settle()
    plains = [sys.intern(plain(t)) for t in table]
    sets = [{plains[t] for t in own} for own in split]
    bad = [s for s, y in zip(sets, toxic, strict=True) if y]
    good = [s for s, y in zip(sets, toxic, strict=True) if not y]
    chosen = covering_words(bad, good, COVERING)
    if not chosen:
        return none
    kept: list[str] = []
    for word in dict.fromkeys(w for long in chosen for w in windows(long)):
        if not kept or word_likeness([word], kept).max() < ALIKE:
            kept.append(word)
    landmarks = Landmarks(kept[:MOST_LANDMARKS])
    del bad, good, sets
    # Words longer than a window, and runs of single letters, by their nearest window.
    codes = np.array([t for own in split for t in own], np.int64)
    of = np.repeat(np.arange(len(texts)), [len(s) for s in split])
    first, last = spelled_out(table.single[codes], of)
    runs = ["".join(plains[t] for t in codes[a:b]) for a, b in zip(first, last, strict=True)]
    distinct = sorted({w for w in plains if len(w) <= LONGEST})
    wide = {w: [windows(w)] for w in plains if len(w) > LONGEST}
    wide |= {(run,): run_windows(run, landmarks.lengths) for run in runs}
    row_of = {w: i for i, w in enumerate([*distinct, *wide])}
    vector_of = np.array([row_of[w] for w in plains])
    vector_of_run = np.array([row_of[(run,)] for run in runs], np.int64)
    del row_of
    # Sentence vectors: sums of their words' vectors.
    new = np.zeros(len(codes), bool)
    new[0] = True
    new[1:] = table.end[codes[:-1]] | (of[1:] != of[:-1])
    starts = np.flatnonzero(new)
    doc = of[starts]
    number = np.cumsum(new) - 1
    once = first_of_pairs(number, codes)
    sentence = np.concatenate([number[once], number[first]])
    of_word = np.concatenate([vector_of[codes[once]], vector_of_run])
    order = np.argsort(of_word, kind="stable")
    sentence, of_word = sentence[order], of_word[order]
    x = np.zeros((len(starts), landmarks.whiten.shape[1]))
    blocks = ((at, landmarks.similar(distinct[at : at + BLOCK])) for at in range(0, len(distinct), BLOCK))
    longer = ((len(distinct) + k, landmarks.nearest(p)[None]) for k, p in enumerate(wide.values()))
    for at, likeness in chain(blocks, longer):  # a block's vectors at a time
        lo, hi = np.searchsorted(of_word, [at, at + len(likeness)])
        vectors = (likeness @ landmarks.whiten)[of_word[lo:hi] - at]
        for k in range(vectors.shape[1]):
            x[:, k] += np.bincount(sentence[lo:hi], vectors[:, k], len(starts))
    names_one = np.isin(plains, chosen)[codes]
    positive = np.add.reduceat(names_one.astype(int), starts) > 0
    from_toxic = toxic[doc].astype(bool)
    for _ in range(rounds):
        use = ~from_toxic | (from_toxic & positive)
        weights, bias = svm(x[use], np.where(from_toxic[use], 1.0, -1.0))
        score = x @ weights
        worst = np.full(len(texts), -np.inf)
        np.maximum.at(worst, doc, score)
        positive = (score >= worst[doc] - 1e-9) & (score + bias > -0.5) | positive & (score + bias > 0)
    worst = np.where(np.isinf(worst), 0, worst) + bias
    slope, shift = platt(worst, toxic.astype(float))
    return Model(landmarks, weights, bias, slope, shift)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, train: str, most: int, key: str = "doc_id", text: str = "text"
) -> tuple[list[str | None], np.ndarray]:
    """At most ``most`` labelled texts of each class, the first by a hash of the id.

    ``train`` is an SQL condition on the id. The bound is on both classes, so what
    reaches the driver does not grow with the corpus.
    """
    known = labels.where(F.expr(train)).where(F.col(label).isNotNull() & F.col(key).isNotNull())
    known = known.groupBy(key).agg(F.max(label).alias("label"))
    parts = [
        known.where(F.col("label") == y).orderBy(F.xxhash64(key), key).limit(most).select(F.col(key).alias("of"), "label")
        for y in (0, 1)
    ]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most 2 * most rows of two numbers
    rows = docs.select(F.col(key).alias("of"), F.col(text).alias("text")).join(chosen, "of")
    rows = sorted(rows.select("of", "label", "text").collect(), key=lambda r: (r.of, r.text or ""))
    once = {r.text: int(r.label) for r in rows}
    return list(once), np.array(list(once.values()), np.int64)


def scores(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, score)`` of every row."""
    narrow = docs.select(key, text)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shipped.value
        table = WordTable(held.word_scores)
        for whole in batches:
            for batch in slices(whole, text):
                found, table = held.text_scores(table, batch.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(found)], [key, "score"])

    return narrow.mapInArrow(run, T.StructType([narrow.schema[key], T.StructField("score", T.DoubleType())]))
