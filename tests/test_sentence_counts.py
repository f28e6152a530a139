"""Counts of sentences: a piece is tested once per different piece and neighbour, not per word."""

import random
import re

from labeltext.operators import sentences
from pyspark.sql import functions as F

PARTS = ["Mr.", "mr", "U.S.", "end.", "End!", "Why?", "so...", "a…", "(the)", "The", "the", "«Été»", "3.5", "...", "!", "x.)", "e.g.,", "ß", "\\"]
BLANKS = [" ", "  ", "\n", "\t\r\n", "\x1f", "\x85", "　"]


def _texts():
    rng = random.Random(3)
    made = ["".join(rng.choice(PARTS) + rng.choice(BLANKS) for _ in range(rng.randrange(15))) for _ in range(200)]
    return [*made, *made[:50], *[" " + t.rstrip() for t in made], "", " ", "...", None]


def test_counts_are_those_of_each_word(spark):
    texts = _texts()
    corpus = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    known = spark.createDataFrame([("mr",), ("u.s",), ("e.g",)], "type string")
    short, stops, want = {"mr", "u.s", "e.g"}, {}, {}
    core = lambda p: re.sub(r"^[\W_]+|[\W_]+$", "", p)
    has_stop = lambda p: re.search(r"[^\W_]\.([^\w.]\W*)?$", p) is not None
    for text in filter(None, texts):
        pieces = text.split()
        for before, piece in zip([None, *pieces], pieces, strict=False):
            if not (word := core(piece)):
                continue
            stop = stops.setdefault(word.lower(), [0, 0])
            stop[0 if has_stop(piece) else 1] += 1
            after = before is not None and has_stop(before) and core(before).lower() in short
            mark = before is not None and re.search(r"([!?]|\.\.|…)\W*$", before) is not None
            start = not after and (before is None or has_stop(before) or mark)
            n = want.setdefault(word.lower(), [0] * 5)
            told = (True, start, word[0].islower(), word[0].isupper() and not start and not after, word[0].isupper() and after)
            want[word.lower()] = [a + b for a, b in zip(n, told, strict=True)]
    assert {r.type: [r.n_stop, r.n_plain] for r in sentences.stop_counts(corpus).collect()} == stops
    assert {r[0]: list(r[1:]) for r in sentences.opener_counts(corpus, known).collect()} == want


def test_words_are_counted_before_they_are_tested(spark):
    texts = spark.range(50).select(F.lit("Mr. Smith saw it. " * 200).alias("text"))
    words = sentences._words(texts)
    assert words.agg(F.sum("n")).first()[0] == 50 * 800
    assert words.count() == 5  # "Mr." first and after "it.", and three others
    for counts in (sentences.stop_counts(texts), sentences._stop_counts(words)):
        plan = counts._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("regexp_extract") < plan.rindex("Aggregate") < plan.index("Generate")
        assert "regexp_extract" not in plan[plan.index("Generate") :]
