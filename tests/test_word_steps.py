"""Words of a text by the faster forms of the steps are those of the steps themselves."""

import random

from labeltext.fixed_values import WORD_STEPS
from labeltext.functions.text import FASTER, KEPT_STOP, blank_spaced, split_words, text_pieces
from pyspark.sql import functions as F

SIGNS = list(";@#$%&?!*[](){}<>«»“”‘’„.-`:,'\"\\…–_/=+^~|¡") + ["..", "--", "''", "``", "n't", "'ll", "'S", ".'", "N'T", "'ve", " .", " '"]
WORDS = ["a", "Was", "can", "not", "Cannot", "gImme", "wanna", "gotta", "got", "d'ye", "more'n", "'Tis", "'twas", "é", "ſ", "İ", "K", "7", "𝒳", "🙂", "x_"]
BLANKS = [" ", "  ", "\n", "\t\r\n", "\x1f", "\x85", "　", "\u2028"]


def _texts():
    rng = random.Random(9)
    piece = lambda: "".join(rng.choice(SIGNS if rng.random() < 0.4 else WORDS) for _ in range(rng.randrange(1, 6)))
    made = ["".join(piece() + rng.choice(BLANKS) for _ in range(rng.randrange(8))) for _ in range(4000)]
    return [*made, *[" " + t.rstrip() for t in made], *SIGNS, *WORDS, "", " ", "\n", None]


def _plainly(text, keep=None):
    """Every step as it is written, on the whole text."""
    spaced = F.concat(F.lit(" "), text, F.lit(" "))
    for i, (_, pattern, replacement) in enumerate(WORD_STEPS):
        spaced = F.regexp_replace(spaced, pattern, replacement)
        if keep is not None and not i:
            spaced = keep(spaced)
    words = F.split(F.rtrim(F.replace(spaced, F.lit(KEPT_STOP), F.lit("."))), r" +|\\", -1)
    return F.slice(words, 2, F.size(words))


def test_faster_forms_give_the_same_words(spark):
    rows = spark.createDataFrame(list(enumerate(_texts())), "doc_id int, text string").repartition(4)
    keep = lambda spaced: F.regexp_replace(spaced, r"(a|S)\.  ", "$1" + KEPT_STOP + "  ")
    for kept in (None, keep):
        both = rows.select("text", split_words(F.col("text"), kept).alias("got"), _plainly(F.col("text"), kept).alias("want"))
        assert both.where("NOT (got <=> want)").limit(3).collect() == []
    pieces = rows.select(text_pieces(F.col("text")).alias("got"), F.array_remove(F.split(blank_spaced(F.col("text")), " +", -1), "").alias("want"))
    assert pieces.where("NOT (got <=> want)").limit(3).collect() == []


def test_the_slow_forms_are_not_run(spark):
    plan = spark.range(1).select(split_words(F.concat(F.lit("a, b."), "id")).alias("w"))._jdf.queryExecution().analyzed().toString()
    assert all(form in plan for form, _ in FASTER.values())
    assert all(f", {pattern}," not in plan for pattern in FASTER)
