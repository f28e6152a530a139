"""Quality rules: a threshold table compiled into one projection.

``measured`` takes the counts of a text (words, their characters, symbols, marks,
stop words, lines, repeated lines and words) with DataFrame functions; ``judged``
turns a table of ``Rule`` rows into one projection that compares counts with each
other in whole numbers, so every verdict is exact. There is no user function and no
shuffle: a row is judged on its own, by whichever task reads it.

A word is a run of characters other than blank, tab, line feed, vertical tab, form
feed and carriage return. A rule bounds ``100 * part`` by ``percent * whole``, from
below or above, where ``whole`` may be the number 1 (the rule then bounds the count).

Defined cases: a null or empty text has no words, so all its counts are 0, and fails
the base rules; ids may be null or repeat, each row is judged alone; a text's cost
grows as n log n in its words (three-word windows are sorted); further columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labeltext.functions.lookups import let

BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MARKS = "!"
WINDOW = 3

# Common function words of seven languages.
STOP_WORDS = """
the of and to a in is that it for was on with as be by are this at from
der die und den von zu das sich mit auf des für ist im nicht dem ein eine als
de la le et les en un du une que pour est par avec qui dans sur pas au
el y los las se por con no su para es al lo del
il che di e non sono per una più come
o que do da em um os com uma não
het een van en dat niet op te zijn
""".split()


@dataclass(frozen=True)
class Rule:
    """``100 * part`` against ``percent * whole``: at least or at most as much."""

    name: str
    part: str
    percent: int
    whole: str | None = None
    at_least: bool = False

    def holds(self) -> Column:
        part = F.col(self.part) * 100
        whole = F.lit(1) if self.whole is None else F.col(self.whole)
        bound = whole * self.percent
        return part >= bound if self.at_least else part <= bound


# The rules that every table starts with: 50 words, at most half of them repeated.
BASE = (
    Rule("words", "n_words", 5000, at_least=True),
    Rule("repeated_words", "n_repeat_words", 50, "n_words"),
)
# Length, symbol, stop-word and line rules in the manner of published filters of web text.
THRESHOLDS = (
    Rule("short_words", "word_chars", 200, "n_words", at_least=True),
    Rule("long_words", "word_chars", 1500, "n_words"),
    Rule("symbols", "n_symbols", 20, "n_words"),
    Rule("marks", "n_marks", 30, "n_words"),
    Rule("stop_words", "n_stop_words", 200, at_least=True),
    Rule("letters", "n_letter_words", 60, "n_words", at_least=True),
    Rule("repeated_lines", "n_dup_lines", 50, "n_lines"),
    Rule("bullets", "n_bullet_lines", 90, "n_lines"),
    Rule("ellipses", "n_ellipsis_lines", 30, "n_lines"),
)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANK_RUN, -1), lambda w: w != "")


def occurrences(text: Column, characters: str) -> Column:
    """How often the given single-byte characters occur."""
    left = [F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in characters]
    return reduce(lambda a, b: a + b, left).cast("long")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows of ``window`` words found twice or more.

    Windows are sorted with their places; those equal to a neighbour are repeated, and
    each of their places covers ``window`` words, fewer where the next one overlaps.
    """
    last = F.size(words) - window

    def windows(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - window),
            lambda i: F.struct(F.array_join(F.slice(w, i + 1, window), " ").alias("k"), i.alias("i")),
        )

    def repeated(s: Column) -> Column:
        key = lambda j: F.get(s, j)["k"]
        twin = lambda x, j: (x["k"] == key(j - 1)) | (x["k"] == key(j + 1))
        return F.sort_array(F.transform(F.filter(s, lambda x, j: F.coalesce(twin(x, j), F.lit(False))), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda i, j: F.least(F.lit(window), F.coalesce(F.get(at, j + 1) - i, F.lit(window))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda n, x: n + x)

    found = let(F.sort_array(let(words, windows)), lambda s: let(repeated(s), covered))
    return F.when(last >= 0, found).otherwise(F.lit(0).cast("long"))


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_words, word_chars, ..)``: the counts of every text, all long."""
    given = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("t"))
    has_word = lambda line: F.btrim(line, F.lit(BLANKS)) != ""
    split = given.select(
        key, "t", words_of(F.col("t")).alias("w"), F.filter(F.split("t", "\n", -1), has_word).alias("l")
    )
    number = lambda array: F.size(array).cast("long")
    starts = lambda line: F.rlike(line, F.lit(r"^[\x20\x09-\x0D]*[-*•‣·][\x20\x09]"))
    ends = lambda line: F.rlike(line, F.lit(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))
    return split.select(
        key,
        number("w").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        occurrences(F.col("t"), SYMBOLS).alias("n_symbols"),
        occurrences(F.col("t"), MARKS).alias("n_marks"),
        number(F.filter("w", lambda w: F.lower(w).isin(STOP_WORDS))).alias("n_stop_words"),
        number(F.filter("w", lambda w: F.rlike(w, F.lit(r"\p{L}")))).alias("n_letter_words"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
        number("l").alias("n_lines"),
        (number("l") - number(F.array_distinct("l"))).alias("n_dup_lines"),
        number(F.filter("l", starts)).alias("n_bullet_lines"),
        number(F.filter("l", ends)).alias("n_ellipsis_lines"),
    )


def judged(docs: DataFrame, table: tuple[Rule, ...] = THRESHOLDS, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """``measured`` with ``failed`` (names of the rules that a text breaks),
    ``base_failed`` and ``kept``: one projection over the counts."""
    counts = measured(docs)
    names = [F.when(~r.holds(), F.lit(r.name)) for r in (*base, *table)]
    return counts.select(
        "*",
        F.array_compact(F.array(*names)).alias("failed"),
        (~reduce(Column.__and__, [r.holds() for r in base])).alias("base_failed"),
        reduce(Column.__and__, [r.holds() for r in (*base, *table)]).alias("kept"),
    )
