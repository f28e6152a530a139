"""Full stops that end a sentence, and those that belong to an abbreviation.

Unsupervised, after Kiss & Strunk (2006), from counts over the whole corpus:

* ``stop_counts``    how often each type (a lower-cased word) has a final stop, and not
* ``abbreviations``  types whose stop is no accident: Dunning's log-likelihood that the
                     type always has one, weighed down by length and by each occurrence
                     without a stop, and up by stops inside
* ``opener_counts``  how often a type is capitalised at and after the start of a sentence
* ``openers``        types that open a sentence even after an abbreviation: known in lower
                     case and never capitalised inside a sentence, or far more frequent
                     at a start than elsewhere

A stop stays with its word if the word is an abbreviation, is not the last of its text
and no capitalised opener follows; every other final stop is a word of its own. Both
counts come from one aggregation over exploded pieces, combined map-side; all tests of
a piece are made once per different piece and neighbour. The two tables go into the plan when a bounded read finds them small; otherwise words with a stop
meet them by shuffle, and only the kept places come back to the texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labeltext.functions.lookups import let
from labeltext.functions.text import KEPT_STOP, blank_spaced, split_words, text_pieces
from labeltext.operators.scale import join_counted
from labeltext.session import ensure_checkpoint_dir

# Published settings: least score of an abbreviation, the chance of a stop after one,
# and least log-likelihood of a frequent sentence starter.
LEAST_SCORE = 0.3
STOP_CHANCE = 0.99
LEAST_STARTER = 30.0
# Tables of at most this many types go into the plan.
PLAN_TYPES = 10_000

CORE = r"(?s)[\p{L}\p{N}](?:.*[\p{L}\p{N}])?"
FINAL_STOP = r"[\p{L}\p{N}]\.([^\p{L}\p{N}.][^\p{L}\p{N}]*)?$"
FINAL_MARK = r"([!?]|\.\.|…)[^\p{L}\p{N}]*$"
CANDIDATE = r"^\p{L}+(\.\p{L}+)*$"
# A piece without any of these ends no sentence: it matches neither pattern above.
END_MARKS = [".", "!", "?", "…"]
KEEP_PATTERN = r"\.([^\p{L}\p{N}.]*)$"


@dataclass
class SentenceModel:
    """``abbreviations(type, ..)`` and ``openers(type, ..)`` of a corpus."""

    abbreviations: DataFrame
    openers: DataFrame


def pieces(spaced: Column) -> Column:
    """The blank-separated pieces of a ``blank_spaced`` text."""
    return F.array_remove(F.split(spaced, " +", -1), "")


def core(piece: Column) -> Column:
    """A piece without the signs at its edges."""
    return F.regexp_extract(piece, CORE, 0)


def has_stop(piece: Column) -> Column:
    return F.contains(piece, F.lit(".")) & F.rlike(piece, F.lit(FINAL_STOP))


def is_capital(word: Column) -> Column:
    return F.rlike(word, F.lit(r"^\p{Lu}"))


def _words(corpus: DataFrame) -> DataFrame:
    """``(type, stop, capital, lower, prev, prev_stop, prev_mark, n)``: a row per different
    piece and neighbour before, with its number. ``prev`` is null for a text's first piece
    and empty after one without ``END_MARKS``; a piece of signs alone has an empty type."""
    def paired(p: Column) -> Column:
        return F.arrays_zip(p.alias("piece"), F.concat(F.array(F.lit(None).cast("string")), p).alias("before"))

    rows = corpus.select(F.inline(let(text_pieces(F.col("text")), paired)).alias("piece", "before")).where("piece IS NOT NULL")
    may_end = reduce(lambda a, b: a | b, [F.contains("before", F.lit(m)) for m in END_MARKS])
    before = F.when(F.col("before").isNull() | may_end, F.col("before")).otherwise("").alias("before")
    seen = rows.select("piece", before).groupBy("piece", "before").agg(F.count("*").alias("n"))
    described = seen.select(core(F.col("piece")).alias("core"), "piece", "before", "n")
    follows = F.col("before") != ""
    return described.select(
        F.lower("core").alias("type"), has_stop(F.col("piece")).alias("stop"), is_capital(F.col("core")).alias("capital"),
        F.rlike("core", F.lit(r"^\p{Ll}")).alias("lower"),
        F.when(follows, F.lower(core(F.col("before")))).otherwise(F.col("before")).alias("prev"),
        F.coalesce(follows & has_stop(F.col("before")), F.lit(False)).alias("prev_stop"),
        F.coalesce(follows & F.rlike("before", F.lit(FINAL_MARK)), F.lit(False)).alias("prev_mark"), "n",
    )


def stop_counts(corpus: DataFrame) -> DataFrame:
    """``(type, n_stop, n_plain)``: occurrences with and without a final stop."""
    pieces_seen = corpus.select(F.explode(text_pieces(F.col("text"))).alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    words = pieces_seen.select(F.lower(core(F.col("p"))).alias("type"), has_stop(F.col("p")).alias("stop"), "n")
    return _stop_counts(words)


def _stop_counts(words: DataFrame) -> DataFrame:
    return _typed(words).groupBy("type").agg(_number(F.col("stop")).alias("n_stop"), _number(~F.col("stop")).alias("n_plain"))


def _typed(words: DataFrame) -> DataFrame:
    """The words with a type. Asked together with their number, so that the optimizer asks
    it of counted pieces and not of every word."""
    return words.where(F.when(F.col("type") != "", F.col("n")) > 0)


def _number(test: Column) -> Column:
    """Of the words that rows with ``n`` stand for, those that pass a test."""
    return F.sum(F.when(test, F.col("n")).otherwise(0))


def abbreviations(counts: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """``(type, n_stop, n_plain, score)`` of the types that score ``least`` or more.

    With k of n occurrences before a stop, and p the share of all words before one, the
    likelihood ratio is that of a stop's chance being p or ``STOP_CHANCE``. Types other
    than letters with single stops between are never abbreviations.
    """
    totals = counts.agg(F.sum("n_stop").alias("k"), F.sum(F.col("n_stop") + F.col("n_plain")).alias("n")).first()
    p = (totals.k or 0) / totals.n if totals.n else 0.0
    k, rest = F.col("n_stop"), F.col("n_plain")
    by_chance = k * F.ln(F.lit(p)) + F.when(rest > 0, rest * F.ln(F.lit(1.0 - p))).otherwise(0.0)
    by_rule = k * F.ln(F.lit(STOP_CHANCE)) + rest * F.ln(F.lit(1.0 - STOP_CHANCE))
    letters = F.char_length(F.replace(F.col("type"), F.lit("."), F.lit(""))).cast("double")
    stops = (F.char_length("type") - letters + 1).cast("double")
    score = -2.0 * (by_chance - by_rule) * F.exp(-letters) * stops * F.pow(letters, -rest.cast("double"))
    scored = counts.where((k > 0) & F.rlike("type", F.lit(CANDIDATE))).withColumn("score", score)
    return scored.where(F.col("score") >= least)


def _looked_up(rows: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """``rows`` with ``found``: whether ``key`` (not null) is a type of ``table``. The types
    asked for are counted, so that neither known nor unknown ones make a hot key."""
    ensure_checkpoint_dir(rows.sparkSession)
    asked = rows.groupBy(key).agg(F.count("*").alias("_n"))
    listed = asked.join(table.select(F.col("type").alias(key), F.lit(True).alias("found")), key, "left")
    listed = listed.withColumn("found", F.coalesce("found", F.lit(False))).checkpoint()
    return join_counted(rows, listed, [key], "_n").drop("_n")


def _marked(words: DataFrame, known: DataFrame) -> DataFrame:
    """``words`` with ``after_short``: whether an abbreviation stands before."""
    short = small_types(known)
    if short is not None:
        return words.withColumn("after_short", F.col("prev_stop") & F.coalesce(_in(F.col("prev"), short), F.lit(False)))
    after = _looked_up(words.where("prev_stop"), "prev", known).withColumnRenamed("found", "after_short")
    return after.unionByName(words.where("NOT prev_stop").withColumn("after_short", F.lit(False)))


def opener_counts(corpus: DataFrame, known: DataFrame) -> DataFrame:
    """``(type, n, n_start, n_lower, n_inside, n_after_short)``: all occurrences, those at
    the start of a sentence, in lower case, capitalised inside a sentence, and capitalised
    after an abbreviation, which is neither."""
    return _opener_counts(_words(corpus), known)


def _opener_counts(words: DataFrame, known: DataFrame) -> DataFrame:
    words = _marked(_typed(words), known)
    after_short = F.col("after_short")
    start = (F.col("prev").isNull() | F.col("prev_stop") | F.col("prev_mark")) & ~after_short
    return words.groupBy("type").agg(
        F.sum("n").alias("n"), _number(start).alias("n_start"), _number(F.col("lower")).alias("n_lower"),
        _number(F.col("capital") & ~start & ~after_short).alias("n_inside"),
        _number(F.col("capital") & after_short).alias("n_after_short"),
    )


def _log_likelihood(k: Column, n: Column, p: Column) -> Column:
    """ln of p^k (1-p)^(n-k), a power of no events being 1."""
    some = F.when(k > 0, k * F.ln(p)).otherwise(0.0)
    return some + F.when(n > k, (n - k) * F.ln(1.0 - p)).otherwise(0.0)


def openers(counts: DataFrame, least: float = LEAST_STARTER) -> DataFrame:
    """``(type, n_after_short, starter)`` of the openers that follow an abbreviation
    somewhere; ``starter`` is the log-likelihood of being tied to a sentence's start."""
    totals = counts.agg(F.sum("n").cast("double").alias("n"), F.sum("n_start").cast("double").alias("starts")).first()
    n, starts = F.lit(totals.n or 0.0), F.lit(totals.starts or 0.0)
    of_type, at_start = F.col("n").cast("double"), F.col("n_start").cast("double")
    elsewhere = of_type - at_start
    p, p1, p2 = of_type / n, F.try_divide(at_start, starts), F.try_divide(elsewhere, n - starts)
    apart = _log_likelihood(at_start, starts, p1) + _log_likelihood(elsewhere, n - starts, p2)
    together = _log_likelihood(at_start, starts, p) + _log_likelihood(elsewhere, n - starts, p)
    scored = counts.where("n_after_short > 0").withColumn("starter", F.coalesce(2.0 * (apart - together), F.lit(0.0)))
    known = (F.col("n_lower") > 0) & (F.col("n_inside") == 0)
    frequent = (F.col("starter") >= least) & F.coalesce(p1 > p, F.lit(False))
    return scored.where(known | frequent).select("type", "n_after_short", "starter")


def fit(corpus: DataFrame) -> SentenceModel:
    """The abbreviations and openers of ``corpus(text)``, one pass over it."""
    ensure_checkpoint_dir(corpus.sparkSession)
    words = _words(corpus).checkpoint()
    known = abbreviations(_stop_counts(words).checkpoint()).checkpoint()
    return SentenceModel(known, openers(_opener_counts(words, known).checkpoint()).checkpoint())


def small_types(table: DataFrame, most: int | None = None) -> list[str] | None:
    """The types of a table of at most ``most`` rows, else None. One row more is read."""
    most = PLAN_TYPES if most is None else most
    found = [r.type for r in table.select("type").limit(most + 1).collect()]
    return found if len(found) <= most else None


def _kept(p: Column, i: Column, short: Column, opens: Column) -> Column:
    """Whether piece ``i`` keeps its stop, given the tests of its type and of the next one."""
    follows = F.get(p, i + 1)
    return has_stop(F.get(p, i)) & follows.isNotNull() & short & ~(is_capital(core(follows)) & opens)


def _rejoined(p: Column, kept) -> Column:
    stop = lambda x: F.regexp_replace(x, KEEP_PATTERN, KEPT_STOP + "$1")
    whole = F.transform(p, lambda x, i: F.when(kept(i), stop(x)).otherwise(x))
    return F.concat(F.lit(" "), F.array_join(whole, "  "), F.lit(" "))


def sentence_words(corpus: DataFrame, model: SentenceModel, words: str = "words") -> DataFrame:
    """``corpus(doc_id, text, ..)`` with ``words``: ``split_words`` that keeps the stops of
    abbreviations inside a sentence. ``doc_id`` must be unique where the model is large."""
    short, opens = small_types(model.abbreviations), small_types(model.openers)
    if short is not None and opens is not None:
        def keep(spaced: Column) -> Column:
            def of(p: Column) -> Column:
                type_at = lambda i: F.lower(core(F.get(p, i)))
                # The costly tests are asked only of pieces with a stop.
                return _rejoined(
                    p, lambda i: F.when(has_stop(F.get(p, i)), _kept(p, i, _in(type_at(i), short), _in(type_at(i + 1), opens)))
                )

            return let(pieces(spaced), of)

        return corpus.withColumn(words, split_words(F.col("text"), keep))
    places = kept_places(corpus, model)
    joined = corpus.join(places, "doc_id", "left")

    def keep_listed(spaced: Column) -> Column:
        listed = F.coalesce("_places", F.array().cast("array<int>"))
        return let(pieces(spaced), lambda p: _rejoined(p, lambda i: F.array_contains(listed, i)))

    return joined.withColumn(words, split_words(F.col("text"), keep_listed)).drop("_places")


def _in(value: Column, types: list[str]) -> Column:
    return value.isin(types) if types else F.lit(False)


def kept_places(corpus: DataFrame, model: SentenceModel) -> DataFrame:
    """``(doc_id, _places)``: the pieces of each text that keep their stop, by joins of the
    words before a stop with both tables, whatever their size."""
    def asked(p: Column) -> Column:
        found = F.transform(
            p,
            lambda x, i: F.when(
                has_stop(x) & F.get(p, i + 1).isNotNull(),
                F.struct(i.alias("pos"), F.lower(core(x)).alias("type"), core(F.get(p, i + 1)).alias("follows")),
            ),
        )
        return F.array_compact(found)

    rows = corpus.select("doc_id", F.explode(let(pieces(blank_spaced(F.col("text"))), asked)).alias("w"))
    rows = rows.select("doc_id", "w.pos", "w.type", "w.follows")
    short = _looked_up(rows, "type", model.abbreviations).where("found").drop("found")
    capital = is_capital(F.col("follows"))
    after = short.where(capital).withColumn("next", F.lower("follows"))
    kept = _looked_up(after, "next", model.openers).where("NOT found").select("doc_id", "pos")
    kept = kept.unionByName(short.where(~capital).select("doc_id", "pos"))
    return kept.groupBy("doc_id").agg(F.collect_list("pos").alias("_places"))
