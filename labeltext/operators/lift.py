"""Class lift: how over-represented a word is among the documents of a class.

    lift(w, c) = (n(w, c) / N(c)) * (N / n(w)) = P(w | c) / P(w)

with n counting documents whose first ``max_len`` words contain w. ``by`` names
further columns (such as ``split``) inside which all statistics are separate.

The flow: ``document_words`` makes a narrow table (no text) that everything else
reads, so callers persist it, and likewise the far smaller ``class_lift``;
``word_counts`` pre-aggregates before its shuffle;
``join_counted`` brings the scores back without a hot key; one shuffle on
``doc_id`` then ranks each document's at most ``max_len`` words in place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labeltext.functions.lookups import let
from labeltext.functions.text import leading_pieces, lower_words, search_among, split_words
from labeltext.operators.corpus import drop_unlabelled
from labeltext.operators.scale import join_counted, small_table

MAX_LEN = 30
THRESHOLD = 1.000009


def document_words(
    corpus: DataFrame, max_len: int = MAX_LEN, by: Sequence[str] = (), skeleton: bool = False
) -> DataFrame:
    """``(by.., doc_id, label, words)``: the first ``max_len`` lower-cased words.

    With ``skeleton`` also ``skeleton``: those cased words of the whole text that
    a mask line can keep, i.e. a full stop, a comma, or a word that is among
    ``words``. It is what the mask rewrite needs of the text, so the text itself
    stays behind.
    """
    text = F.col("text")
    cased = drop_unlabelled(corpus).select(
        *by,
        "doc_id",
        "label",
        # Without a skeleton the rest of the text need not be split.
        (split_words(text) if skeleton else let(leading_pieces(text, max_len), lambda t: split_words(t))).alias("cased"),
    )
    rows = cased.withColumn("words", lower_words(F.col("cased"), max_len))
    if skeleton:
        kept = search_among(
            F.col("words"),
            lambda among: F.filter("cased", lambda w: w.isin(",", ".") | among(F.lower(w))),
        )
        rows = rows.withColumn("skeleton", kept)
    return rows.drop("cased")


def _keys(words: DataFrame) -> str:
    return "ids" if "ids" in words.columns else "words"


def _key(words: DataFrame) -> str:
    return "token_id" if "ids" in words.columns else "word"


def label_counts(corpus: DataFrame) -> DataFrame:
    """Documents per label, and overall in the row whose label is NULL."""
    per_label = drop_unlabelled(corpus).groupBy("label").agg(F.count("*").alias("n"))
    return per_label.groupingSets([["label"], []], "label").agg(F.sum("n").alias("n_docs"))


def class_sizes(words: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by.., label, class_docs, all_docs)``, one row per class."""
    per_class = words.groupBy(*by, "label").agg(F.count("*").alias("class_docs"))
    everything = Window.partitionBy(*by)
    return per_class.withColumn("all_docs", F.sum("class_docs").over(everything))


def token_set(words: DataFrame) -> DataFrame:
    """Distinct keys (words, or ids in vocabulary mode) of the corpus."""
    return words.select(F.explode(F.array_distinct(_keys(words))).alias(_key(words))).distinct()


def word_counts(words: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by.., label, word, n_class, n_total)``: documents holding the word.

    A word counts once per document. ``n_total`` adds up at most one row per
    label, so its window groups stay small whatever the word.
    """
    key = _key(words)
    per_class = (
        words.select(*by, "label", F.explode(F.array_distinct(_keys(words))).alias(key))
        .groupBy(*by, "label", key)
        .agg(F.count("*").alias("n_class"))
    )
    return per_class.withColumn("n_total", F.sum("n_class").over(Window.partitionBy(*by, key)))


def document_frequency(words: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Documents per word and label, and per word overall (label NULL)."""
    key = _key(words)
    per_class = (
        words.select(*by, "label", F.explode(F.array_distinct(_keys(words))).alias(key))
        .groupBy(*by, "label", key)
        .agg(F.count("*").alias("n"))
    )
    sets = [[*by, key, "label"], [*by, key]]
    return per_class.groupingSets(sets, *by, key, "label").agg(F.sum("n").alias("n_docs"))


def inverse_ratios(words: DataFrame) -> DataFrame:
    """``(word, n_total, idf)``: N / n(w) of each word, from counts per word alone."""
    key = _key(words)
    documents = words.agg(F.count("*").alias("n")).scalar()
    counts = words.select(F.explode(F.array_distinct(_keys(words))).alias(key)).groupBy(key)
    return counts.agg(F.count("*").alias("n_total")).withColumn(
        "idf", F.lit(documents).cast("double") / F.col("n_total").cast("double")
    )


def class_frequency() -> Column:
    """n(w, c) / N(c)."""
    return F.col("n_class").cast("double") / F.col("class_docs").cast("double")


def inverse_frequency() -> Column:
    """N / n(w), without a logarithm."""
    return F.col("all_docs").cast("double") / F.col("n_total").cast("double")


def class_lift(words: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by.., label, word, n_class, n_total, class_docs, all_docs, tf, idf, score)``."""
    sizes = small_table(class_sizes(words, by))
    scored = word_counts(words, by).join(sizes, [*by, "label"])
    scored = scored.withColumns({"tf": class_frequency(), "idf": inverse_frequency()})
    return scored.withColumn("score", F.col("tf") * F.col("idf"))


def pad_scores(words: DataFrame, max_len: int = MAX_LEN, by: Sequence[str] = ()) -> DataFrame:
    """``(by.., label, pad_score)``: the lift of padding, seen in documents
    shorter than ``max_len``. Classes without such a document are absent."""
    sizes = words.groupBy(*by, "label").agg(
        F.count("*").alias("class_docs"),
        F.count_if(F.size("words") < max_len).alias("n_class"),
    )
    everything = Window.partitionBy(*by)
    sizes = sizes.withColumns(
        {
            "all_docs": F.sum("class_docs").over(everything),
            "n_total": F.sum("n_class").over(everything),
        }
    )
    return sizes.where(F.col("n_class") > 0).select(
        *by, "label", (class_frequency() * inverse_frequency()).alias("pad_score")
    )


def score_words(
    words: DataFrame, lift: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """``(by.., doc_id, label, word, pos, score)`` for each distinct word of a
    document, ``pos`` being the order of first occurrence."""
    key = _key(words)
    if key == "word":
        rows = words.select(*by, "doc_id", "label", F.posexplode(F.array_distinct("words")).alias("pos", "word"))
    else:
        # A document has up to as many rows of an id as it has words with that id, so
        # here n_class counts documents, not rows; a key is at most as many times
        # hotter as a document has words, which the bound then allows for.
        pairs = F.array_distinct(F.arrays_zip(F.col("words").alias("word"), F.col("ids").alias("token_id")))
        rows = words.select(*by, "doc_id", "label", F.posexplode(pairs).alias("pos", "pair"))
        rows = rows.select(*by, "doc_id", "label", "pos", "pair.word", "pair.token_id")
    scores = lift.select(*by, "label", key, "n_class", "score")
    return join_counted(rows, scores, [*by, "label", key], "n_class").select(
        *by, "doc_id", "label", "word", "pos", "score"
    )


def ranked_words(words: DataFrame, lift: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by.., doc_id, label, ranked)``: per document its words as
    ``array<struct<word, score, pos>>``, best score first, ties in text order.

    Documents without words keep an empty array.
    """
    one = F.struct((-F.col("score")).alias("order"), F.col("pos"), F.col("word"))
    grouped = (
        score_words(words, lift, by)
        .groupBy("doc_id")
        .agg(
            *[F.first(c).alias(c) for c in (*by, "label")],
            F.sort_array(F.collect_list(one)).alias("ranked"),
        )
    )
    ranked = grouped.withColumn(
        "ranked",
        F.transform(
            "ranked",
            lambda r: F.struct(
                r["word"].alias("word"), (-r["order"]).alias("score"), r["pos"].alias("pos")
            ),
        ),
    ).select(*by, "doc_id", "label", "ranked")
    empty = F.array().cast(ranked.schema["ranked"].dataType)
    wordless = words.where(F.size("words") == 0).select(*by, "doc_id", "label", empty.alias("ranked"))
    return ranked.unionByName(wordless)


def word_records(
    words: DataFrame,
    lift: DataFrame,
    max_len: int = MAX_LEN,
    pad_score: str = "observed",
    by: Sequence[str] = (),
) -> DataFrame:
    """``ranked_words`` plus ``raw_scores``: the score at each of ``max_len``
    positions. Padding positions carry the lift of padding (``observed``) or
    -1.0 (``skip``)."""
    if pad_score not in ("observed", "skip"):
        raise ValueError("pad_score must be 'observed' or 'skip'")
    ranked = ranked_words(words, lift, by).select("doc_id", "ranked")
    rows = words.select(*by, "doc_id", "label", "words").join(ranked, "doc_id")
    if pad_score == "observed":
        rows = rows.join(small_table(pad_scores(words, max_len, by)), [*by, "label"], "left")
    else:
        rows = rows.withColumn("pad_score", F.lit(-1.0))
    per_word = let(
        F.map_from_arrays("ranked.word", "ranked.score"),
        lambda scores: F.transform("words", lambda w: scores[w]),
    )
    missing = F.lit(max_len) - F.size("words")
    raw = F.concat(
        per_word,
        F.when(missing > 0, F.array_repeat("pad_score", missing)).otherwise(
            F.array().cast("array<double>")
        ),
    )
    return rows.select(
        *by,
        "doc_id",
        "label",
        F.col("ranked.word").alias("sorted_words"),
        F.col("ranked.score").alias("sorted_scores"),
        raw.alias("raw_scores"),
    )


def keywords_above(ranked: Column, threshold: float = THRESHOLD, fallback: bool = True) -> Column:
    """Ranked words scoring strictly above the threshold; with ``fallback`` the
    best word when there is none."""
    above = F.transform(F.filter(ranked, lambda r: r["score"] > threshold), lambda r: r["word"])
    if not fallback:
        return above
    best = F.transform(F.slice(ranked, 1, 1), lambda r: r["word"])
    return F.when(F.size(above) > 0, above).otherwise(best)
