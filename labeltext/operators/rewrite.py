"""Rewrites of a document by its keywords."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labeltext.fixed_values import KEYWORD_SEPARATOR, MASK
from labeltext.functions.text import search_among, split_words
from labeltext.operators.corpus import drop_unlabelled
from labeltext.operators.lift import THRESHOLD, keywords_above

PUNCTUATION = (",", ".")


def _or_mask(line: Column) -> Column:
    return F.when(line == "", F.lit(MASK)).otherwise(line)


def keyword_line(keywords: Column, separator: str = KEYWORD_SEPARATOR) -> Column:
    """Keywords on one line, best first; ``<mask>`` when there is none."""
    return _or_mask(F.array_join(keywords, separator))


def mask_line(cased: Column, keywords: Column, mask: str = MASK) -> Column:
    """Skeleton of a text: its keywords and its commas and full stops, each after
    a mask; punctuation joins its mask unless it comes first."""
    kept = search_among(
        keywords,
        lambda among: F.filter(cased, lambda w: among(F.lower(w)) | w.isin(*PUNCTUATION)),
    )
    marked = F.transform(
        kept,
        lambda w, i: F.when(
            (i > 0) & w.isin(*PUNCTUATION), F.concat(F.lit(mask), w)
        ).otherwise(F.concat(F.lit(mask + " "), w)),
    )
    return _or_mask(F.array_join(marked, " "))


def complement_text(cased: Column, keywords: Column) -> Column:
    """The text's words that are no keywords."""
    rest = search_among(keywords, lambda among: F.filter(cased, lambda w: ~among(F.lower(w))))
    return F.array_join(rest, " ")


def keyword_lines(
    ranked: DataFrame, threshold: float = THRESHOLD, separator: str = KEYWORD_SEPARATOR
) -> DataFrame:
    """``line`` from ``ranked_words``: the keyword rewrite, no text needed."""
    line = keyword_line(keywords_above(F.col("ranked"), threshold), separator)
    return ranked.withColumn("line", line).drop("ranked")


def mask_lines(
    words: DataFrame, ranked: DataFrame, threshold: float = THRESHOLD, mask: str = MASK
) -> DataFrame:
    """``line`` from ``document_words(.., skeleton=True)`` and ``ranked_words``.

    Only the skeleton is shuffled to its keywords, not the text.
    """
    keywords = ranked.select("doc_id", keywords_above(F.col("ranked"), threshold).alias("keywords"))
    rows = words.drop("words", "ids").join(keywords, "doc_id")
    line = mask_line(F.col("skeleton"), F.col("keywords"), mask)
    return rows.withColumn("line", line).drop("skeleton", "keywords")


def complement_lines(
    corpus: DataFrame, ranked: DataFrame, threshold: float = THRESHOLD, by: Sequence[str] = ()
) -> DataFrame:
    """``line``: each text without its keywords (no fallback keyword)."""
    keywords = ranked.select(
        "doc_id", keywords_above(F.col("ranked"), threshold, fallback=False).alias("keywords")
    )
    rows = drop_unlabelled(corpus).select(*by, "doc_id", "label", "text").join(keywords, "doc_id")
    line = complement_text(split_words(F.col("text")), F.col("keywords"))
    return rows.withColumn("line", line).drop("text", "keywords")
