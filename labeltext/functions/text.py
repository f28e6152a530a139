"""Word splitting and line cleaning as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from string import ascii_letters, digits

from pyspark.sql import Column
from pyspark.sql import functions as F

from labeltext.fixed_values import (
    FUSED_WORDS,
    LINE_WHITESPACE,
    QUOTE_MARKS,
    STOP_WORDS,
    TERM_PATTERN,
    WORD_STEPS,
)
from labeltext.functions.lookups import let


# White space becomes blanks in the first step, so this character is free after it: it
# stands for a full stop that stays with its word.
KEPT_STOP = "\x1f"

# Forms of some steps that pass over letters faster and find the same words: what cannot
# start a match is left by one look at a table, and signs are sought before what precedes
# them. They use look-around, which RE2 does not have.
_WHITE, _SIGNS, _STOP, _CLITICS = (WORD_STEPS[i][1] for i in (0, 2, 4, 9))
FASTER = {
    _WHITE: (f"(?=[^{ascii_letters}{digits}]){_WHITE}", "  "),
    _SIGNS: (f"(?=[^ {ascii_letters}{digits}]){_SIGNS}", " $1 "),
    _STOP: (r"\.(?<=[^.]\.)( |' )", " . $1"),
    _CLITICS: (f"(?=['nN]){_CLITICS.replace("([^' ])", "(?<=[^' ])")}", " $1 "),
}


def _step(spaced: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(spaced, *FASTER.get(pattern, (pattern, replacement)))


def _spaced(text: Column, *kinds: str, keep: Callable[[Column], Column] | None = None) -> Column:
    spaced = blank_spaced(text)
    if keep is not None:
        spaced = keep(spaced)
    for kind, pattern, replacement in WORD_STEPS[1:]:
        if kind in kinds:
            spaced = _step(spaced, pattern, replacement)
    return spaced


def blank_spaced(text: Column) -> Column:
    """The text between blanks, each run of white space as two blanks."""
    _, pattern, replacement = WORD_STEPS[0]
    return _step(F.concat(F.lit(" "), text, F.lit(" ")), pattern, replacement)


def text_pieces(text: Column) -> Column:
    """The pieces of a text between white space, which are those of its ``blank_spaced`` form."""
    return F.array_remove(F.split(text, FASTER[_WHITE][0], -1), "")


def _contains_any(text: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])


def split_words(text: Column, keep: Callable[[Column], Column] | None = None) -> Column:
    """Treebank-style words of a text, in order and with their case.

    Pieces around a backslash become words of their own; empty pieces stay. Steps
    that cannot match a text are left out for it, which a cheap scan decides.
    ``keep`` maps the ``blank_spaced`` text to the same text with ``KEPT_STOP`` for
    every full stop that is to stay with its word.
    """
    spaced = (
        F.when(_contains_any(F.lower(text), FUSED_WORDS), _spaced(text, "always", "quote", "fused", keep=keep))
        .when(_contains_any(text, QUOTE_MARKS), _spaced(text, "always", "quote", keep=keep))
        .otherwise(_spaced(text, "always", keep=keep))
    )
    if keep is not None:
        spaced = F.replace(spaced, F.lit(KEPT_STOP), F.lit("."))
    # The text starts with a blank, so the first piece is none of its words.
    pieces = F.split(F.rtrim(spaced), r" +|\\", -1)
    return let(pieces, lambda p: F.slice(p, 2, F.size(p)))


def leading_pieces(text: Column, n: int) -> Column:
    """The text up to the end of its first ``n`` blank-separated pieces.

    Every word lies inside a piece and every piece holds one at least, so the first
    ``n`` words of a text are those of this part of it.
    """
    white = WORD_STEPS[0][1].removesuffix("+")
    pattern = rf"^(?:{white}*+[^{white[1:]}++){{0,{n}}}+"
    return F.regexp_extract(text, pattern, 0)


def lower_words(words: Column, first: int | None = None) -> Column:
    """Lower-cased words; with ``first``, only that many leading ones."""
    if first is not None:
        words = F.slice(words, 1, first)
    return F.transform(words, F.lower)


def search_among(words: Column, body: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """``body(among)``, where ``among(word)`` tests whether a word is among ``words``.

    One search in the joined words instead of a comparison with each. No word has the
    signs that enclose them, which are white space to ``split_words``.
    """
    enclosed = lambda w: F.concat(F.lit("\x1e"), w, F.lit("\x1f"))
    joined = F.array_join(F.transform(words, lambda w: enclosed(w)), "")
    return let(joined, lambda j: body(lambda word: F.contains(j, enclosed(word))))


def clean_line(text: Column) -> Column:
    """Text as one line: outer white space dropped, newlines made blanks."""
    return F.replace(F.btrim(text, F.lit(LINE_WHITESPACE)), F.lit("\n"), F.lit(" "))


def feature_terms(text: Column, stop_words: list[str] | None = None) -> Column:
    """Lower-cased terms of 2+ word characters without the stop words."""
    stops = STOP_WORDS if stop_words is None else stop_words
    terms = F.regexp_extract_all(F.lower(text), F.lit(TERM_PATTERN), 0)
    return F.filter(terms, lambda t: ~t.isin(stops)) if stops else terms


def pad_ids(ids: Column, length: int | Column, pad_id: int = 0) -> Column:
    """Ids cut or padded to ``length``."""
    size = F.lit(length) if isinstance(length, int) else length
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad_id), size)), F.lit(1), size)
