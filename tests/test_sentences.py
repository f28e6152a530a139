"""Abbreviations, openers and words that keep the stops of abbreviations."""

import math
import random

import pytest
from pyspark.sql import functions as F

from labeltext.functions.text import split_words
from labeltext.operators import sentences

NOUNS = "house river paper engine garden market window letter doctor street".split()
NAMES = "Smith Jones Weber Moreau Garcia".split()


def corpus_rows():
    """Prose in which a few abbreviations stand often, also before capitals."""
    rng = random.Random(1)
    rows = []
    for i in range(300):
        said = []
        for _ in range(rng.randint(3, 8)):
            a, b, name = rng.choice(NOUNS), rng.choice(NOUNS), rng.choice(NAMES)
            said.append(rng.choice([
                f"The {a} stood near the {b}.", f"Mr. {name} saw the {a} and the {b}.", f"She said that the U.S. {a} was a {b}.",
                f"They like things, e.g. the {a}, and the {b} of {name}.", f"He and {name} left the {a}!", f"Was the {b} seen by Dr. {name}?",
                f"It came from the U.S. The {a} was new.", f"the {a} is old, but she said so.",
                f"It is so new that the {a} and a new {b} are so far away.",
            ]))
        rows.append((i, " ".join(said)))
    return rows


@pytest.fixture(scope="module")
def corpus(spark):
    odd = [(1000, None), (1001, ""), (1002, " \n "), (1003, "..."), (1004, "\x1f. a.\x1f b"), (1005, "Mr.")]
    return spark.createDataFrame(corpus_rows() + odd, "doc_id long, text string").repartition(4).cache()


@pytest.fixture(scope="module")
def model(corpus):
    return sentences.fit(corpus)


def words(spark, model, texts, key="doc_id"):
    frame = spark.createDataFrame(list(enumerate(texts)), f"{key} long, text string")
    return [r.words for r in sentences.sentence_words(frame, model).orderBy(key).collect()]


def test_finds_the_abbreviations(model):
    found = {r.type for r in model.abbreviations.collect()}
    assert {"mr", "dr", "u.s", "e.g"} <= found
    assert not found & {*NOUNS, *(n.lower() for n in NAMES), "so", "new"}
    assert "the" in {r.type for r in model.openers.collect()} and "smith" not in {r.type for r in model.openers.collect()}


CASES = {
    "Mr. Smith saw it.": "Mr. Smith saw it .",
    "the U.S. economy grew. Then": "the U.S. economy grew . Then",
    "things, e.g. this, and more.": "things , e.g. this , and more .",
    "from the U.S. The house": "from the U.S . The house",
    "in the U.S.": "in the U.S .",
    'He said "Mr. Jones left." Then': "He said `` Mr. Jones left . '' Then",
    "(e.g. this) was": "( e.g. this ) was",
    "a house. A river... Dr. Weber can't. He cannot.": "a house . A river ... Dr. Weber ca n't . He can not .",
    "Mr.\n\tSmith": "Mr. Smith",
    "Mr . Smith": "Mr . Smith",
    "see http://a.b/c. Dr. 7": "see http : //a.b/c . Dr. 7",
    "It's 3.5 p. and": "It 's 3.5 p . and",
    "a\\Mr. B.": "a Mr . B .",
    "": "",
}


def test_words_keep_inner_stops(spark, model):
    assert [" ".join(w) for w in words(spark, model, CASES)] == list(CASES.values())


def test_without_abbreviations_words_are_as_before(spark, corpus, model):
    empty = sentences.SentenceModel(model.abbreviations.limit(0), model.openers.limit(0))
    both = sentences.sentence_words(corpus, empty, "w").withColumn("plain", split_words(F.col("text")))
    assert both.where("NOT (w <=> plain)").count() == 0


def test_joins_give_the_same_words(spark, corpus, model, monkeypatch):
    small = sentences.sentence_words(corpus, model, "w").collect()
    in_plan = sentences.opener_counts(corpus, model.abbreviations).collect()
    monkeypatch.setattr(sentences, "PLAN_TYPES", 0)
    large = sentences.sentence_words(corpus, model, "w")
    assert large.columns == ["doc_id", "text", "w"]
    assert sorted(map(repr, small)) == sorted(map(repr, large.collect()))
    assert sorted(in_plan) == sorted(sentences.opener_counts(corpus, model.abbreviations).collect())
    assert [" ".join(w) for w in words(spark, model, CASES)] == list(CASES.values())


def test_scores_by_hand(spark):
    rows = [("x", 3, 0), ("a.b", 2, 1), ("long", 40, 60), ("9", 5, 0), ("word", 0, 50)]
    counts = spark.createDataFrame(rows, "type string, n_stop long, n_plain long")
    got = {r.type: r.score for r in sentences.abbreviations(counts, least=-math.inf).collect()}
    p = 50 / 161

    def score(k, rest, letters, stops):
        ratio = k * math.log(p) + rest * math.log(1 - p) - k * math.log(0.99) - rest * math.log(0.01)
        return -2 * ratio * math.exp(-letters) * stops * letters**-rest

    assert got == pytest.approx({"x": score(3, 0, 1, 1), "a.b": score(2, 1, 2, 2), "long": score(40, 60, 4, 1)})


def test_empty_corpus(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = sentences.fit(none)
    assert model.abbreviations.count() == model.openers.count() == 0
    assert sentences.sentence_words(none, model).columns == ["doc_id", "text", "words"]


def test_capital_follower_needs_evidence(spark):
    counts = spark.createDataFrame(
        [("the", 100, 60, 30, 0, 5), ("smith", 50, 0, 0, 40, 5), ("he", 80, 70, 0, 9, 2), ("unseen", 10, 9, 1, 0, 0), ("of", 1000, 0, 1000, 0, 0)],
        "type string, n long, n_start long, n_lower long, n_inside long, n_after_short long",
    )
    assert {r.type for r in sentences.openers(counts).collect()} == {"the", "he"}
