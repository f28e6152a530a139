"""Statistics of the first words split no more of a text than holds them."""

import random

from labeltext.functions.text import leading_pieces, lower_words, split_words
from labeltext.operators.lift import document_words
from pyspark.sql import functions as F

PARTS = ["can't", "'Tis", "\\", "a\\b", "end.", "end.'", "\"q\"", "``", "x--y", "1,5", "a,b", "cannot", "Gonna", "...", "(", "d'ye", "é.", "«o»",
         "'s", "''", "🙂!", "More'n"]
BLANKS = [" ", "  ", "\n", "\t\r\n", "\x1f", "\x85", " ", " ", "　 "]


def _texts():
    rng = random.Random(5)
    made = ["".join(rng.choice(PARTS) + rng.choice(BLANKS) for _ in range(rng.randrange(12))) for _ in range(300)]
    return [*made, *[" " + t.rstrip() for t in made], "", " ", "\n", "\\", None, "word"]


def test_first_words_are_those_of_the_leading_pieces(spark):
    rows = spark.createDataFrame(list(enumerate(_texts())), "doc_id int, text string")
    for n in (1, 3, 5):
        whole, part = lower_words(split_words(F.col("text")), n), lower_words(split_words(leading_pieces(F.col("text"), n)), n)
        assert rows.where(~whole.eqNullSafe(part)).count() == 0


def test_document_words_split_only_what_they_need(spark):
    text = " a b  c. " + "d, " * 50_000
    assert spark.range(1).select(leading_pieces(F.lit(text), 3)).first()[0] == " a b  c."
    rows = spark.createDataFrame([(1, text, 0)], "doc_id int, text string, label int")
    assert document_words(rows, max_len=4).first().words == ["a", "b", "c", "."]
    plan = document_words(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" in plan
