import pytest
from pyspark.sql import functions as F

from labeltext.functions.lookups import name_of, renamed_by, required
from labeltext.functions.line_patterns import apply_pattern, register_pattern, single_line_pair
from labeltext.functions.text import clean_line, feature_terms, lower_words, pad_ids, split_words


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first().x


WORDS = [
    ("", []),
    ("   \n ", []),
    ("Good muffins cost $3.88 in New York.", ["Good", "muffins", "cost", "$", "3.88", "in", "New", "York", "."]),
    ("They'll save and invest more.", ["They", "'ll", "save", "and", "invest", "more", "."]),
    ("hi, my name can't hello,", ["hi", ",", "my", "name", "ca", "n't", "hello", ","]),
    ("I cannot cannot do it.", ["I", "can", "not", "can", "not", "do", "it", "."]),
    ("'Tis gonna rain", ["'T", "is", "gon", "na", "rain"]),
    ('He said "go (now)!" twice', ["He", "said", "``", "go", "(", "now", ")", "!", "''", "twice"]),
    ("One. Two. Three", ["One", ".", "Two", ".", "Three"]),
    ("Pay 1,000 at 10:30, ok: yes", ["Pay", "1,000", "at", "10:30", ",", "ok", ":", "yes"]),
    ("wait... what -- no", ["wait", "...", "what", "--", "no"]),
    ("the dogs' bowl is John's", ["the", "dogs", "'", "bowl", "is", "John", "'s"]),
    ("a\\b", ["a", "b"]),
    ("x \\ y", ["x", "", "", "y"]),
    ("\\", ["", ""]),
    ("tab\there and there", ["tab", "here", "and", "there"]),
]


@pytest.mark.parametrize("text,words", WORDS)
def test_words(spark, text, words):
    assert value(spark, split_words(F.col("t")), text) == words


def test_lower_after_splitting(spark):
    assert value(spark, lower_words(split_words(F.col("t"))), "A\\B Cé") == ["a", "b", "cé"]
    assert value(spark, lower_words(split_words(F.col("t")), 2), "A B C D") == ["a", "b"]


@pytest.mark.parametrize(
    "text,line",
    [("\ta\nb ", "a b"), ("a\r\nb", "a\r b"), (" \x1ca　", "a"), ("\n \n", ""), ("a\n\nb", "a  b")],
)
def test_clean_line(spark, text, line):
    assert value(spark, clean_line(F.col("t")), text) == line
    assert line == text.strip().replace("\n", " ")


def test_feature_terms(spark):
    assert value(spark, feature_terms(F.col("t")), "The cat_1 é éa, a I'll go-now") == ["cat_1", "éa", "ll", "go"]
    assert value(spark, feature_terms(F.col("t"), []), "The a cat") == ["the", "cat"]


@pytest.mark.parametrize(
    "ids,out", [([5, 6], [5, 6, 0, 0, 0]), ([1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 5]), ([], [0] * 5)]
)
def test_pad_ids(spark, ids, out):
    df = spark.createDataFrame([(ids,)], "ids array<int>")
    assert df.select(pad_ids(F.col("ids"), 5).alias("x")).first().x == out


def test_patterns(spark):
    a, b = F.lit("A"), F.lit("B")
    assert value(spark, apply_pattern("nli_prompt_0", a, b), "") == "A Is it true that B ?"
    assert value(spark, apply_pattern("nli_prompt_1", a, b), "") == "A @separater@ B"
    assert value(spark, single_line_pair(a, b), "") == "A @separator@ B"
    register_pattern("shout", lambda x: F.upper(x))
    assert value(spark, apply_pattern("shout", F.lit("hey")), "") == "HEY"
    with pytest.raises(ValueError):
        apply_pattern("no_such", a)
    with pytest.raises(ValueError):
        apply_pattern("nli_prompt_0", a)


def test_lookups(spark):
    df = spark.createDataFrame([(0,), (1,)], "i int")
    assert [r.x for r in df.select(name_of(F.col("i"), ["a", "b"]).alias("x")).collect()] == ["a", "b"]
    with pytest.raises(Exception, match="no name for index 1"):
        df.select(name_of(F.col("i"), ["a"])).collect()
    nulls = spark.createDataFrame([("v",), (None,)], "s string")
    with pytest.raises(Exception, match="s must not be NULL"):
        nulls.select(required(F.col("s"), "s")).collect()
    assert value(spark, renamed_by(F.col("t"), {"val": "dev"}), "val") == "dev"
    assert value(spark, renamed_by(F.col("t"), {"val": "dev"}), "other") is None
