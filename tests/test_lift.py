from collections import Counter

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from catalog import tables
from labeltext.functions.text import lower_words, split_words
from labeltext.operators import corpus, lift, rewrite
from labeltext.operators import vocabulary as vocab
from labeltext.operators.scale import join_counted, small_table, spread, with_row_index


def ranked(words, by=()):
    return lift.ranked_words(words, lift.class_lift(words, by), by)


def lines(df):
    return {r.doc_id: r.line for r in df.collect()}


def corpus_of(spark, *rows):
    return spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(rows, 1)], "doc_id bigint, text string, label int")


def rewrites(rows, vocabulary=None, max_len=30):
    words = lift.document_words(rows, max_len, skeleton=True)
    if vocabulary is not None:
        words = vocab.encode(words, vocabulary, "words")
    r = ranked(words)
    return (
        lines(rewrite.keyword_lines(r)),
        lines(rewrite.mask_lines(words, r)),
        lines(rewrite.complement_lines(rows, r)),
    )


def test_golden_rows(movies):
    keyword, mask, rest = rewrites(movies)
    assert keyword == {1: "good", 2: "good", 3: "bad", 4: "bad | ,"}
    assert mask == {
        1: "<mask> Good <mask>.",
        2: "<mask> good <mask>.",
        3: "<mask> bad <mask>.",
        4: "<mask> bad <mask>, <mask> bad <mask>.",
    }
    assert rest == {1: "movie .", 2: "plot .", 3: "movie .", 4: "plot ."}


def test_golden_rows_with_vocabulary(spark, movies):
    listed = spark.createDataFrame([("good", 0), ("bad", 1), ("movie", 2), ("plot", 3)], "token string, at int")
    keyword, mask, rest = rewrites(movies, vocab.build_vocabulary(listed, "at"))
    assert keyword[4] == "bad"
    assert mask[4] == "<mask> bad <mask>, <mask> bad <mask>."
    assert rest[4] == "plot , ."


def test_nothing_above_threshold_keeps_the_best_word(spark):
    keyword, _, rest = rewrites(corpus_of(spark, ("a b", 0), ("a c", 0)))
    assert keyword == {1: "a", 2: "a"}
    assert rest == {1: "a b", 2: "a c"}


def test_document_without_words(spark):
    keyword, mask, rest = rewrites(corpus_of(spark, ("", 0), ("good", 0), ("bad", 1)))
    assert keyword[1] == mask[1] == "<mask>" and rest[1] == ""


def test_leading_punctuation(spark):
    _, mask, _ = rewrites(corpus_of(spark, (", good", 0), ("bad", 1)))
    assert mask[1] == "<mask> , <mask> good"


def test_only_first_words_count_but_the_whole_text_is_masked(spark):
    filler = " ".join(f"w{i}" for i in range(29))
    rows = corpus_of(spark, (f"good {filler} late good", 0), ("bad late", 1))
    keyword, mask, _ = rewrites(rows)
    assert "late" not in keyword[1]
    assert mask[1].endswith("<mask> good") and mask[1].count("good") == 2


def test_properties(spark, small):
    words = lift.document_words(tables.news(spark, small)).persist()
    scores = lift.class_lift(words).persist()
    per_word = scores.groupBy("word", "n_total").agg(
        F.sum("n_class").alias("n"), F.sum(F.col("score") * F.col("class_docs") / F.col("all_docs")).alias("one")
    )
    assert per_word.where("n != n_total or abs(one - 1) > 1e-9").count() == 0


def test_matches_plain_counting(spark, small):
    rows = tables.news(spark, small)
    texts = rows.select("doc_id", "label", lower_words(split_words(F.col("text")), 30).alias("w")).collect()
    n_class, n_word, n_pair = Counter(), Counter(), Counter()
    for r in texts:
        n_class[r.label] += 1
        n_word.update(set(r.w))
        n_pair.update((w, r.label) for w in set(r.w))
    want = {}
    for r in texts:
        score = {w: n_pair[w, r.label] / n_class[r.label] * (len(texts) / n_word[w]) for w in r.w}
        order = sorted(dict.fromkeys(r.w), key=lambda w: -score[w])
        want[r.doc_id] = [(w, score[w]) for w in order]
    got = {
        r.doc_id: [(x.word, x.score) for x in r.ranked]
        for r in ranked(lift.document_words(rows)).collect()
    }
    assert got == want


def test_statistics_are_separate_by_split(spark, small):
    rows = tables.news(spark, small)
    together = ranked(lift.document_words(rows, by=["split"]), ["split"])
    for split in ("train", "test"):
        alone = ranked(lift.document_words(corpus.choose_split(rows, split)))
        a = {r.doc_id: r.ranked for r in alone.collect()}
        b = {r.doc_id: r.ranked for r in together.where(F.col("split") == split).collect()}
        assert a == b


def test_raw_scores(spark):
    rows = corpus_of(spark, ("a b a", 0), ("b", 1), ("c", 1))
    words = lift.document_words(rows, 4)
    scores = lift.class_lift(words)
    observed = {r.doc_id: r for r in lift.word_records(words, scores, 4).collect()}
    assert observed[1].sorted_words == ["a", "b"]
    assert observed[1].raw_scores == [3.0, 1.5, 3.0, 1.0]
    skipped = {r.doc_id: r for r in lift.word_records(words, scores, 4, "skip").collect()}
    assert skipped[2].raw_scores == [0.75, -1.0, -1.0, -1.0]
    with pytest.raises(ValueError):
        lift.word_records(words, scores, 4, "other")


def test_unlabelled_rows_are_dropped_and_counted(spark):
    rows = corpus_of(spark, ("a", 0), ("b", None))
    seen = Observation()
    assert corpus.drop_unlabelled(rows, seen).count() == 1
    assert seen.get["unlabelled"] == 1
    assert {r.label: r.n_docs for r in lift.label_counts(rows).collect()} == {0: 1, None: 1}


def test_vocabulary(spark):
    words = spark.createDataFrame([("a", 0), ("b", 1), ("a", 2)], "token string, at int")
    table = vocab.build_vocabulary(words, "at")
    assert {r.token: r.token_id for r in table.collect()} == {"<pad>": 0, "<unk>": 1, "<mask>": 2, "a": 5, "b": 4}
    assert [r.token for r in vocab.vocabulary_tokens(table).collect()] == ["<pad>", "<unk>", "<mask>", "b", "a"]
    rows = spark.createDataFrame([(1, ["b", "x", "a"]), (2, []), (3, ["a"])], "doc_id bigint, w array<string>")
    longest = {r.doc_id: r.ids for r in vocab.encode_padded(rows, table, "w").collect()}
    assert longest == {1: [4, 1, 5], 2: [0, 0, 0], 3: [5, 0, 0]}
    fixed = {r.doc_id: r.ids for r in vocab.encode_padded(rows, table, "w", 2).collect()}
    assert fixed == {1: [4, 1], 2: [0, 0], 3: [5, 0]}


def test_large_vocabulary_path(spark, monkeypatch, small):
    table = vocab.build_vocabulary(
        tables.table(spark, small, "benchmark").select(F.explode(lower_words(split_words(F.col("text")))).alias("token")).distinct()
    ).persist()
    rows = lift.document_words(tables.news(spark, small)).persist()
    want = {r.doc_id: r.ids for r in vocab.encode(rows, table, "words").collect()}
    monkeypatch.setattr(vocab, "BROADCAST_WORDS", 5)
    assert {r.doc_id: r.ids for r in vocab.encode(rows, table, "words").collect()} == want


@pytest.mark.parametrize("frequent_keys", [1, 3, 20, 250_000])
def test_join_counted_is_a_plain_join(spark, frequent_keys):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 97).cast("string"))).alias("k"), "id"
    )
    counted = rows.groupBy("k").agg(F.count("*").alias("n"))
    got = join_counted(rows, counted, ["k"], "n", frequent_keys)
    assert sorted(map(tuple, got.select("k", "id", "n").collect())) == sorted(
        map(tuple, rows.join(counted, "k").select("k", "id", "n").collect())
    )
    share = F.col("n") * frequent_keys >= counted.agg(F.sum("n")).scalar()
    assert counted.where(share).count() <= frequent_keys


def test_row_index(spark):
    df = spark.range(1000).select(F.md5(F.col("id").cast("string")).alias("k")).repartition(7)
    got = with_row_index(df, ["k"]).orderBy("row_index").collect()
    assert [r.row_index for r in got] == list(range(1000))
    assert [r.k for r in got] == sorted(r.k for r in got)


def test_small_table_and_spread(spark):
    df = spark.range(50)
    assert small_table(df, 10) is df
    assert sorted(r.id for r in small_table(df, 50).collect()) == list(range(50))
    one = spark.range(0, 100, 1, 1)
    assert spread(one, "id").count() == 100


def test_lift_with_few_broadcast_keys_is_the_same(spark, small, monkeypatch):
    words = lift.document_words(tables.news(spark, small)).persist()
    scores = lift.class_lift(words).persist()
    want = Counter(map(str, lift.ranked_words(words, scores).collect()))
    monkeypatch.setattr(lift, "join_counted", lambda *a: join_counted(*a, frequent_keys=20))
    assert Counter(map(str, lift.ranked_words(words, scores).collect())) == want


def test_repeated_token_of_a_word_list(spark):
    listed = spark.createDataFrame([("b",)] * 500 + [("a",), ("c",)], "token string")
    found = {r.token: r.token_id for r in vocab.build_vocabulary(listed).collect()}
    assert found == {"<pad>": 0, "<unk>": 1, "<mask>": 2, "a": 3, "b": 503, "c": 504}


def test_encode_keeps_other_columns_and_wordless_rows(spark, monkeypatch):
    rows = [(1, "x", ["a", "z", "a"]), (2, None, []), (3, "y", None)]
    frame = spark.createDataFrame(rows, "doc_id int, extra string, words array<string>")
    vocabulary = vocab.build_vocabulary(spark.createDataFrame([("a", 0)], "token string, at int"), "at")
    want = [(1, "x", ["a", "z", "a"], [3, 1, 3]), (2, None, [], []), (3, "y", None, [])]
    encoded = vocab.encode(frame, vocabulary, "words")
    assert sorted(map(tuple, encoded.collect()), key=str) == want
    # A small vocabulary is looked up in the list: rows are neither shuffled nor regrouped.
    plan = encoded._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan and "Generate" not in plan
    odd = spark.createDataFrame([(1, ["a", None, "b"]), (1, ["a"])], "doc_id int, words array<string>")
    assert [r.ids for r in vocab.encode(odd, vocabulary, "words").collect()] == [[3, 1, 1], [3]]
    monkeypatch.setattr(vocab, "BROADCAST_WORDS", 0)
    joined = vocab.encode(frame, vocabulary, "words")
    assert sorted(map(tuple, joined.collect()), key=str) == want
    # One grouping gives the rows back: no join of the result with its own input.
    assert joined._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [doc_id") == 1
