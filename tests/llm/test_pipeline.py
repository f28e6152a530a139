"""The pipeline's stages, each against brute force on what the one before kept."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_llm import brute_exact, brute_simhash, lay_out, words

NAMES = ["quality", "exact_dedup", "simhash", "substring_dedup", "pattern_packing"]


@pytest.fixture(scope="module")
def kept(spark, small, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("stages"))
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], small).write.parquet(f"{folder}/{number}")
        out.append(spark.read.parquet(f"{folder}/{number}"))
    return out


def test_stages_keep_the_columns(kept):
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    assert all(d.columns == kept[0].columns for d in kept[:-1])


def test_quality_stage_keeps_the_good(spark, small, kept):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    left = {r.doc_id for r in kept[1].collect()}
    good = [r.doc_id in left for r in labels.collect() if r.quality == 1]
    bad = [r.doc_id in left for r in labels.collect() if r.quality == 0]
    assert sum(good) / len(good) > 0.95 and sum(bad) / len(bad) < 0.2


def test_exact_stage(kept):
    want = {k[1] for k in brute_exact([(r.doc_id, r.text) for r in kept[1].collect()])}
    assert sorted(r.doc_id for r in kept[2].collect()) == sorted(want)


def test_simhash_stage(kept):
    want = {k[2] for k in brute_simhash([(r.doc_id, r.text) for r in kept[2].collect()])}
    assert sorted(r.doc_id for r in kept[3].collect()) == sorted(want)


def test_substring_stage(kept):
    before, after = ({r.doc_id: r for r in d.collect()} for d in kept[3:5])
    assert before.keys() == after.keys()
    for doc, r in after.items():
        assert len(r.text) == r.n_chars <= before[doc].n_chars
    assert sum(before[d].text == after[d].text for d in after) > 0.5 * len(after)


def test_packing_stage(kept):
    rows = kept[5].collect()
    lay_out(rows, 2048)
    assert sorted({r.doc_id for r in rows}) == sorted(r.doc_id for r in kept[4].collect())


def test_run_is_the_stages(spark, small, kept):
    got = corpus_pipeline.run(spark, small).drop("sequence_id", "offset")
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, kept[5].drop("sequence_id", "offset").collect()))


def test_stages_take_odd_and_empty_tables(spark, small, kept):
    odd = kept[0].limit(3).select(
        F.when(F.col("doc_id") > 0, F.col("doc_id")).alias("doc_id"), F.lit(None).cast("string").alias("text"), "lang", "source", "n_chars"
    ).withColumns({"_hash": F.lit(1), "_order": F.lit("x")})
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            done = stage(spark, docs, small)
            assert done.count() <= 3


def test_simhash_stage_removes_rows_not_ids(spark, small, kept):
    """Rows with repeated ids or none: each group keeps the row with the least id, and no other row goes."""
    rng = random.Random(11)
    alpha, beta, gamma, delta = (words(rng, 60) for _ in range(4))
    texts = [
        (1, alpha), (2, alpha.upper()), (2, beta), (3, gamma), (3, gamma), (None, delta), (None, delta),
        (None, beta), (5, None), (4, ""), (None, " "), (6, words(rng, 60)), (None, words(rng, 60)),
    ]
    docs = spark.createDataFrame([(i, t, "en", i, 7) for i, t in texts], "doc_id long, text string, lang string, number long, _number int")
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_stage(spark, docs.repartition(3), small).collect())
    unique = [texts[11], texts[12]]
    assert got == Counter([(1, alpha), (2, beta), (3, gamma), (None, delta), (4, ""), *unique])
    pairs = [(d, t) for d, t in texts if d is not None]
    assert len({g for _, _, g in brute_simhash(pairs)}) == 5


def test_simhash_stage_with_half_the_ids_missing(spark, small):
    """As many rows stay as there are groups, whatever their ids."""
    rng = random.Random(12)
    rows = [(None if i % 2 else i // 10, f"{words(rng, 1)} {words(rng, 40)}") for i in range(200)]
    rows += [(i, rows[j][1]) for j, i in enumerate([None, 3, 900, None, 7] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept_rows = corpus_pipeline.near_stage(spark, docs, small).collect()
    groups = Counter(g for _, _, g in brute_simhash([(n, t) for n, (_, t) in enumerate(rows)]).elements())
    assert len(kept_rows) == len(groups)
