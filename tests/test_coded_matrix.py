"""Matrices whose terms are numbers: the same products as by long weights, in far less disk."""

import os

import numpy as np
import pytest
from catalog import queries
from labeltext.operators import coded, features
from labeltext.plans import jobs
from pyspark.sql import functions as F

RNG = np.random.default_rng(5)
ROWS = [(i, [f"t{j}" for j in RNG.integers(0, 40, 12) ** 2 // 40] + [f"x{i}"]) for i in range(80)]
# Ids that repeat or are missing, no terms, only terms that are left out, a large count.
ROWS += [(5, ["t5", "t1", "t1"]), (5, ["t5"]), (None, ["t1", "t0"]), (None, ["t1"]), (90, []), (91, None), (92, ["x0"]), (93, ["t1"] * 40_000)]


def checkpoint_folder(spark):
    return spark.sparkContext.getCheckpointDir().removeprefix("file:")


def dense(weights):
    rows = weights.collect()
    docs, terms = sorted({str(r.doc_id) for r in rows}), sorted({r.term for r in rows})
    matrix = np.zeros((len(docs), len(terms)))
    for r in rows:
        matrix[docs.index(str(r.doc_id)), terms.index(r.term)] += r.weight
    return matrix, docs, terms


@pytest.fixture
def terms(spark):
    return spark.createDataFrame(ROWS, "doc_id bigint, terms array<string>").repartition(3)


@pytest.mark.parametrize("column_bytes, often, shared", [(1 << 20, 0.004, 1 << 17), (1, 2.0, 5), (600, 0.2, 40)])
def test_products_are_those_of_the_weights(spark, terms, monkeypatch, column_bytes, often, shared):
    monkeypatch.setattr(coded, "COLUMN_BYTES", column_bytes)
    monkeypatch.setattr(coded, "DENSE_SHARE", often)
    monkeypatch.setattr(coded, "SHARED_ENTRIES", shared)
    monkeypatch.setattr(coded, "RANGE", 7)
    monkeypatch.setattr(coded, "STEP_NUMBERS", 300)
    a, docs, names = dense(features.tfidf_weights(features.term_counts(terms), 3, 0.9))
    matrix = features.term_matrix(terms, 3, 0.9)
    assert isinstance(matrix, features.Coded) and matrix.number == len(names)
    # One term has no vector.
    v = np.random.default_rng(1).standard_normal((len(names), 3))
    v[0] = 0.0
    table = spark.createDataFrame([(t, x.tolist()) for t, x in zip(names[1:], v[1:])], "term string, v array<double>")
    got = {str(r.doc_id): r.v for r in features.image(matrix, table).collect()}
    assert got.keys() == {d for d, row in zip(docs, a) if row[1:].any()}
    assert all(np.allclose(got[d], row @ v, 1e-12) for d, row in zip(docs, a) if d in got)
    for kind, near in (("double", 1e-12), ("float", 1e-5)):
        back = {r.term: r.v for r in features.normal_product(matrix, table, 3, kind).collect()}
        assert len(back) == len(names) and all(np.allclose(back[t], w, near, near) for t, w in zip(names, a.T @ (a @ v)))
    assert np.allclose(features.image_gram(matrix, table, 3), (a @ v).T @ (a @ v))
    single = features.tfidf_weights(features.term_counts(terms), 3, 0.9).groupBy("term").agg(F.sum(F.col("weight") ** 2).alias("s"))
    assert np.allclose(sorted(r.s for r in matrix.squares().collect()), sorted(r.s for r in single.collect()))


def test_lsa_of_a_coded_matrix(terms, monkeypatch):
    monkeypatch.setattr(coded, "COLUMN_BYTES", 600)
    a, docs, names = dense(features.tfidf_weights(features.term_counts(terms), 3, 0.9))
    matrix = features.term_matrix(terms, 3, 0.9)
    model = features.fit_lsa(matrix, 4, iterations=12)
    assert model.singular_values == pytest.approx(np.linalg.svd(a, compute_uv=False)[:4], rel=1e-6)
    w = {r.term: r.w for r in model.components.collect()}
    v = np.array([w[t] for t in names])
    assert np.allclose(v.T @ v, np.eye(4), atol=1e-8)
    for given in (matrix, features.Coded(matrix.rows, matrix.terms, matrix.shared, matrix.number, matrix.dense)):
        found = {str(r.doc_id): r.features.toArray() for r in features.lsa_vectors(given, model).collect()}
        assert found.keys() == set(docs)
        assert all(np.allclose(found[d], x / np.linalg.norm(x), atol=1e-8) for d, x in zip(docs, a @ v))


def test_terms_beyond_the_lookup_go_by_blocks(terms, monkeypatch):
    marked = terms.withColumn("fit", F.col("doc_id") % 2 == 0)
    few = features.term_matrix(marked, 3, 0.9)
    monkeypatch.setattr(features, "LOOKUP_TERMS", -1)
    many = features.term_matrix(marked.where("doc_id IS NOT NULL"), 3, 0.9)
    assert isinstance(many, features.Blocked) and not isinstance(few, features.Blocked)
    assert {r.term for r in few.terms.collect()} == {r.term for r in many.terms.collect()}
    s = [features.fit_lsa(m.fitted(), 3, iterations=12).singular_values for m in (few, many)]
    assert s[0] == pytest.approx(s[1], rel=1e-6)


def test_no_weight_becomes_a_row_on_disk(spark, small):
    folder = checkpoint_folder(spark)
    before = set(os.listdir(folder))
    queries.normal_products(spark, small).count()
    new = set(os.listdir(folder)) - before
    size = sum(os.path.getsize(os.path.join(d, f)) for x in new for d, _, names in os.walk(os.path.join(folder, x)) for f in names)
    entries = features.term_matrix(features.document_terms(queries.tables.news(spark, small))).rows.agg(F.sum(F.size("at"))).first()[0]
    # A row per weight alone takes more, and so do blocks of text, rows, slots and values.
    assert size < 40 * entries
    assert not [x for x in new if x.startswith("coded-")]


def test_the_classifier_keeps_repeated_rows(spark):
    rows = [(i, "train" if i % 3 else "test", f"alpha beta gamma{i % 2} w{i % 4}x", i % 2) for i in range(40)] * 2
    frame = spark.createDataFrame(rows, "doc_id int, split string, text string, label int")
    done = jobs.classifier_rows(frame, dims=2, min_df=2, max_df=1.0)
    # Rows of an id meet each other, once for the counts and once for the vectors.
    assert done.count() == 40 * 2**4 and {len(r.features) for r in done.collect()} == {2}


def test_settings_come_back(spark):
    before = [spark.conf.get(k) for k in (coded.BATCH_ROWS, coded.DELETE_SHUFFLES)]
    with pytest.raises(ValueError), coded.working(spark, 7):
        assert spark.conf.get(coded.BATCH_ROWS) == "7"
        raise ValueError
    assert before == [spark.conf.get(k) for k in (coded.BATCH_ROWS, coded.DELETE_SHUFFLES)]
