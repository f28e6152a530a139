"""TF-IDF weights by lookup: the same as by joins, and a document is one row until the end."""

import numpy as np
import pyarrow as pa
import pytest
from labeltext.operators import cluster, features, scale
from pyspark.sql import functions as F

ROWS = [(i, ["b", f"t{i % 7}", f"u{i % 3}", "b" * (i % 2 + 1), f"x{i}"]) for i in range(60)]
# Ids that repeat or are missing, no terms, only terms that are left out.
ROWS += [(5, ["t5", "u1", "u1"]), (5, ["t5"]), (None, ["t1", "u0"]), (None, ["t1"]), (70, []), (71, None), (72, ["x0"])]


@pytest.fixture
def counts(spark):
    return features.term_counts(spark.createDataFrame(ROWS, "doc_id bigint, terms array<string>"))


def collected(weights):
    return sorted((str(r.doc_id), r.term, round(r.weight, 12)) for r in weights.collect())


@pytest.mark.parametrize("max_df", [0.5, 1.0, 0.0])
def test_lookup_and_joins_agree(counts, monkeypatch, max_df):
    looked = features.tfidf_weights(counts, 3, max_df)
    monkeypatch.setattr(features, "LOOKUP_TERMS", -1)
    monkeypatch.setattr(features, "join_counted", lambda *a: scale.join_counted(*a, frequent_keys=5))
    joined = features.tfidf_weights(counts, 3, max_df)
    assert joined.schema.simpleString() == looked.schema.simpleString()
    assert collected(joined) == collected(looked)
    assert bool(collected(looked)) == (max_df > 0)


def test_rows_of_an_id_share_a_norm(spark):
    counts = features.term_counts(spark.createDataFrame([(1, ["a"]), (1, ["a", "b"]), (2, ["b"])], "doc_id int, terms array<string>"))
    got = {(r.doc_id, r.term): r.weight for r in features.tfidf_weights(counts, 1, 1.0).collect()}
    a = b = np.log(4 / 3) + 1
    norm = np.sqrt(2 * a * a + b * b)
    assert got == pytest.approx({(1, "a"): a / norm, (1, "b"): b / norm, (2, "b"): 1.0})


def test_documents_are_dealt_out_before_their_terms_become_rows(spark, counts):
    labels = spark.createDataFrame([(i, i % 4) for i in range(60)], "doc_id bigint, label int")
    means = cluster.class_term_centroids(features.tfidf_weights(counts, 3), labels)
    plan = means._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan.split("Generate")[1]
    assert "hashpartitioning(doc_id" not in plan.split("Generate")[0]


def test_terms_of_one_key_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(features, "_term_keys", lambda terms: np.array([len(t) for t in terms.to_pylist()], np.uint64))
    known = spark.createDataFrame([("a", 1.0), ("bb", 2.0)], "term string, idf double")
    idf = features._idf_lookup(known)
    assert np.array_equal(idf(pa.array(["bb", "cc", "a", "ddd"])), [2.0, np.nan, 1.0, np.nan], equal_nan=True)
    twins = spark.createDataFrame([("bb", 1.0), ("cc", 2.0)], "term string, idf double")
    assert features._idf_lookup(twins) is None
    assert np.isnan(features._idf_lookup(known.where(F.lit(False)))(pa.array(["a"]))).all()
