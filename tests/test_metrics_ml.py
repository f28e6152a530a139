import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog import tables
from labeltext.operators import classify, cluster, features, metrics, scale
from labeltext.plans import jobs


def labelled(spark, labels, clusters):
    return spark.createDataFrame(list(zip(labels, clusters)), "label int, cluster int")


@pytest.mark.parametrize(
    "labels,clusters,want",
    [
        ([0, 0, 1, 1], [0, 0, 1, 1], (1, 1, 1, 1)),
        ([0, 0, 1, 1], [1, 1, 0, 0], (1, 1, 1, 1)),
        ([0, 0, 1, 1], [0, 0, 0, 0], (0, 1, 0, 0)),
        ([0, 0, 0], [0, 0, 0], (1, 1, 1, 1)),
        ([0, 0, 1, 1], [0, 1, 2, 3], (1, 0.5, 2 / 3, 0)),
        ([0, 0, 1, 2], [0, 0, 1, 1], (2 / 3, 1, 0.8, 4 / 7)),
    ],
)
def test_cluster_scores(spark, labels, clusters, want):
    got = metrics.cluster_scores(labelled(spark, labels, clusters)).first()
    assert tuple(got) == pytest.approx(want, abs=1e-12)


def test_scores_ignore_cluster_names(spark):
    rng = random.Random(1)
    a, b = [rng.randrange(4) for _ in range(300)], [rng.randrange(3) for _ in range(300)]
    first = metrics.cluster_scores(labelled(spark, a, b)).first()
    second = metrics.cluster_scores(labelled(spark, a, [{0: 7, 1: 0, 2: 4}[x] for x in b])).first()
    assert tuple(first) == pytest.approx(tuple(second), abs=1e-12)


def test_label_correlation(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 4, 200), rng.integers(0, 3, 200)
    rows = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "a int, b int")
    got = {(r.key1, r.key2): r["corr"] for r in metrics.label_correlation(rows, "a", "b").collect()}
    for i in range(4):
        for j in range(4):
            if j == 3:
                assert got[f"a_{i}", f"b_{j}"] is None
            else:
                assert got[f"a_{i}", f"b_{j}"] == pytest.approx(np.corrcoef(a == i, b == j)[0, 1])


def plain_silhouette(x, c):
    out = []
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        own = (c == c[i]).sum()
        if own == 1:
            out.append(0.0)
            continue
        a = d[c == c[i]].sum() / (own - 1)
        b = min(d[c == k].mean() for k in set(c) - {c[i]})
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_silhouette(spark):
    rng = np.random.default_rng(2)
    x, c = rng.normal(size=(40, 3)), np.array([0] * 20 + [5] * 19 + [9])
    rows = spark.createDataFrame([(i, x[i].tolist(), int(c[i])) for i in range(40)], "id bigint, features array<double>, cluster int")
    assert metrics.silhouette(rows).first()[0] == pytest.approx(plain_silhouette(x, c))
    kept = [r.id for r in metrics.silhouette_sample(rows, 25, 3).collect()]
    assert metrics.silhouette(rows, 25, 3).first()[0] == pytest.approx(plain_silhouette(x[kept], c[kept]))
    assert metrics.silhouette(rows.where("id < 0")).first()[0] is None


def test_losses(spark):
    scored = spark.createDataFrame([(0, 0.5, 0.0), (1, 0.0, 1.0), (2, 0.9, 1.0)], "id bigint, p double, y double")
    got = metrics.loss_and_accuracy(scored).first()
    losses = [-math.log(0.5), 100.0, -math.log(0.9)]
    assert got.bce == pytest.approx(sum(losses) / 3) and got.accuracy == pytest.approx(2 / 3)
    epoch = metrics.epoch_loss(scored, 2).first()
    assert epoch.n_batches == 2 and epoch.epoch_loss == pytest.approx(((losses[0] + losses[1]) / 2 + losses[2]) / 2)


def test_mean_and_deviation(spark):
    runs = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0)], "metric string, value double")
    got = {r.metric: (r.mean_value, r.std_value) for r in metrics.mean_and_deviation(runs).collect()}
    assert got == {"a": (2.0, 1.0), "b": (2.0, 0.0)}


def test_term_counts(spark):
    terms = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, ["z"])], "doc_id bigint, terms array<string>")
    got = {r.doc_id: [tuple(x) for x in r["counts"]] for r in features.term_counts(terms).collect()}
    assert got == {1: [("a", 1), ("b", 2)], 2: [], 3: [("z", 1)]}


@pytest.fixture(scope="module")
def counts(spark, small):
    return features.term_counts(features.document_terms(tables.news(spark, small))).persist()


@pytest.fixture(scope="module")
def weights(counts):
    return features.tfidf_weights(counts).persist()


@pytest.fixture(scope="module")
def dense(weights):
    """The weights as a matrix, with its documents and terms."""
    rows = weights.collect()
    docs, terms = sorted({r.doc_id for r in rows}), sorted({r.term for r in rows})
    at_doc, at_term = {d: i for i, d in enumerate(docs)}, {t: i for i, t in enumerate(terms)}
    matrix = np.zeros((len(docs), len(terms)))
    for r in rows:
        matrix[at_doc[r.doc_id], at_term[r.term]] = r.weight
    return matrix, docs, terms


def components_of(model, terms):
    found = {r.term: r.w for r in model.components.collect()}
    return np.array([found[t] for t in terms])


def test_weights_with_few_broadcast_keys_are_the_same(counts, weights, monkeypatch):
    monkeypatch.setattr(features, "join_counted", lambda *a: scale.join_counted(*a, frequent_keys=20))
    cold = {(r.doc_id, r.term): r.weight for r in features.tfidf_weights(counts).collect()}
    hot = {(r.doc_id, r.term): r.weight for r in weights.collect()}
    assert cold.keys() == hot.keys() and all(abs(cold[k] - hot[k]) < 1e-12 for k in hot)


def test_lsa_is_the_truncated_svd(weights, dense):
    matrix, docs, terms = dense
    _, s, vt = np.linalg.svd(matrix, full_matrices=False)
    model = features.fit_lsa(weights, 6, iterations=12, oversample=40)
    assert model.singular_values == pytest.approx(s[:6], rel=1e-6)
    components = components_of(model, terms)
    assert np.allclose(components.T @ components, np.eye(6), atol=1e-8)
    got = {r.doc_id: r.features.toArray() for r in features.lsa_vectors(weights, model).collect()}
    for d, w in zip(docs, matrix @ components):
        assert np.allclose(got[d], w / np.linalg.norm(w), atol=1e-8)


def test_lsa_default_is_close_in_every_component(weights, dense):
    model = features.fit_lsa(weights, 20)
    s = np.linalg.svd(dense[0], compute_uv=False)
    assert model.singular_values == pytest.approx(s[:20], rel=0.02)


def test_lsa_of_few_terms_and_of_unknown_documents(spark):
    rows = [(1, "a", 1.0), (2, "b", 0.6), (2, "a", 0.8), (3, "b", 1.0)]
    weights = spark.createDataFrame(rows, "doc_id bigint, term string, weight double")
    model = features.fit_lsa(weights, 100, iterations=10)
    assert model.dims == 1
    docs = spark.createDataFrame([(1,), (9,)], "doc_id bigint")
    got = {r.doc_id: r.features.toArray() for r in features.lsa_vectors(weights, model, docs).collect()}
    assert got.keys() == {1, 9} and np.allclose(np.abs(got[1]), 1) and np.allclose(got[9], 0)
    with pytest.raises(ValueError, match="no terms"):
        features.fit_lsa(weights.limit(0))


def test_lsa_has_no_bound_on_terms(spark):
    n = 270_000
    weights = spark.range(n).select((F.col("id") % 300).alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("term"), F.lit(0.01).alias("weight"))
    model = features.fit_lsa(weights, 2, iterations=1, oversample=2)
    # 300 documents of disjoint terms: all singular values are 0.01 * sqrt(900)
    assert model.singular_values == pytest.approx([0.3, 0.3], rel=1e-6)
    assert model.components.count() == n


@pytest.fixture(scope="module")
def sparse(spark):
    """A sparse matrix, a tall table for its terms, one of them unknown, and a frame of it."""
    rng = np.random.default_rng(0)
    matrix = rng.standard_normal((400, 30)) * (rng.random((400, 30)) < rng.random(30))
    matrix[7] = 0.0
    matrix[7, 29] = 1.0
    rows = [(int(i), f"t{j}", float(matrix[i, j])) for i, j in zip(*np.nonzero(matrix))]
    return matrix, rng.standard_normal((29, 3)), spark.createDataFrame(rows, "doc_id int, term string, weight double")


@pytest.mark.parametrize("entries, step, frequent", [(1 << 20, 1 << 14, 10_000), (100, 7, 10_000), (100, 64, 5), (1, 1, 1)])
def test_products_over_blocks(spark, sparse, monkeypatch, entries, step, frequent):
    monkeypatch.setattr(features, "STEP", step)
    monkeypatch.setattr(features, "FREQUENT_TERMS", frequent)
    matrix, table, frame = sparse
    known = matrix[:, :29]
    blocks = features.blocked(frame, entries)
    vectors = spark.createDataFrame([(f"t{j}", v.tolist()) for j, v in enumerate(table)], "term string, v array<double>")
    vectors = vectors.join(blocks.terms, "term")
    got = {r.doc_id: r.v for r in features.image(blocks, vectors).collect()}
    assert got.keys() == set(np.flatnonzero((known != 0).any(axis=1)).tolist())
    assert all(np.allclose(v, known[i] @ table) for i, v in got.items())
    back = {r.term: r.v for r in features.normal_product(blocks, vectors, 3).collect()}
    want = matrix.T @ (known @ table)
    assert len(back) == 30 and all(np.allclose(back[f"t{j}"], want[j]) for j in range(30))
    assert np.allclose(features.image_gram(blocks, vectors, 3), (known @ table).T @ (known @ table))


def test_a_vector_is_sent_once_per_block_and_term(spark, sparse):
    matrix, _, frame = sparse
    blocks = features.blocked(frame, 1000)
    dealt = frame.select(F.pmod(F.xxhash64("doc_id"), F.lit(blocks.blocks.count())).alias("block"), "term")
    distinct = dealt.distinct().count()
    vectors = blocks.terms.withColumn("v", F.array(F.lit(1.0)))
    assert features.shipped(blocks, vectors).count() == distinct == blocks.needs.count()
    assert distinct < frame.count()
    # Sums come out once per block and term too, and are combined map-side before they move.
    plan = features.normal_product(blocks, vectors, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_sum(v") < plan.index("FlatMapCoGroupsInArrow")


def test_classifier_features_come_from_train_only(spark):
    rows = [(i, "train" if i % 3 else "test", f"alpha beta {'only' if i % 3 == 0 else 'gamma delta'} w{i % 4}x", i % 2) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id int, split string, text string, label int")
    counts = features.term_counts(features.document_terms(frame.where("split = 'train'")))
    assert "only" not in {r.term for r in features.term_table(counts, 2, 1.0).collect()}
    done = jobs.classifier_rows(frame, dims=2, min_df=2, max_df=1.0)
    assert done.count() == 60 and {len(r.features) for r in done.collect()} == {2}


def test_labels_are_those_of_the_data(spark):
    rows = spark.createDataFrame([(5, -1), (5, -1), (0, 5), (-1, 0)], "a int, b int")
    hot = metrics.one_hot(rows, "a", "a")
    assert hot.columns == ["a", "b", "a_-1", "a_0", "a_5"] and hot.agg(F.sum("a_5")).first()[0] == 2
    corr = {(r.key1, r.key2): r["corr"] for r in metrics.label_correlation(rows, "a", "b").collect()}
    assert len(corr) == 9 and corr["a_5", "b_-1"] == pytest.approx(1.0)


def test_nearest_centroid_ties_go_to_the_lower_id(spark):
    rows = spark.createDataFrame([(1, [0.0, 1.0]), (2, [5.0, 5.0])], "id bigint, features array<double>")
    centers = spark.createDataFrame([(3, [0.0, 0.0]), (1, [0.0, 2.0])], "cluster int, center array<double>")
    assert {r.id: r.cluster for r in cluster.nearest_centroid(rows, centers).collect()} == {1: 1, 2: 1}


def test_nearest_centroid_in_blocks(spark):
    rng = np.random.default_rng(3)
    points, centers = rng.random((50, 4)), rng.random((30, 4))
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id int, features array<double>")
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cluster int, center array<double>")
    want = ((points[:, None] - centers) ** 2).sum(axis=2).argmin(axis=1).tolist()
    for block in (1, 120, 1 << 20):
        got = {r.id: r.cluster for r in cluster.nearest_centroid(rows, table, block).collect()}
        assert [got[i] for i in range(50)] == want


def test_kmeans_is_repeatable(weights):
    vectors = features.lsa_vectors(weights, features.fit_lsa(weights, 5)).persist()
    a, b = (cluster.assign_clusters(vectors, cluster.fit_kmeans(vectors, 3, seed=4)) for _ in range(2))
    key = lambda df: sorted((r.doc_id, r.cluster) for r in df.select("doc_id", "cluster").collect())
    assert key(a) == key(b) and len(key(a)) == vectors.count()


def test_centroids_return_to_terms(spark):
    matrix = np.array([[1.0, 0.0], [0.0, 1.0], [0.6, 0.8]])
    parts = spark.createDataFrame(list(zip("abc", matrix.tolist())), "term string, w array<double>")
    table = cluster.term_components(features.LsaModel(parts, np.ones(2)))
    got = cluster.centroids_in_term_space(table, [np.array([1.0, 0.0]), np.array([0.5, 0.5])])
    weights = {(r.cluster, r.term): r.weight for r in got.collect()}
    want = np.array([[1.0, 0.0], [0.5, 0.5]]) @ matrix.T
    for k in range(2):
        for i, term in enumerate("abc"):
            assert weights[k, term] == pytest.approx(want[k, i])
    top = [(r.cluster, r["rank"], r.term) for r in cluster.top_terms(got, 2).orderBy("cluster", "rank").collect()]
    assert top == [(0, 1, "a"), (0, 2, "c"), (1, 1, "c"), (1, 2, "a")]


def test_cluster_corpus(spark, small):
    rows = tables.news(spark, small)
    out = jobs.cluster_corpus(rows, k=4, dims=8, runs=2)
    scores = {r.metric: r.mean_value for r in out["scores"].collect()}
    assert set(scores) == {"homogeneity", "completeness", "v_measure", "adjusted_rand", "silhouette"}
    assert scores["homogeneity"] > 0.5
    assert out["clusters"].count() == rows.count() == out["relabelled"].count()
    assert out["top_terms"].groupBy("cluster").count().where("count = 10").count() == 4
    assert out["correlation"].count() == 16


def test_classifier(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    data = [
        (i, float(x[i, 0] + x[i, 1] > 0), ("train", "val", "test")[i % 3], x[i].tolist()) for i in range(300)
    ]
    rows = spark.createDataFrame(data, "doc_id bigint, label double, split string, f array<double>")
    from pyspark.ml.functions import array_to_vector

    rows = rows.select("doc_id", "label", "split", array_to_vector("f").alias("features"))
    trained, report = jobs.train_and_evaluate(rows, str(tmp_path / "m"))
    got = {r.split: r for r in report.collect()}
    assert set(got) == {"train", "val", "test"} and got["test"].accuracy > 0.9
    assert len(trained.history) == classify.EPOCHS
    assert min(loss for _, loss in trained.history) == trained.history[trained.best_epoch][1]
    again = classify.score_rows(rows, classify.load_classifier(str(tmp_path / "m")))
    first = classify.score_rows(rows, trained.model)
    pick = lambda df: {r.doc_id: (r.p, r.predicted) for r in df.collect()}
    assert pick(again) == pick(first)
    assert all(0 <= p <= 1 and d == float(p > 0.5) for p, d in pick(first).values())


def test_classifier_stops_early(spark, monkeypatch):
    losses = iter([0.5, 0.6, 0.7, 0.1])
    rows = tables.vectors(spark, "/root/testdata/sf0.001")
    from pyspark.ml.functions import array_to_vector

    rows = rows.select(
        array_to_vector(F.col("features").cast("array<double>")).alias("features"),
        (F.col("label") > 4).cast("double").alias("label"),
    ).persist()

    class Fake:
        def first(self):
            return type("R", (), {"bce": next(losses)})

    monkeypatch.setattr(classify, "loss_and_accuracy", lambda scored: Fake())
    trained = classify.train_classifier(rows, rows, epochs=10, steps_per_epoch=1, patience=2)
    assert [e for e, _ in trained.history] == [0, 1, 2] and trained.best_epoch == 0
