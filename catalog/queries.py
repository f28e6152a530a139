"""Registered queries: name -> (spark, folder) -> DataFrame.

Sequences come out as joined text or one row per position, so that results
compare by value. Sums of logarithms are rounded to nine digits, for they depend
on the order of addition; all else is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import tables
from labeltext.functions.line_patterns import single_line_pair
from labeltext.functions.text import clean_line, lower_words, split_words
from labeltext.operators import classify, cluster, corpus, features, lift, metrics, network, prompts, rewrite, sentences
from labeltext.operators import vocabulary as vocab
from labeltext.operators.scale import with_row_index
from labeltext.plans import jobs
from labeltext.session import ensure_checkpoint_dir
from labeltext.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


def kept(df: DataFrame) -> DataFrame:
    """A table that is read several times, computed once.

    Checkpointed rather than cached: the result is lazy, so nobody could release a
    cache, while Spark's cleaner deletes checkpoints that nothing refers to.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _words(spark: SparkSession, folder: str, **kwargs) -> DataFrame:
    return kept(lift.document_words(tables.news(spark, folder), **kwargs))


def _lift(words: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return kept(lift.class_lift(words, by))


def _ranked(words: DataFrame) -> DataFrame:
    return lift.ranked_words(words, _lift(words))


def _benchmark_words(spark: SparkSession, folder: str) -> DataFrame:
    tokens = lower_words(split_words(F.col("text")))
    return tables.table(spark, folder, "benchmark").select(F.explode(tokens).alias("token")).distinct()


# --- class lift -------------------------------------------------------------


@query
def class_keywords(spark, folder):
    ranked = _ranked(_words(spark, folder))
    keywords = lift.keywords_above(F.col("ranked"))
    return ranked.select("doc_id", "label", F.array_join(keywords, " | ").alias("keywords"))


@query
def text_label(spark, folder):
    return corpus.text_and_label(tables.news(spark, folder))


@query
def split_choice(spark, folder):
    rows = tables.news(spark, folder)
    chosen = {name: corpus.choose_split(rows, name).drop("split") for name in ("train", "test")}
    chosen["all"] = corpus.choose_split(rows).drop("split")
    return corpus.assemble_splits(chosen).groupBy("split", "label").agg(F.count("*").alias("n_docs"))


@query
def label_counts(spark, folder):
    return lift.label_counts(tables.news(spark, folder))


@query
def token_set(spark, folder):
    return lift.token_set(_words(spark, folder))


@query
def token_doc_freq(spark, folder):
    return lift.document_frequency(_words(spark, folder))


@query
def class_doc_freq(spark, folder):
    return lift.class_lift(_words(spark, folder)).select("label", "word", "tf")


@query
def inverse_doc_ratio(spark, folder):
    return lift.inverse_ratios(_words(spark, folder))


@query
def class_lift(spark, folder):
    return lift.class_lift(_words(spark, folder)).select("label", "word", "score")


@query
def ranked_words(spark, folder):
    ranked = _ranked(_words(spark, folder))
    return ranked.select("doc_id", "label", F.posexplode("ranked").alias("i", "r")).select(
        "doc_id", "label", (F.col("i") + 1).alias("rank"), "r.word", "r.score"
    )


@query
def word_records(spark, folder):
    words = _words(spark, folder)
    records = lift.word_records(words, _lift(words))
    line = F.array_join("sorted_words", " ").alias("sorted_words")
    return records.select("doc_id", "label", line, F.posexplode("raw_scores").alias("pos", "raw_score"))


# --- rewrites ---------------------------------------------------------------


@query
def keyword_line(spark, folder):
    return rewrite.keyword_lines(_ranked(_words(spark, folder)))


@query
def mask_line(spark, folder):
    words = _words(spark, folder, skeleton=True)
    return jobs.rewritten(words, _lift(words), "mask")


@query
def complement_text(spark, folder):
    ranked = _ranked(_words(spark, folder))
    return rewrite.complement_lines(tables.news(spark, folder), ranked)


@query
def style_rows(spark, folder):
    words = _words(spark, folder, by=["split"], skeleton=True)
    lines = jobs.rewritten(words, _lift(words, ["split"]), "mask", by=["split"])
    return jobs.style_rows(tables.news(spark, folder), lines)


@query
def pair_lines(spark, folder):
    words = _words(spark, folder, by=["split"])
    lines = jobs.rewritten(words, _lift(words, ["split"]), "keyword", by=["split"])
    rows = jobs.style_rows(tables.news(spark, folder), lines)
    return rows.select(
        "id", "label_name", "split", single_line_pair(clean_line(F.col("source")), clean_line(F.col("target"))).alias("line")
    )


# --- words, lines, vocabulary -----------------------------------------------


@query
def tokens_cased(spark, folder):
    rows = tables.texts(spark, folder).select("doc_id", split_words(F.col("text")).alias("w"))
    return rows.select("doc_id", F.size("w").alias("n_tokens"), F.array_join("w", " ").alias("tokens"))


@query
def tokens_lower(spark, folder):
    rows = tables.texts(spark, folder).select(
        "doc_id", lower_words(split_words(F.col("text"))).alias("w")
    )
    return rows.select("doc_id", F.size("w").alias("n_tokens"), F.array_join("w", " ").alias("tokens"))


@query
def abbreviations(spark, folder):
    found = sentences.abbreviations(kept(sentences.stop_counts(tables.texts(spark, folder))))
    return rounded(found, "score")


@query
def sentence_openers(spark, folder):
    return rounded(sentences.fit(tables.texts(spark, folder)).openers, "starter")


@query
def sentence_tokens(spark, folder):
    """``tokens_cased`` with the stops of abbreviations kept inside a sentence."""
    texts = tables.texts(spark, folder)
    rows = sentences.sentence_words(texts.select("doc_id", "text"), sentences.fit(texts), "w")
    return rows.select("doc_id", F.size("w").alias("n_tokens"), F.array_join("w", " ").alias("tokens"))


@query
def clean_lines(spark, folder):
    return tables.texts(spark, folder).select("doc_id", clean_line(F.col("text")).alias("line"))


@query
def vocab_table(spark, folder):
    return vocab.build_vocabulary(_benchmark_words(spark, folder))


@query
def encode_padded(spark, folder):
    vocabulary = vocab.build_vocabulary(_benchmark_words(spark, folder))
    rows = vocab.encode_padded(_words(spark, folder), vocabulary, "words", lift.MAX_LEN)
    return rows.select("doc_id", F.size("ids").alias("n_ids"), F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query
def max_token_len(spark, folder):
    rows = tables.texts(spark, folder).select(split_words(F.col("text")).alias("w"))
    return vocab.longest(rows, "w")


@query
def vocab_class_lift(spark, folder):
    vocabulary = vocab.build_vocabulary(_benchmark_words(spark, folder))
    words = kept(vocab.encode(_words(spark, folder), vocabulary, "words"))
    scores = lift.class_lift(words).select("label", "token_id", "score")
    pads = lift.pad_scores(words).select("label", F.lit(0).alias("token_id"), F.col("pad_score").alias("score"))
    return scores.unionByName(pads)


@query
def vocab_keywords(spark, folder):
    vocabulary = vocab.build_vocabulary(_benchmark_words(spark, folder))
    words = kept(vocab.encode(_words(spark, folder), vocabulary, "words"))
    return rewrite.keyword_lines(_ranked(words))


# --- task lines ---------------------------------------------------------------


@query
def nli_pairs_0(spark, folder):
    return prompts.sentence_pair_lines(tables.sentence_pairs(spark, folder), "prompt_0")


@query
def nli_pairs_1(spark, folder):
    return prompts.sentence_pair_lines(tables.sentence_pairs(spark, folder), "prompt_1")


@query
def classification_pairs(spark, folder):
    return prompts.classification_lines(tables.sentiment(spark, folder).withColumnRenamed("doc_id", "id"))


@query
def summary_pairs(spark, folder):
    return prompts.summary_lines(tables.summaries(spark, folder))


@query
def relation_pairs(spark, folder):
    return prompts.relation_lines(tables.relations(spark, folder), tables.relation_names(spark))


@query
def topic_lines(spark, folder):
    return prompts.topic_lines(tables.answers(spark, folder))


@query
def split_renamed(spark, folder):
    pairs = corpus.rename_splits(tables.sentence_pairs(spark, folder), "mrpc")
    return pairs.select("id", "label", "split")


# --- labelings and clusters ---------------------------------------------------


@query
def one_hot(spark, folder):
    rows = metrics.one_hot(tables.news(spark, folder).select("doc_id", "label"), "label", "label")
    return rows.drop("label")


@query
def label_correlation(spark, folder):
    return rounded(metrics.label_correlation(tables.two_labelings(spark, folder), "a", "b"), "corr")


@query
def sparse_one_hot(spark, folder):
    rows = tables.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return metrics.one_hot_sparse(rows, "l_partkey").select("l_orderkey", "l_linenumber", "one_hot.index", "one_hot.size")


@query
def sparse_correlation(spark, folder):
    """Parts with suppliers: labelings of any number of labels, for the pairs that occur."""
    found = metrics.correlations(tables.table(spark, folder, "lineitem"), "l_partkey", "l_suppkey")
    return rounded(found.present(), "corr")


@query
def asked_correlation(spark, folder):
    """The same for one asked pair per part, whether it occurs or not."""
    found = metrics.correlations(tables.table(spark, folder, "lineitem"), "l_partkey", "l_suppkey")
    pairs = tables.table(spark, folder, "part").select(F.col("p_partkey").alias("i"), (F.col("p_partkey") % 12).alias("j"))
    return rounded(found.of(pairs), "corr")


@query
def relabel(spark, folder):
    labels = tables.table(spark, folder, "labels").select("doc_id", F.col("toxic").alias("label"))
    return corpus.relabel(tables.news(spark, folder), labels).select("doc_id", "text", "label")


def _nearest(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.vectors(spark, folder)
    return cluster.nearest_centroid(rows, cluster.class_centroids(rows))


@query
def nearest_centroid(spark, folder):
    return _nearest(spark, folder).select("id", "label", "cluster")


@query
def contingency(spark, folder):
    return metrics.contingency(_nearest(spark, folder), "label", "cluster")


@query
def cluster_scores(spark, folder):
    scores = metrics.cluster_scores(_nearest(spark, folder))
    return rounded(scores, *scores.columns)


@query
def silhouette(spark, folder):
    return rounded(metrics.silhouette(kept(_nearest(spark, folder))), "silhouette")


@query
def metric_mean_std(spark, folder):
    per_source = metrics.loss_and_accuracy(tables.scored(spark, folder), ["source"])
    runs = per_source.unpivot("source", ["bce", "accuracy"], "metric", "value")
    return rounded(metrics.mean_and_deviation(runs), "mean_value", "std_value")


# --- features -------------------------------------------------------------------


def _weights(spark: SparkSession, folder: str) -> DataFrame:
    counts = kept(features.term_counts(features.document_terms(tables.news(spark, folder))))
    return features.tfidf_weights(counts)


@query
def tfidf_weights(spark, folder):
    return rounded(_weights(spark, folder), "weight")


@query
def cluster_top_terms(spark, folder):
    labels = tables.news(spark, folder).select("doc_id", "label")
    weights = cluster.class_term_centroids(_weights(spark, folder), labels)
    return cluster.top_terms(rounded(weights, "weight"))


def _matrix(spark: SparkSession, folder: str) -> features.Coded | features.Blocked:
    """The weights of ``_weights`` for products."""
    return features.term_matrix(features.document_terms(tables.news(spark, folder)))


def _points(spark: SparkSession, folder: str) -> tuple[features.LsaModel, DataFrame]:
    """100 components of all documents, and the documents in them."""
    matrix = _matrix(spark, folder)
    model = features.fit_lsa(matrix)
    return model, kept(features.lsa_vectors(matrix, model, tables.news(spark, folder)))


@query
def lsa_vectors(spark, folder):
    """The trained numbers have no SQL form; their lengths have: 1, or 0 without terms."""
    _, points = _points(spark, folder)
    square = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda n, x: n + x * x)
    return points.select("doc_id", F.round(square, 6).alias("square"))


@query
def lsa_components(spark, folder):
    """Orthonormality of the components, and that they hold no more than all the weight."""
    model, points = _points(spark, folder)
    component = model.components.select("term", F.posexplode("w").alias("i", "w"))
    norms = component.groupBy("i").agg(F.round(F.sum(F.col("w") * F.col("w")), 6).alias("square"))
    held = float((model.singular_values**2).sum())
    total = points.where(F.aggregate(vector_to_array("features"), F.lit(0.0), lambda n, x: n + x * x) > 0).count()
    return norms.select("i", "square", F.lit(0 < held <= total).alias("within"))


@query
def normal_products(spark, folder):
    """Each term's row of A'A V for given vectors V: length, first letter and 1."""
    matrix = _matrix(spark, folder)
    given = F.array(F.char_length("term").cast("double"), F.ascii("term").cast("double") / 128, F.lit(1.0))
    found = features.normal_product(matrix, matrix.terms.withColumn("v", given).checkpoint(), 3)
    return rounded(found.select("term", *[F.col("v")[i].alias(f"p{i}") for i in range(3)]), "p0", "p1", "p2")


@query
def lsa_cross_products(spark, folder):
    """Products of components with each other, and whether they hold at least what as many
    single terms do, which no lesser subspace needs to (Ky Fan)."""
    matrix = _matrix(spark, folder)
    model = features.fit_lsa(matrix)
    single = matrix.squares().orderBy(F.desc("s")).limit(model.dims).agg(F.round(F.sum("s"), 6).alias("s")).first().s
    cross = features.gram(model.components.select(F.col("w").alias("v")), model.dims)
    cells = [(i, j, round(float(cross[i, j]), 6) + 0.0) for i in range(model.dims) for j in range(i + 1)]
    holds = bool((model.singular_values**2).sum() >= single)
    frame = spark.createDataFrame(cells, "i int, j int, product double")
    return frame.select("i", "j", "product", F.lit(single).alias("single_terms"), F.lit(holds).alias("holds"))


@query
def kmeans_clusters(spark, folder):
    _, points = _points(spark, folder)
    model = cluster.fit_kmeans(points, k=4)
    rows = cluster.assign_clusters(points, model)
    return rows.select("doc_id", F.col("cluster").between(0, 3).alias("known_cluster"))


@query
def lloyd_clusters(spark, folder):
    rows = tables.vectors(spark, folder)
    return cluster.lloyd(rows, cluster.class_centroids(rows), 3).select("id", "label", "cluster")


@query
def lloyd_scores(spark, folder):
    rows = tables.vectors(spark, folder)
    scores = metrics.cluster_scores(cluster.lloyd(rows, cluster.class_centroids(rows), 3))
    return rounded(scores, *scores.columns)


def _five_runs(spark: SparkSession, folder: str) -> tuple[DataFrame, cluster.Runs]:
    """The vectors and five runs of four passes, each from the labels' means in a fifth of
    the rows."""
    rows = kept(tables.vectors(spark, folder))
    fifths = rows.groupBy((F.col("id") % 5).cast("int").alias("run"), F.col("label").alias("cluster"))
    mean = vector_to_array(Summarizer.mean(array_to_vector(F.col("features").cast("array<double>"))))
    return rows, cluster.lloyd_runs(rows, fifths.agg(mean.alias("center")), max_iter=4, tolerance=0.0)[0]


@query
def lloyd_runs(spark, folder):
    rows, runs = _five_runs(spark, folder)
    return cluster.assign_runs(rows, runs).select("id", F.posexplode("clusters").alias("run", "cluster"))


@query
def lloyd_run_centers(spark, folder):
    _, runs = _five_runs(spark, folder)
    long = [(r, int(c), v.tolist()) for r, ids, x in zip(runs.names, runs.clusters, runs.centers, strict=True) for c, v in zip(ids, x, strict=True)]
    centers = spark.createDataFrame(long, "run int, cluster int, center array<double>")
    return rounded(centers.select("run", "cluster", F.posexplode("center").alias("dim", "value")), "value")


@query
def lloyd_run_scores(spark, folder):
    rows, runs = _five_runs(spark, folder)
    clustered = cluster.assign_runs(rows, runs).withColumnRenamed("id", "doc_id")
    return rounded(cluster.run_scores(clustered), "value")


@query
def kmeans_runs(spark, folder):
    scores = jobs.cluster_corpus(tables.news(spark, folder), k=4)["scores"]
    sound = F.col("mean_value").between(-1, 1) & (F.col("std_value") >= 0)
    return scores.select("metric", sound.alias("sound"))


@query
def cluster_terms(spark, folder):
    top = jobs.cluster_corpus(tables.news(spark, folder), k=4)["top_terms"]
    return top.select("cluster", "rank")


@query
def centroid_terms(spark, folder):
    """Fixed coordinates over the classes' mean weights, back in terms."""
    labels = tables.news(spark, folder).select("doc_id", "label")
    means = cluster.class_term_centroids(_weights(spark, folder), labels)
    components = means.select("term", F.col("cluster").alias("component"), F.round("weight", 9).alias("weight"))
    back = cluster.centroids_in_term_space(components, [[1.0, 0.0, 0.5, 0.0], [0.25, 0.75, 0.0, 0.0]])
    return cluster.top_terms(rounded(back, "weight"))


# --- classifier -------------------------------------------------------------------


@query
def bce_accuracy(spark, folder):
    return rounded(metrics.loss_and_accuracy(tables.scored(spark, folder)), "bce", "accuracy")


@query
def batch_mean_loss(spark, folder):
    return rounded(metrics.epoch_loss(tables.scored(spark, folder)), "epoch_loss")


def _three_way(spark: SparkSession, folder: str) -> DataFrame:
    fifth = F.col("doc_id") % 5
    split = F.when(fifth == 0, "test").when(fifth == 1, "val").otherwise("train")
    return jobs.classifier_rows(tables.sentiment(spark, folder).withColumn("split", split))


@query
def classifier_scores(spark, folder):
    rows = _three_way(spark, folder)
    trained, _ = jobs.train_and_evaluate(rows)
    scored = classify.score_rows(rows, trained.model)
    sound = F.col("p").between(0, 1) & (F.col("predicted") == (F.col("p") > 0.5).cast("double"))
    return scored.select("doc_id", "split", "y", sound.alias("sound"))


@query
def classifier_best(spark, folder):
    report = jobs.train_and_evaluate(_three_way(spark, folder))[1]
    sound = (F.col("bce") >= 0) & F.col("accuracy").between(0, 1)
    return report.select("split", "n_rows", sound.alias("sound"))


FIXED_LAYERS = [
    [[0.1 * (u - 2), *[((7 * u + 3 * i) % 11 - 5) / 20 for i in range(64)]] for u in range(5)],
    [[0.05, *[(u % 3 - 1) / 2 for u in range(5)]]],
]


def _fixed_network(spark: SparkSession, folder: str) -> tuple[DataFrame, network.Layers]:
    """The vectors with the parity of their label, and given weights, through their table."""
    rows = tables.vectors(spark, folder).withColumn("label", F.col("label") % 2)
    table = network.to_table(spark, [np.array(layer) for layer in FIXED_LAYERS])
    return rows, network.from_table(table)


@query
def forward_scores(spark, folder):
    rows, layers = _fixed_network(spark, folder)
    scored = network.score_rows(rows, layers)
    return rounded(scored.select("id", "p", "y", "predicted"), "p")


@query
def network_gradients(spark, folder):
    """The mean gradient for every weight, by errors sent back through the layers."""
    rows, layers = _fixed_network(spark, folder)
    grads, _, _ = network.gradients(rows, layers)
    return rounded(network.to_table(spark, grads).withColumnRenamed("weight", "gradient"), "gradient")


@query
def best_epoch(spark, folder):
    """Batches of 500 lines of orders stand for epochs, their mean price for the loss."""
    orders = tables.table(spark, folder, "orders")
    epoch = F.floor(F.col("o_orderkey") / 500).cast("int").alias("epoch")
    losses = orders.groupBy(epoch).agg(F.round(F.avg(F.col("o_totalprice").cast("double")), 2).alias("val_loss"))
    return network.best_epochs(losses, patience=3)


@query
def network_floor(spark, folder):
    """A trained network must describe its rows better than the best constant does, in every
    fifth of them."""
    rows = kept(tables.vectors(spark, folder).withColumn("label", (F.col("label") < 5).cast("int")))
    trained = network.train(rows, rows, epochs=2, steps=8)
    share = F.lit(rows.agg(F.avg("label")).first()[0])
    scored = network.score_rows(rows, trained.weights)
    better = F.avg(metrics.cross_entropy(F.col("p"), F.col("y"))) < 0.9 * F.avg(metrics.cross_entropy(share, F.col("y")))
    fifth = (F.col("id") % 5).alias("fifth")
    return scored.groupBy(fifth).agg(F.count("*").alias("n_rows"), better.alias("better"))


# --- readers and checks, as far as they need no files -------------------------------


@query
def vocab_listing(spark, folder):
    vocabulary = vocab.build_vocabulary(_benchmark_words(spark, folder))
    listing = vocab.vocabulary_tokens(vocabulary)
    return with_row_index(listing.join(vocabulary, "token"), ["token_id"], "place").select("place", "token")


@query
def required_values(spark, folder):
    rows = tables.table(spark, folder, "documents").select("doc_id", "source")
    return corpus.require_columns(rows, "doc_id", "source")


@query
def inverted_names(spark, folder):
    entries = tables.table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("pos"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("relation")
    )
    return readers.invert(entries)


@query
def all_valid_lines(spark, folder):
    """Every line of every text, bad bytes replaced."""
    rows = tables.table(spark, folder, "documents")
    lines = F.split(F.make_valid_utf8("text"), "\r\n|\r|\n", -1)
    return rows.select("doc_id", F.posexplode(lines).alias("line_number", "line"))


@query
def fanned_splits(spark, folder):
    rows = tables.news(spark, folder).select("doc_id", "label", "split")
    return corpus.fan_out_splits(rows, {"test": ["val", "test"]})


@query
def complement_corpus(spark, folder):
    """The complement as a rewrite of the whole corpus, statistics over all splits."""
    words = _words(spark, folder)
    lines = jobs.rewritten(words, _lift(words), "complement", rows=tables.news(spark, folder))
    return lines.select("doc_id", "label", "line")


@query
def complement_bucketed(spark, folder):
    """``complement_text`` on a corpus bucketed by id: keywords travel, texts stay."""
    rows = tables.bucketed_news(spark, folder)
    words = kept(lift.document_words(rows))
    return rewrite.complement_lines(rows, _ranked(words))


@query
def style_rows_bucketed(spark, folder):
    """``style_rows`` on a corpus bucketed by id."""
    rows = tables.bucketed_news(spark, folder)
    words = kept(lift.document_words(rows, by=["split"], skeleton=True))
    lines = jobs.rewritten(words, _lift(words, ["split"]), "mask", by=["split"])
    return jobs.style_rows(rows, lines)
